"""Exact, substring, line and near duplicates against plain computations."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchframe.llm import jaccard_join, substring_dedup
from matchframe.llm.exact_dedup import exact_dedup
from matchframe.llm.groups import components, spread_back
from matchframe.llm.line_dedup import line_dedup
from matchframe.llm.words import Words

from .common import awkward, awkward_rows, empty, prose, words


def sha(text) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("keep", "runs", "fan_in"), [("max", 16, 4), ("min", 5, 2), ("max", 1, 2), ("min", 30, 8)])
def test_exact_dedup(spark, keep, runs, fan_in):
    groups = defaultdict(list)
    for i, t, *_ in awkward_rows():
        groups[t or ""].append(i)
    got = sorted((tuple(r) for r in exact_dedup(awkward(spark).repartition(runs), keep=keep, fan_in=fan_in).collect()), key=str)
    want = []
    for i, t, *_ in awkward_rows():
        ids = [x for x in groups[t or ""] if x is not None]
        best = ({"max": max, "min": min}[keep])(ids) if ids else None
        want.append((i, best, len(groups[t or ""]), i == best, sha(t)))
    assert got == sorted(want, key=str)


def test_exact_dedup_merges_sorted_runs(spark):
    """Every round sorts the runs that it takes together and keeps the first entry of a digest; only the first step hashes."""
    from matchframe.llm.exact_dedup import merged_runs

    rows = [(run, bytes([d]), 1, 100 * run + d, 2) for run in range(16) for d in range(20) if (run + d) % 3]
    runs = spark.createDataFrame(rows, "run int, digest binary, size long, best long, rows long")
    out = merged_runs(runs, 16, F.col("best").asc_nulls_last(), 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Sort [") == 2 and "Aggregate" not in plan
    got = sorted((bytes(r.digest)[0], r.best, r.rows) for r in out.collect())
    held = {d: [r for r in rows if r[1][0] == d] for d in range(20)}
    assert got == [(d, min(r[3] for r in x), 2 * len(x)) for d, x in sorted(held.items())]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(empty(spark)).count() == 0


def brute_substrings(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def substring_rows(spark, docs, window=13):
    return sorted((tuple(r) for r in substring_dedup.substring_dedup(docs, window=window).collect()), key=str)


def test_substring_dedup_awkward(spark):
    want = brute_substrings([r[:2] for r in awkward_rows()], 13)
    assert substring_rows(spark, awkward(spark)) == sorted(want, key=str)
    assert substring_rows(spark, empty(spark)) == []


@pytest.mark.parametrize("window", [6, 13])
def test_substring_dedup_random(spark, window):
    rng = random.Random(window)
    pool = [[rng.choice("abcdefg") for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pool)[rng.randrange(3) :] for _ in range(rng.randrange(1, 6))]
        text = [w + str(rng.randrange(3)) if rng.random() < 0.02 else w for p in parts for w in p]
        rows.append((rng.randrange(100), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert substring_rows(spark, docs, window) == sorted(brute_substrings(rows, window), key=str)


def test_seeds_survive_batch_borders(spark):
    rows = [(i, prose(40) + f" u{i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = substring_rows(spark, docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(brute_substrings(rows, 13), key=str)


def test_windows_that_agree_in_40_bits_are_told_apart(monkeypatch):
    plain = Words.grams
    alike = lambda self, k: plain(self, k) if k < 13 else np.arange(len(self.hash) - k + 1, dtype=np.uint64) << np.uint64(40)
    monkeypatch.setattr(Words, "grams", alike)
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([prose(12) + " x", prose(12) + " y"])], ["doc", "text"])
    pieces = list(substring_dedup._pieces(13)([docs]))
    assert len(set(pieces[0].column("seed").to_pylist())) == 1
    assert sum(b.num_rows for b in substring_dedup._factors(13)(pieces)) == 0


def brute_lines(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for t, host in rows:
        pages[host] += 1
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            seen[host, line] += 1
    out = []
    for t, host in rows:
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        bad = {x for x in lines if seen[host, x.strip(" ")] >= least and seen[host, x.strip(" ")] > ratio * pages[host]}
        kept = [x for x in lines if x not in bad]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_line_dedup(spark, limit):
    rows = [(None if i % 11 == 0 else f"menu \nrow {i}\n\n menu\nitem {i % 3}", "big" if i % 3 else None) for i in range(60)]
    rows += [(f"menu\nown {i}", f"small{i}") for i in range(4)] + [("", "big"), ("\n", "big")]
    docs = spark.createDataFrame([(i, *r, 5) for i, r in enumerate(rows)], "doc_id long, text string, source string, n_lines int")
    out = line_dedup(docs, ratio=0.2, min_pages=3, broadcast_lines=limit, salts=3)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    got = [tuple(r) for r in out.select("text", "n_lines", "n_removed").collect()]
    assert sorted(got, key=str) == brute_lines(rows, 0.2, 3)


def test_line_dedup_awkward(spark):
    docs = awkward(spark)
    out = line_dedup(docs, min_pages=2)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert line_dedup(empty(spark)).count() == 0


def brute_jaccard(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if a == b or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)] if d is not None and s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def jaccard_rows(docs, **more):
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(docs, **more).collect()), key=str)


def test_jaccard_awkward(spark):
    assert jaccard_rows(awkward(spark)) == brute_jaccard([r[:2] for r in awkward_rows()], 3, 90)
    assert jaccard_rows(empty(spark)) == []


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_random_and_split_blocks(spark, monkeypatch, n, percent):
    rng = random.Random(5)
    bases = [[f"b{rng.randrange(400)}" for _ in range(rng.choice([2, 5, 40, 90, 200]))] for _ in range(14)]
    hot = " ".join(f"h{i}" for i in range(12))
    rows = []
    for _ in range(260):
        base = rng.choice(bases) if rng.random() < 0.6 else bases[4]
        text = edited(rng, base, rng.randrange(4))
        rows.append((len(rows), text if rng.random() < 0.6 else f"{text} {hot}"))
    want = brute_jaccard(rows, n, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert jaccard_rows(docs, n=n, percent=percent) == want
    # Many row blocks per component; columns of the openers cut as well.
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    assert jaccard_rows(docs, n=n, percent=percent) == want


def test_openers_of_split_columns_meet():
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    texts = [edited(rng, base, 1) for _ in range(40)]

    class Counts:
        import numpy as np

        value = np.full(jaccard_join.SKETCH, 5, np.int64)

    import pyarrow as pa

    Counts.value[:] = 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["doc", "text"])
    whole = {}
    for limit in (10**9, 3):
        jaccard_join.BLOCK_ROWS, before = limit, jaccard_join.BLOCK_ROWS
        Counts.value[:] = 25
        try:
            rows = [b.to_pylist() for b in jaccard_join._openers(3, 90, Counts)([batch])]
        finally:
            jaccard_join.BLOCK_ROWS = before
        groups = defaultdict(set)
        for r in sum(rows, []):
            groups[r["gram"], r["block"]].add(r["node"])
        pairs = {frozenset((a, b)) for g in groups.values() for a in g for b in g}
        whole[limit] = pairs
    assert whole[10**9] <= whole[3] | whole[10**9] and whole[3] <= whole[10**9]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_back_splits_a_hot_key(spark):
    rows = spark.range(300).select(F.col("id").alias("doc"), F.when(F.col("id") < 290, 1).otherwise(F.col("id")).alias("k"))
    verdict = spark.createDataFrame([(1, "hot"), (295, "rare")], "k long, v string")
    got = Counter(r["v"] for r in spread_back(rows, verdict, "k", F.col("doc"), 8).collect())
    assert got == {"hot": 290, "rare": 1, None: 9}
