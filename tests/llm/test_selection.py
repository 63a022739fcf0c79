"""Resampling, clustering and quality scores against plain computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchframe.llm import centroid_clustering, quality_classifier
from matchframe.llm.centroid_clustering import centroid_clusters, neighbour_lists, orchard
from matchframe.llm.importance_resampling import gram_pattern, importance_resample, scan
from matchframe.llm.quality_classifier import quality_scores

from .common import awkward, awkward_rows, empty, prose

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_grams(text, shortest, longest):
    words = RUN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) for g in grams]


def brute_resample(rows, target, percent, shortest, longest, buckets, least):
    found = [(i, *plain_grams(t, shortest, longest)) for i, t in rows]
    corpus = Counter(c % buckets for _, _, g in found for c in g)
    aim = Counter(c % buckets for t in target for c in plain_grams(t, shortest, longest)[1])
    s_all, t_all = sum(corpus.values()), sum(aim.values())
    out = []
    for i, n, grams in found:
        gains = [
            math.floor(1000 * math.log((aim[c % buckets] + 1) * (s_all + buckets) / ((corpus[c % buckets] + 1) * (t_all + buckets))))
            for c in grams
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n, len(grams), weight, score))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = percent * len(fit) // 100
    return sorted([(*r, k + 1) for k, r in enumerate(fit[:drawn])] + [(*r, None) for r in fit[drawn:] + [r for r in out if r[1] < least]], key=str)


@pytest.mark.parametrize(("shortest", "longest", "percent", "buckets"), [(1, 1, 10, 10_000), (1, 3, 50, 97), (2, 2, 100, 100_000)])
def test_resample_awkward(spark, shortest, longest, percent, buckets):
    target = ["w7 One TWO", None, "", prose(40, 5)]
    given = spark.createDataFrame([(t, 1) for t in target], "text string, cells int")
    args = {"percent": percent, "shortest": shortest, "longest": longest, "buckets": buckets, "least_words": 5}
    got = importance_resample(awkward(spark), given, **args).collect()
    want = brute_resample([r[:2] for r in awkward_rows()], target, percent, shortest, longest, buckets, 5)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_resample_many_ties(spark):
    rows = [(k % 700, prose(25 + k % 3, k % 5)) for k in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(prose(30),)], "text string")
    got = [tuple(r) for r in importance_resample(docs, target, percent=30).collect()]
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 601))
    want = brute_resample(rows, [prose(30)], 30, 1, 1, 10_000, 20)
    ranked = lambda rows: sorted((r[5], r[4], r[0]) for r in rows if r[5])
    assert ranked(got) == ranked(want)


def test_resample_of_nothing(spark):
    target = spark.createDataFrame([(None,)], "text string")
    assert importance_resample(empty(spark), target).count() == 0
    some = importance_resample(awkward(spark), target.limit(0), least_words=5, percent=100)
    assert some.where("rank IS NOT NULL").count() == some.where("n_words >= 5").count() > 0


def test_scan_follows_bytes():
    text = "Ab--cÉ 1a\x7fx\n" + "y" * 70_000 + "  é"
    words, cells = scan(text.encode(), [gram_pattern(1), gram_pattern(3)], 1 << 20)
    n, crcs = plain_grams(text, 1, 1)
    assert words == n and cells.tolist() == [c % (1 << 20) for c in crcs + plain_grams(text, 3, 3)[1]]


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [
        (i, tuple(max(-(1 << 27), min(1 << 27, math.floor(scale * x))) for x in v))
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(m) for x in zip(*m, strict=True)) if m else c for m, c in zip(members, centroids, strict=True)]
    at = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in at:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, d, c in at], key=str)


@pytest.mark.parametrize(("k", "rounds"), [(4, 3), (1, 0), (100, 2)])
def test_clusters_awkward(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [float(rng.randrange(-3, 4)) / 2 for _ in range(3)]) for i in range(60)]
    rows += [(5, [0.5, 0.5, 0.5])] * 20 + [(None, [1.0, 1.0, 1.0]), (None, None), (70, []), (71, [1.0, 2.0])]
    rows += [(72, [1.0, None, 2.0]), (73, [1.0, float("nan"), 2.0]), (74, [float("-inf"), 0.0, 0.0]), (75, [1e30, -1e30, 0.0])]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")
    got = centroid_clusters(docs, k=k, rounds=rounds, dims=3, scale=2.0).collect()
    wide = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(wide, k, rounds, 3, 2.0)


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert centroid_clusters(none).count() == 0
    assert centroid_clusters(spark.createDataFrame([(1, None)], none.schema)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 33])
def test_orchard_is_exact(k, monkeypatch):
    rng = np.random.default_rng(k)
    centroids = rng.integers(-4, 5, (k, 2))
    vectors = rng.integers(-6, 7, (500, 2))
    squares = ((vectors[:, None] - centroids) ** 2).sum(2)
    at, best = orchard(vectors, centroids, *neighbour_lists(centroids))
    assert (best == squares.min(1)).all() and (at == squares.argmin(1)).all()


def test_orchard_skips_far_centroids():
    """Beyond twice the distance nothing is computed: a lookup there would fail on the marked value."""
    centroids = np.array([[0, 0], [10, 0], [1000, 0]])
    order, squares = neighbour_lists(centroids)
    poisoned = centroids.copy()
    poisoned[2] = [1, 0]
    at, best = orchard(np.array([[1, 0], [9, 0]]), poisoned, order, squares)
    assert at.tolist() == [0, 1] and best.tolist() == [1, 1]


def quality_rows(n):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(n):
        size = rng.randrange(12, 60)
        text = " ".join(word() for _ in range(size)) + "."
        bad = rng.random() < 0.2
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), " ".join([word()] * size)])
        rows.append((i, text, 0 if bad else 1))
    return rows


def test_quality_held_out(spark):
    rows = quality_rows(600)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(None, None, None), (10**6, "", "x")], "doc_id long, text string, x string")
    labels = spark.createDataFrame([(i, q, 5) for i, _, q in rows] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, score int")
    got = quality_scores(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r["doc_id"] in truth and r["doc_id"] % 5 == 0]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    good, bad = ([r["score"] for r in held if truth[r["doc_id"]] == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.99 * len(good) * len(bad)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (8, 1), (13, 0), (99, 1)], "doc_id long, quality int")
    everything = F.lit(True)
    got = quality_scores(awkward(spark), labels, everything)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(awkward_rows())
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL").count() == 0
    assert quality_scores(empty(spark), labels, everything).count() == 0
    one_kind = quality_scores(awkward(spark), labels.where("quality = 1"), everything)
    assert {(r["score"], r["predicted"]) for r in one_kind.collect()} == {(0.5, 1)}


def test_pairs_grow_with_rows(spark):
    """Every good row meets a few bad ones, repeated rows too; no product of both labels."""
    rows = [([float(k % 7), 1.0], 1 if k % 5 else 0, k) for k in range(5_000)]
    labelled = spark.createDataFrame(rows, "x array<float>, good int, place long")
    pairs = quality_classifier.preference_pairs(labelled, 4)
    assert 0.8 < pairs.count() / (4 * 4_000) < 1.2
    assert pairs.where("d[1] <> 0 OR y NOT IN (0, 1)").count() == 0 and pairs.where("y = 1").count() > 0.4 * pairs.count()


def test_features_by_hand():
    texts = ["", "AB!! AB!!\nab", "é 12", "\n \n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    x = quality_classifier.features(data, offsets)
    assert x.shape == (4, quality_classifier.FEATURES) and np.isfinite(x).all()
    classes = quality_classifier.CLASSES
    assert (x[0] == 0).all()
    assert x[1, 1] == pytest.approx(math.sqrt(4 / 12)) and x[1, 7] == pytest.approx(math.sqrt(4 / 12))
    assert x[1, classes + 6] == pytest.approx(math.sqrt(2 / 3))
    assert x[1, classes + 9] == pytest.approx(math.sqrt(1 / 3))
    assert x[2, classes + 7] == pytest.approx(math.sqrt(1 / 2))
    assert centroid_clustering.LARGEST**2 * 4 * 64 < 2**63
