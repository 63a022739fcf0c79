"""Benchmark passages in documents, by latent semantic retrieval.

1. Terms are the words of the benchmark passages (letters and digits, ASCII
   lower-cased, punctuation apart).  One pass over all documents counts in how many
   strides of ``STRIDE`` words each term occurs, which gives its inverse document
   frequency.
2. The passages are dealt by hash into spaces of about ``SPACE_ITEMS``, half of ``RANK``,
   so each space keeps all directions of its passages.  The TF-IDF matrix of a space is
   factored by a distributed randomised SVD: each task multiplies its passages with a
   random basis of the terms and back, Spark adds the products, and after ``POWER`` such
   rounds the orthogonal basis is turned to the right singular vectors.
3. Every document is cut into strides and windows of 2, 4, 8 ... strides; a
   passage is searched with the windows that are at least as long as it plus a
   stride, so one of them holds any copy.  A window whose cosine with the passage in
   the latent space is ``cosine`` or more is a candidate.  So is every place of the
   ``SHORT`` words of a passage that the fewest other passages hold, whatever its cosine.
4. Of the candidate windows in each half window's length the best is checked: the
   longest common subsequence of the passage and the window, widened on either side by
   half the passage and a quarter window so that it covers the others, must hold ``share`` of the passage's words, which bears edits and
   small changes of order; and the passage's answer, where the benchmark has one,
   must stand there word for word.  Passages of fewer than ``SHORT`` words must stand
   there word for word themselves.

The benchmark is a stated set of queries: it goes over all documents in blocks of
``BLOCK_ITEMS`` passages, so what is broadcast does not grow with it; the spaces of a
block share one pass that counts and one that searches.  Documents are scanned where
they lie and never shuffled.

Cases: a document or passage without words (null, empty) matches nothing; a passage
with a null id is searched and reported as null; equal passages are all reported,
ties in lcs keep all; null document ids and repeated rows are judged alike; an empty
benchmark or document table gives no hits; columns named like the results are
replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.llm.shared import share as send
from matchframe.llm.words import LOWER, Words, row_blocks, split_words
from matchframe.shipping import ship

STRIDE, RANK, EXTRA, POWER, SHORT = 16, 256, 8, 2, 8
BLOCK_ITEMS, SPACE_ITEMS = 2_000, 128
HIT = "struct<item:bigint,lcs:double>"
RESULTS = ("item_ids", "lcs")
CLEAN = LOWER.copy()
CLEAN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
FLAGS = 1 << 20


def clean_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, offsets in row_blocks(column):
        yield lo, hi, split_words(CLEAN[data], offsets)


@dataclass
class Terms:
    """Sorted hashes of the benchmark's words, with a flag table that rules out most other words."""

    hashes: np.ndarray
    flags: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Terms:
        flags = np.zeros(FLAGS, bool)
        flags[(hashes & np.uint64(FLAGS - 1)).astype(np.int64)] = True
        return cls(hashes, flags)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their term numbers."""
        at = np.flatnonzero(self.flags[(words & np.uint64(FLAGS - 1)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hashes, words[at]), len(self.hashes) - 1)
        good = self.hashes[term] == words[at]
        return at[good], term[good]


def _strides(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The stride of every word, and each row's first stride."""
    first = np.concatenate([[0], np.cumsum(-(-words.counts // STRIDE))])
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    return first[row] + (np.arange(len(words.hash)) - words.first[row]) // STRIDE, first


def _count_terms(terms):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Terms = terms.value
        counts, strides = np.zeros(len(known.hashes), np.int64), 0
        for batch in batches:
            for _, _, words in clean_words(batch.column(0)):
                stride, first = _strides(words)
                strides += int(first[-1])
                at, term = known.find(words.hash)
                once = np.unique(stride[at] * len(known.hashes) + term)
                counts += np.bincount(once % len(known.hashes), minlength=len(known.hashes))
        term = np.append(np.flatnonzero(counts), -1)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.append(counts[term[:-1]], strides))], ["term", "n"])

    return run


def inverse_frequency(docs: DataFrame, text_col: str, terms: Terms) -> np.ndarray:
    """log((1 + strides) / (1 + strides with the term)) + 0.01 of each term, over all documents.  Runs a job."""
    shared = send(docs.sparkSession, terms)
    counted = docs.select(text_col).mapInArrow(_count_terms(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    seen, strides = np.zeros(len(terms.hashes)), 0
    for r in counted.toLocalIterator():
        if r["term"] < 0:
            strides = r["n"]
        else:
            seen[r["term"]] = r["n"]
    return np.log((1 + strides) / (1 + seen)) + 0.01


def _item_words(texts: Iterable[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, words in clean_words(pa.array([t or "" for t in texts], pa.string())):
        out += [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    return out


def _weights(texts: Iterable[str | None], terms: Terms, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Term numbers and unit-length TF-IDF weights of each passage."""
    for words in _item_words(texts):
        _, term = terms.find(words)
        term, times = np.unique(term, return_counts=True)
        weight = times * idf[term]
        yield term, weight / max(1e-12, float(np.sqrt((weight**2).sum())))


def _multiply(model, basis):
    """This task's part of A^T A basis, as one row of 64-bit floats."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, idf = model.value
        out = np.zeros_like(basis.value)
        for batch in batches:
            for term, weight in _weights(batch["text"], terms, idf):
                out[term] += weight[:, None] * (weight @ basis.value[term])
        yield pd.DataFrame({"task": [0], "part": [out.tobytes()]})

    return run


def _add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(parts["part"].iloc[0]) // 8)
    for part in parts["part"]:
        total += np.frombuffer(part)
    return pd.DataFrame({"task": [key[0]], "part": [total.tobytes()]})


def _product(items: DataFrame, model, basis: np.ndarray) -> np.ndarray:
    """A^T A basis; tasks' parts are added in rounds of eight."""
    shared = send(items.sparkSession, basis)
    parts = items.mapInPandas(_multiply(model, shared), "task long, part binary").withColumn("task", F.spark_partition_id().cast("long"))
    left = items.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // 8)
        parts = parts.withColumn("task", F.floor(F.col("task") / 8)).groupBy("task").applyInPandas(_add, "task long, part binary")
    return sum(np.frombuffer(r["part"]).reshape(basis.shape) for r in parts.select("part").collect())


def leading_vectors(items: DataFrame, model, n_terms: int, n_items: int, rank: int) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the passages' TF-IDF matrix.  Runs a job per round."""
    width = min(rank + EXTRA, n_items, n_terms)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((n_terms, width)))[0]
    for _ in range(POWER):
        basis = np.linalg.qr(_product(items, model, basis))[0]
    small = basis.T @ _product(items, model, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[: min(rank, width)]
    return basis @ turn[:, order]


@dataclass
class Space:
    """Passages of one latent space, ready for search."""

    terms: Terms
    vectors: np.ndarray  # terms x rank, times the inverse frequency
    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray | None]
    latent: np.ndarray  # passages x rank, unit length
    scale: np.ndarray  # strides of the windows each passage is searched with


@dataclass
class Grams:
    """One run of ``SHORT`` words of each passage that has as many, sorted by hash."""

    terms: Terms
    first: np.ndarray  # each hash's first passage
    item: list[tuple[int, int]]  # space, passage
    place: np.ndarray  # where in the passage the run starts

    @classmethod
    def of(cls, spaces: list[Space]) -> Grams:
        runs = []
        for s, space in enumerate(spaces):
            for i, words in enumerate(space.words):
                if len(words) >= SHORT:
                    one = Words(words[:0], words[:0], words[:0], np.array([0, len(words)]), words)
                    runs.append((s, i, one.grams(SHORT)))
        distinct = [np.unique(r[2]) for r in runs]
        hashes, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *distinct]), return_counts=True)
        place = np.array([np.argmin(times[np.searchsorted(hashes, g)]) for _, _, g in runs], np.int64)
        chosen = np.array([g[p] for (_, _, g), p in zip(runs, place, strict=True)], np.uint64)
        order = np.argsort(chosen, kind="stable")
        used, first = np.unique(chosen[order], return_index=True)
        return cls(Terms.of(used), np.append(first, len(order)), [runs[o][:2] for o in order], place[order])


def word_places(pattern: list[int]) -> dict[int, int]:
    """Each word's places in the pattern as bits of one number."""
    places: dict[int, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    return places


def lcs(places: dict[int, int], length: int, text: list[int], least: int = 0) -> int:
    """Length of the longest common subsequence of a pattern and a text; 0 if too few words are shared for ``least``."""
    shared = [places[w] for w in text if w in places]
    if len(shared) < least:
        return 0
    row = full = (1 << length) - 1
    for bits in shared:
        hit = row & bits
        row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def _stands(pattern: np.ndarray, text: np.ndarray) -> bool:
    n = len(pattern)
    starts = np.flatnonzero(text[: len(text) - n + 1] == pattern[0]) if len(text) >= n else []
    return any((text[s : s + n] == pattern).all() for s in starts)


def _sum_vectors(vectors: np.ndarray, term: np.ndarray, stride: np.ndarray, n: int) -> np.ndarray:
    """Sum of the terms' vectors per stride; ``stride`` ascends.  The j-th terms of all strides are added at once."""
    out = np.zeros((n, vectors.shape[1]), np.float32)
    if not len(term):
        return out
    begin = np.flatnonzero(np.concatenate([[True], stride[1:] != stride[:-1]]))
    count = np.diff(np.append(begin, len(stride)))
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    sums = np.zeros((len(begin), vectors.shape[1]), np.float32)
    for j in range(int(count[0])):
        m = int(np.searchsorted(-count, -j, "left"))
        sums[:m] += vectors[term[begin[:m] + j]]
    out[stride[begin]] = sums
    return out


def candidates(words: Words, block: Space, cosine: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, passage, first word, end word): of the windows that reach ``cosine`` the best in each half window's length, widened."""
    stride, first = _strides(words)
    n = int(first[-1])
    if not n:
        return
    row = np.repeat(np.arange(len(words.counts)), np.diff(first))
    at, term = block.terms.find(words.hash)
    sums = _sum_vectors(block.vectors, term, stride[at], n)
    reach = 1
    for scale in range(1, int(block.scale.max()).bit_length()):
        # Windows twice as long: each with the one that follows it in the same row.
        follow = np.arange(n) + reach
        same = np.flatnonzero((follow < n) & (row[np.minimum(follow, n - 1)] == row))
        longer = sums.copy()
        longer[same] += sums[same + reach]
        sums, reach = longer, 2 * reach
        wanted = np.flatnonzero(block.scale == 1 << scale)
        if not len(wanted):
            continue
        norm = np.sqrt((sums * sums).sum(1))
        near = (sums @ block.latent[wanted].T) >= cosine * np.maximum(norm, 1e-9)[:, None]
        which, window = np.nonzero(near.T)
        if not len(which):
            continue
        value = (sums[window] * block.latent[wanted[which]]).sum(1) / norm[window]
        part = window // max(1, reach // 2)
        run = np.concatenate([[True], (which[1:] != which[:-1]) | (part[1:] != part[:-1]) | (row[window[1:]] != row[window[:-1]])])
        number = np.cumsum(run) - 1
        order = np.lexsort((-value, number))
        best = order[np.concatenate([[True], number[order][1:] != number[order][:-1]])]
        for w, item in zip(window[best].tolist(), wanted[which[best]].tolist(), strict=True):
            r = int(row[w])
            start = int(words.first[r]) + (w - int(first[r])) * STRIDE
            wider = len(block.words[item]) // 2 + reach * STRIDE // 4
            end = start + reach * STRIDE + wider
            yield r, item, max(int(words.first[r]), start - wider), min(int(words.first[r + 1]), end)


def copies(words: Words, spaces: list[Space], grams: Grams) -> Iterator[tuple[int, int, int, int, int]]:
    """(space, row, passage, first word, end word) of the places where a passage's run of words stands, widened."""
    starts = words.gram_starts(SHORT)
    if not len(starts) or not len(grams.terms.hashes):
        return
    at, gram = grams.terms.find(words.grams(SHORT)[starts])
    at = starts[at]
    rows = np.searchsorted(words.first, at, "right") - 1
    for a, g, r in zip(at.tolist(), gram.tolist(), rows.tolist(), strict=True):
        for k in range(int(grams.first[g]), int(grams.first[g + 1])):
            s, item = grams.item[k]
            m = len(spaces[s].words[item])
            start, wider = a - int(grams.place[k]), m // 2 + STRIDE
            yield s, r, item, max(int(words.first[r]), start - wider), min(int(words.first[r + 1]), start + m + wider)


def _scan(text_at: int, block, cosine: float, share: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, grams = block.value
        patterns = [[word_places(w.tolist()) for w in space.words] for space in spaces]
        for batch in batches:
            for lo, hi, words in clean_words(batch.column(text_at)):
                found: list[dict[tuple[int, int], float]] = [{} for _ in range(hi - lo)]
                near = ((s, *c) for s, space in enumerate(spaces) for c in candidates(words, space, cosine))
                for s, row, item, start, end in chain(copies(words, spaces, grams), near):
                    known: Space = spaces[s]
                    m = len(known.words[item])
                    region = words.hash[start:end]
                    answer = known.answers[item]
                    if answer is not None and not _stands(answer, region):
                        continue
                    if m < SHORT:
                        ratio = 1.0 if _stands(known.words[item], region) else 0.0
                    else:
                        ratio = lcs(patterns[s][item], m, region.tolist(), int(share * m)) / m
                    if ratio >= share:
                        found[row][s, item] = max(ratio, found[row].get((s, item), 0.0))
                hits = [[{"item": spaces[s].ids[i], "lcs": r} for (s, i), r in sorted(f.items())] for f in found]
                kind = pa.list_(pa.struct([("item", pa.int64()), ("lcs", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in batch.columns], pa.array(hits, kind)], [*batch.schema.names, "__hits"]
                )

    return run


def _prepare(docs: DataFrame, text_col: str, items: DataFrame, rank: int) -> tuple[list[Space], Grams] | None:
    spark = docs.sparkSession
    spaces = F.ceil(F.lit(items.count()) / F.lit(SPACE_ITEMS))
    items = items.withColumn("space", F.pmod(F.xxhash64("text", "item"), spaces))
    rows = items.orderBy("space", "item", "text").collect()
    words = _item_words(r["text"] for r in rows)
    used = [i for i, w in enumerate(words) if len(w)]
    if not used:
        return None
    block = Terms.of(np.unique(np.concatenate([words[i] for i in used])))
    block_idf = inverse_frequency(docs, text_col, block)
    out = []
    for number, members in groupby(used, lambda i: rows[i]["space"]):
        mine = list(members)
        terms = Terms.of(np.unique(np.concatenate([words[i] for i in mine])))
        idf = block_idf[np.searchsorted(block.hashes, terms.hashes)]
        model = send(spark, (terms, idf))
        vectors = leading_vectors(items.where(F.col("space") == number), model, len(terms.hashes), len(mine), rank)
        latent = np.stack([w @ vectors[t] for t, w in _weights([rows[i]["text"] for i in mine], terms, idf)])
        latent /= np.maximum(1e-12, np.sqrt((latent**2).sum(1)))[:, None]
        answers = [w if len(w) else None for w in _item_words(rows[i]["answer"] for i in mine)]
        strides = np.array([-(-len(words[i]) // STRIDE) + 1 for i in mine])
        out.append(
            Space(
                terms, (vectors * idf[:, None]).astype(np.float32), [rows[i]["item"] for i in mine], [words[i] for i in mine],
                answers, latent.astype(np.float32), 1 << np.ceil(np.log2(strides)).astype(np.int64),
            )
        )
    return out, Grams.of(out)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    answer_col: str | None = None, cosine: float = 0.5, share: float = 0.65, rank: int = RANK,
) -> DataFrame:
    """``docs`` with ``item_ids``, the benchmark passages found in each, and ``lcs``, the largest share (0 if none).

    Runs the jobs that count terms and factor the passages.
    """
    spark = docs.sparkSession
    ship(spark)
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"), answer.alias("answer"))
    out = docs.drop(*RESULTS)
    given = out.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    hits = F.array().cast(f"array<{HIT}>")
    blocks = -(-items.count() // BLOCK_ITEMS)
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number)
        block = _prepare(docs, text_col, part, rank)
        if block is None:
            continue
        run = _scan(given.index(text_col), send(spark, block), cosine, share)
        name = f"__hits_{number}"
        out = out.mapInArrow(run, f"{schema}, __hits array<{HIT}>").withColumnRenamed("__hits", name)
        schema += f", `{name}` array<{HIT}>"
        hits = F.concat(hits, F.col(name))
    return out.select(
        *given,
        F.array_sort(F.transform(hits, lambda h: h["item"])).alias("item_ids"),
        F.coalesce(F.array_max(F.transform(hits, lambda h: h["lcs"])), F.lit(0.0)).alias("lcs"),
    )
