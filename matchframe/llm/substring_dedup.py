"""Repeated passages by relative Lempel-Ziv parsing.

The reference is the whole corpus: a passage of a document may be copied from
any document with a smaller id.  It is cut into blocks by content.  Of every
``window`` consecutive words, the ``SEED`` words with the smallest hash are the
window's seed; equal windows have equal seeds at equal places.  All windows with
one seed meet in one block, so parsing a document's piece against that block
finds what parsing it against every block would.

A block indexes, for each seed, the windows that start in it by their 64-bit
hash with the smallest document that holds them; the 32 bits of the seed only
bring equal windows together.  A piece, the run of consecutive windows with one seed, is
factored against this index: from its first window that a smaller document
holds, a factor runs on as long as the next window is held too.  Pieces overlap
by ``window - 1`` words, so windows across the border of two factors are looked
up like all others.  Every word under a factor is a duplicate; factors are at
least ``window`` words long.

Only pieces move, about one for every six words with eight bytes per window, and
once, and then the packed texts to their factors; a window that a document holds twice moves once, and its factor covers all
its places.  A block streams through its rows in (seed,
document) order and holds the distinct windows of one seed, so a passage in a
third of all documents costs that many short rows, spread over its seeds.

Cases: a null text has no words; a null id is neither parsed nor a reference, so
its words stay; repeated rows of one id do not remove each other's words, and
texts of the same id are told apart by a hash; fewer words than ``window`` stay;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.llm.words import Words, binary_column, mix, word_blocks
from matchframe.shipping import ship

SEED, PRINT = 3, 8
PIECES = "seed int, doc long, place long, prints binary"
FACTORS = "doc long, version int, lo long, hi long, source long"
VERSION_SHIFT = 44
ODD = np.uint64(0x9E3779B97F4A7C15)


def versions(words: Words) -> np.ndarray:
    """A 19-bit hash of each row's words, to tell texts of one id apart."""
    odd = (2 * (np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts)) + 1).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * odd)])
    return ((sums[words.first[1:]] - sums[words.first[:-1]]) >> np.uint64(45)).astype(np.int64)


def _pieces(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for lo, hi, words in word_blocks(batch.column("text")):
                at = words.gram_starts(window)
                if not len(at):
                    continue
                seeds, prints = words.grams(SEED), words.grams(window)[at]
                # A window that stands twice in a document travels once.
                row = np.searchsorted(words.first, at, "right") - 1
                once = np.sort(np.unique(mix(prints + row.astype(np.uint64) * ODD), return_index=True)[1])
                at, prints = at[once], prints[once]
                best, where = seeds[at], at.copy()
                for j in range(1, window - SEED + 1):
                    other = seeds[at + j]
                    less = other < best
                    best = np.where(less, other, best)
                    where = np.where(less, at + j, where)
                cut = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (at[1:] > at[:-1] + 1)]))
                row = np.searchsorted(words.first, at[cut], "right") - 1
                place = at[cut] - words.first[row] + (versions(words)[row] << VERSION_SHIFT)
                marks = np.ascontiguousarray(prints).view(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((best[cut] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(ids[lo:hi][row]),
                        pa.array(place),
                        binary_column(marks, np.append(cut, len(at)) * PRINT),
                    ],
                    ["seed", "doc", "place", "prints"],
                )

    return run


def _factors(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The windows of the seed that the last batch ended in, with their smallest documents.
        open_seed, open_prints, open_docs = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            seed, doc, place = (batch.column(c).to_numpy() for c in ("seed", "doc", "place"))
            same = np.concatenate([[False], seed[1:] == seed[:-1]])
            rank = np.cumsum(~same)
            continues = open_seed is not None and seed[0] == open_seed
            used = same | np.append(same[1:], False) | (rank == rank[-1])
            if continues:
                used |= rank == 1
            column = batch.column("prints").filter(pa.array(used))
            seed, doc, place, rank = seed[used], doc[used], place[used], rank[used]
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            prints = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64)
            count = np.diff(offsets) // PRINT
            row = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            known = len(open_prints) if continues else 0
            key = np.concatenate([open_prints[:known], prints])
            group = np.concatenate([np.ones(known, np.int64), rank[row]])
            owner = np.concatenate([open_docs[:known], doc[row]])
            order = np.lexsort((key, group))
            key, group = key[order], group[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
            smallest = np.empty(len(key), np.int64)
            smallest[order] = owner[order][new][np.cumsum(new) - 1]
            last = np.flatnonzero(new & (group == rank[-1]))
            open_seed, open_prints, open_docs = seed[-1], key[last], owner[order[last]]
            source = smallest[known:]
            held = np.flatnonzero(owner[known:] > source)
            if not len(held):
                continue
            row, step = row[held], step[held]
            cut = np.concatenate([[True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)])
            ends = np.append(np.flatnonzero(cut)[1:], len(held)) - 1
            r = row[cut]
            base = place[r] & ((1 << VERSION_SHIFT) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[r]),
                    pa.array((place[r] >> VERSION_SHIFT).astype(np.int32)),
                    pa.array(base + step[cut]),
                    pa.array(base + step[ends] + window),
                    pa.array(source[held][cut]),
                ],
                ["doc", "version", "lo", "hi", "source"],
            )

    return run


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """The factors: words ``lo`` to ``hi`` (exclusive) of ``doc`` also stand in ``source``, a smaller id.

    Ids must be integers.  Factors of neighbouring pieces overlap; a window that stands in ``doc``
    several times is reported at its first place.
    """
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    pieces = given.where(F.col("doc").isNotNull() & F.col("text").isNotNull()).mapInArrow(_pieces(window), PIECES)
    blocks = pieces.repartition("seed").sortWithinPartitions("seed", "doc")
    return blocks.mapInArrow(_factors(window), FACTORS)


def _covered(spans: list, version: int, prints: np.ndarray, n: int, window: int) -> np.ndarray:
    """The words of one text under its factors, and under equal windows elsewhere in it."""
    starts = np.zeros(max(0, n - window + 1), bool)
    for s in spans:
        if s["version"] == version:
            starts[s["lo"] : s["hi"] - window + 1] = True
    if starts.any():
        starts = np.isin(prints, prints[starts])
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    steps[at] += 1
    steps[at + window] -= 1
    return np.cumsum(steps[:-1]) > 0


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (t.as_buffer() if t.is_valid else None for t in batch.column("text").cast(pa.binary()))
        packed = pa.array([None if t is None else zlib.compress(t, 1) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), packed], ["doc", "packed"])


def _cut(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        packed = (t.as_buffer() if t.is_valid else None for t in batch.column("packed"))
        text = pa.array([None if t is None else zlib.decompress(t) for t in packed], pa.binary()).view(pa.string())
        for lo, hi, words in word_blocks(text):
            kept, total, removed = [], words.counts, np.zeros(hi - lo, np.int64)
            data = words.data.tobytes()
            mine, prints = versions(words), words.grams(window)
            for i in range(hi - lo):
                a, b = words.first[i], words.first[i + 1]
                if a == b:
                    kept.append(b"")
                    continue
                whole = data[words.start[a] : words.end[b - 1]].split()
                if spans[lo + i]:
                    drop = _covered(spans[lo + i], mine[i], prints[a : max(a, b - window + 1)], b - a, window)
                    removed[i] = drop.sum()
                    whole = [w for w, d in zip(whole, drop.tolist(), strict=True) if not d]
                kept.append(b" ".join(whole))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").slice(lo, hi - lo),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(total.astype(np.int64)),
                    pa.array(removed),
                ],
                ["doc", "text", "n_words", "n_removed"],
            )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per input row: id, ``text`` with the kept words joined by spaces, ``n_words``, ``n_removed``."""
    found = factors(docs, id_col, text_col, window)
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("version", "lo", "hi")).alias("spans"))
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    # Texts meet their factors packed: they are a quarter of all that moves.
    packed = given.mapInArrow(_packed, "doc long, packed binary")
    out = packed.join(spans, "doc", "left").mapInArrow(
        lambda batches: _cut(batches, window), "doc long, text string, n_words long, n_removed long"
    )
    return out.withColumnRenamed("doc", id_col)
