"""Documents with nearly the same word n-grams, by a blocked sparse matrix product.

The incidence matrix A has a row per distinct n-gram set and a column per n-gram;
A times its transpose holds the overlaps.  Only entries that can reach the bound
are opened, and they are computed block by block:

1. A row's set becomes a digest; rows with equal sets are one node.
2. Size-derived bounds: sets of sizes x <= y with overlap o are linked when
   100 * o >= T * (x + y - o), so x >= T * y / 100 and two linked sets share an
   n-gram among the first ``size - ceil(T * size / 100) + 1`` of each in any fixed
   order.  The order is by frequency class, then by hash: n-grams that a count
   sketch over the whole corpus finds common come last.  Only these first columns
   are multiplied to open pairs.
3. A column block holds the sets of one such n-gram; columns of a single set go.  A
   pair stays open if the sizes agree and the parity bitmaps of the sets differ in no
   more bits than the sets may differ in elements: an exact bound, as each differing
   element flips one bit.  Of a block, the components of the open pairs leave, as stars.
   A column whose estimated count passes ``BLOCK_ROWS`` is cut into row blocks.
4. The components of all stars hold every linked pair.  Each is cut into row blocks of
   bounded size, and each pair of row blocks is multiplied: overlap counts are
   accumulated over chunks of columns, entries below the bound are discarded, and the
   components of the true links leave as stars.  No pair list is ever emitted.
5. The components of the true links give the answer; the smallest id of each
   node comes first into its component.

The product inside one component grows with the square of its row blocks, the
data moved with the number of row blocks; other parts grow with the input.  The
sketch is broadcast; it has ``SKETCH`` counters whatever the input.

Cases: null or empty text has an empty set and no links; fewer than ``n`` words
are one n-gram; rows with a null id get a null component and link nothing; rows
of one id are one document in the result, its texts linked through the id; an
empty table gives an empty result; other columns are not read.  N-grams are 64-bit
hashes and nodes 64-bit digests, so among m sets m^2 / 2^65 pairs are mistaken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.llm.groups import bounded, components, spread_back
from matchframe.llm.shared import share
from matchframe.llm.words import Words, mix, word_blocks
from matchframe.plans.stages import staged
from matchframe.shipping import ship

SKETCH, SLICE = 1 << 20, 1 << 16
BLOCK_ROWS, BLOCK_SETS, BLOCK_CELLS = 20_000, 1_000, 1_500_000
COLUMNS = 2_048


def gram_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Each row's distinct n-gram hashes, sorted."""
    grams = words.grams(n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            sums = np.zeros(1, np.uint64)
            for h in words.hash[a:b]:
                sums = sums * np.uint64(0x2545F4914F6CDD1D) + h
            yield mix(sums + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def node_of(grams: np.ndarray) -> int:
    return int.from_bytes(blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profile(n: int, percent: int):
    """(doc, node, size, bits) per row, and this task's sketch in slices (node null, slice number in doc, counts in bits)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for lo, hi, words in word_blocks(batch.column("text"), lower=True):
                nodes, sizes, bits, every = [], [], [], []
                for grams in gram_sets(words, n):
                    nodes.append(node_of(grams))
                    sizes.append(len(grams))
                    bits.append(_bitmap(grams, percent))
                    every.append(grams)
                bins = (np.concatenate(every) & np.uint64(SKETCH - 1)).astype(np.int64)
                sketch += np.bincount(bins, minlength=SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(lo, hi - lo), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array(bits, pa.binary()),
                    ],
                    ["doc", "node", "size", "bits"],
                )
        if sketch.any():
            slices = [_packed(sketch[i : i + SLICE]) for i in range(0, SKETCH, SLICE)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(slices)), pa.int64()), pa.nulls(len(slices), pa.int64()),
                    pa.nulls(len(slices), pa.int64()), pa.array(slices, pa.binary()),
                ],
                ["doc", "node", "size", "bits"],
            )

    return run


def _packed(counts: np.ndarray) -> bytes:
    """One task's counters are small numbers, so they shrink to an eighth."""
    return zlib.compress(counts.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def _add_slices(part: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.int64)
    for counts in part["bits"]:
        total += _unpacked(counts)
    return pd.DataFrame({"doc": part["doc"].iloc[:1], "bits": [_packed(total)]})


def _sum_sketch(profile: DataFrame) -> np.ndarray:
    """The whole corpus's counters: SKETCH numbers, added slice by slice in tree rounds of 64 tasks' slices."""
    slices = profile.where("node IS NULL").select("doc", "bits", F.spark_partition_id().alias("task"))
    tasks = slices.agg(F.max("task")).first()[0]
    while tasks:
        tasks //= 64
        slices = slices.withColumn("task", F.floor(F.col("task") / 64).cast("int")).groupBy("task", "doc").applyInPandas(
            lambda key, part: _add_slices(part).assign(task=key[0]), "doc long, bits binary, task int"
        )
    total = np.zeros(SKETCH, np.int64)
    for row in slices.select("doc", "bits").collect():
        total[row["doc"] * SLICE : (row["doc"] + 1) * SLICE] += _unpacked(row["bits"])
    return total


def _bitmap(grams: np.ndarray, percent: int) -> bytes:
    """Parity of the elements in each bit, with twice the bits that linked sets may differ in, or up to four times."""
    wanted = 4 * len(grams) * 2 * (100 - percent) // (100 + percent)
    bits = max(64, 1 << (max(1, 9 * wanted // 10) - 1).bit_length())
    places = ((grams >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _openers(n: int, percent: int, sketch):
    """(gram, block, node, size) for the first columns of each set; one row per block of a split column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        noise = max(1.0, counts.sum() / SKETCH)
        done: set[int] = set()
        for batch in batches:
            for _, _, words in word_blocks(batch.column("text"), lower=True):
                out: list[list] = [[], [], [], []]
                for grams in gram_sets(words, n):
                    size = len(grams)
                    node = node_of(grams)
                    if not size or node in done:
                        continue
                    done.add(node)
                    first = size - -(-percent * size // 100) + 1
                    seen = counts[(grams & np.uint64(SKETCH - 1)).astype(np.int64)]
                    level = np.maximum(0, np.log2(np.maximum(1.0, seen / noise)).astype(np.int64) - 1)
                    picked = np.argsort(level, kind="stable")[:first]
                    blocks = (np.maximum(0.0, seen[picked] - 2 * noise) // BLOCK_ROWS).astype(np.int64) + 1
                    for gram, parts in zip(grams[picked].view(np.int64).tolist(), blocks.tolist(), strict=True):
                        mine = node % parts
                        out[0] += [gram] * parts
                        out[1] += [min(mine, other) * parts + max(mine, other) for other in range(parts)]
                    copies = int(blocks.sum())
                    out[2] += [node] * copies
                    out[3] += [size] * copies
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in out], ["gram", "block", "node", "size"]
                )

    return run


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of column blocks with two different sets, each set once; rows come in block and set order."""
    names = ["gram", "block", "node", "size"]
    held, follows = np.zeros((4, 0), np.int64), False
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in names])], axis=1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(0)])]
        same = (rows[:2, 1:] == rows[:2, :-1]).all(0)
        out = rows[:, :-1][:, np.concatenate([[follows], same])[:-1] | same]
        held, follows = rows[:, -1:], bool(same[-1]) if len(same) else follows
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)
    if follows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)


class Forest:
    """Union-find over 0..n-1; the smallest number is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def stars(self, nodes: list[int]) -> Iterator[tuple[int, int]]:
        """(node, root's node) of every node that is not a root."""
        for i in range(len(nodes)):
            if self.up[i] != i:
                yield nodes[i], nodes[self.root(i)]


def _fold(bits: int, width: int, target: int) -> int:
    while width > target:
        width //= 2
        bits = (bits >> width) ^ (bits & ((1 << width) - 1))
    return bits


def _may_link(x: int, y: int, percent: int) -> int:
    """The most elements that linked sets of these sizes differ in, or -1."""
    if 100 * min(x, y) < percent * max(x, y):
        return -1
    least = -(-percent * (x + y) // (100 + percent))
    return x + y - 2 * least


def open_pairs(nodes: list[int], sizes: list[int], bits: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """The components of the pairs that the bounds leave open, as stars; the lists are in size order."""
    forest = Forest(len(nodes))
    if len(nodes) <= 32:
        maps = [(int.from_bytes(b, "big"), 8 * len(b)) for b in bits]
        for i in range(len(nodes)):
            for j in range(i + 1, len(nodes)):
                apart = _may_link(sizes[i], sizes[j], percent)
                if apart < 0:
                    break
                width = min(maps[i][1], maps[j][1])
                differ = _fold(*maps[i], width) ^ _fold(*maps[j], width)
                if differ.bit_count() <= apart:
                    forest.join(i, j)
        yield from forest.stars(nodes)
        return
    size = np.array(sizes)
    width = np.array([len(b) for b in bits])
    tables = {}
    for w in np.unique(width).tolist():
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        table = np.zeros((len(rows), w), np.uint8)
        for k, r in enumerate(rows.tolist()):
            raw = np.frombuffer(bits[r], np.uint8)
            table[k] = raw if len(raw) == w else raw[:w] ^ raw[w:]
        tables[w] = rows, table
    for i in range(len(nodes)):
        rows, table = tables[int(width[i])]
        reach = int(np.searchsorted(size, 100 * size[i] // percent, "right"))
        lo, hi = np.searchsorted(rows, i + 1), np.searchsorted(rows, reach)
        if lo >= hi:
            continue
        mine = table[np.searchsorted(rows, i)]
        differ = np.bitwise_count(table[lo:hi] ^ mine).sum(1, dtype=np.int64)
        total = size[rows[lo:hi]] + size[i]
        apart = total - 2 * -(-percent * total // (100 + percent))
        for j in rows[lo:hi][differ <= apart].tolist():
            forest.join(i, j)
    yield from forest.stars(nodes)


def _open(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sizes, bits = None, [], [], []

        def closed() -> list[tuple[int, int]]:
            return list(open_pairs(nodes, sizes, bits, percent)) if len(nodes) > 1 else []

        for batch in batches:
            found = []
            keys = zip(batch.column("gram").to_pylist(), batch.column("block").to_pylist(), strict=True)
            rest = [batch.column(c).to_pylist() for c in ("node", "size", "bits")]
            for key, node, size, bit in zip(keys, *rest, strict=True):
                if key != now:
                    found += closed()
                    now, nodes, sizes, bits = key, [], [], []
                nodes.append(node)
                sizes.append(size)
                bits.append(bit)
            yield _pairs(found)
        yield _pairs(closed())

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"]
    )


def _sets(n: int):
    """The set of each row whose text still has the expected node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = batch.column("node").to_pylist()
            for lo, hi, words in word_blocks(batch.column("text"), lower=True):
                rows, sets = [], []
                for i, grams in enumerate(gram_sets(words, n)):
                    if node_of(grams) == expected[lo + i]:
                        rows.append(lo + i)
                        sets.append(grams.tobytes())
                picked = batch.select(["node", "cluster", "blocks"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(sets, pa.binary())], ["node", "cluster", "blocks", "grams"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs, accumulated over chunks of the columns that both sides have."""
    a, b = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets, cells in ((left, a), (right, b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.searchsorted(columns, cells)
        inside = place < len(columns)
        inside[inside] = columns[place[inside]] == cells[inside]
        order = np.argsort(place[inside], kind="stable")
        sides.append((place[inside][order], row[inside][order], len(sets)))
    for lo in range(0, len(columns), COLUMNS):
        dense = []
        for place, row, rows in sides:
            x, y = np.searchsorted(place, (lo, lo + COLUMNS))
            block = np.zeros((rows, min(COLUMNS, len(columns) - lo)), np.float32)
            block[row[x:y], place[x:y] - lo] = 1
            dense.append(block)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _links(percent: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("node")
        sides = [part[part["side"] == s] for s in (0, 1)] if key[1] != key[2] else [part, part]
        left, right = ([np.frombuffer(g, np.uint64) for g in side["grams"]] for side in sides)
        found: list[tuple[int, int]] = []
        if left and right:
            shared = overlaps(left, right)
            total = np.array([len(g) for g in left])[:, None] + np.array([len(g) for g in right])[None, :]
            linked = 100 * shared >= percent * (total - shared)
            nodes = [side["node"].to_numpy() for side in sides]
            # In node order, so that a component's root is its smallest node.
            every = np.unique(part["node"].to_numpy())
            place = [np.searchsorted(every, x) for x in nodes]
            forest = Forest(len(every))
            i, j = np.nonzero(linked)
            for x, y in zip(place[0][i].tolist(), place[1][j].tolist(), strict=True):
                forest.join(x, y)
            found = list(forest.stars(every.tolist()))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``.  Runs jobs that stage the intermediate steps."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    profile = staged(given.mapInArrow(_profile(n, percent), "doc long, node long, size long, bits binary"))
    sketch = share(spark, _sum_sketch(profile))
    rows = profile.where("node IS NOT NULL").select("doc", "node", "size")
    filled = profile.where("size > 0 AND doc IS NOT NULL")
    nodes = filled.groupBy("node").agg(F.min("doc").alias("doc"), F.max("size").alias("size"))

    openers = given.where("doc IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _openers(n, percent, sketch), "gram long, block long, node long, size long"
    )
    place = ["gram", "block", "size", "node"]
    met = openers.repartition("gram", "block").sortWithinPartitions(*place).mapInArrow(_met, openers.schema)
    bits = filled.groupBy("node").agg(F.any_value("bits").alias("bits"))
    lists = met.join(bits, "node").repartition("gram", "block").sortWithinPartitions(*place)
    clusters = components(lists.mapInArrow(_open(percent), "a long, b long"))

    sized = clusters.join(nodes, "node").select("node", "doc", "size", F.col("label").alias("cluster"))
    blocks = sized.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_CELLS)).cast("long").alias("blocks")
    )
    active = bounded(sized.join(blocks, "cluster"))
    sets = given.join(active, "doc").mapInArrow(_sets(n), "node long, cluster long, blocks long, grams binary")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = sets.withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select(
        "node", "cluster", "grams", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
    )
    links = dealt.groupBy("cluster", "x", "y").applyInPandas(_links(percent), "a long, b long")

    same_id = rows.where("doc IS NOT NULL AND size > 0").select("doc", "node").distinct()
    first = same_id.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc", "a")
    versions = staged(first.join(same_id, "doc").select("a", F.col("node").alias("b")))
    labels = components(links if versions.isEmpty() else links.union(versions))
    least = labels.join(nodes, "node").groupBy("label").agg(F.min("doc").alias("least"))
    verdict = nodes.join(labels, "node", "left").join(least, "label", "left")
    verdict = verdict.select("node", F.coalesce("least", "doc").alias("least"))
    out = spread_back(rows, verdict, "node", F.col("doc"))
    whole = F.when((F.col("size") > 0) & F.col("doc").isNotNull(), F.col("least")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), whole.alias("component_id"))
