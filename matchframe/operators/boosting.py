"""Boosted trees of all classes at once, from sums that Spark adds up.

Values become bins once, and rows travel in blocks of small integers.  One pass over the blocks gives, for every class, node,
column and bin of a level, the sum of what is left to explain and the number of rows; the driver picks the splits.  So a fit
has rounds * depth passes, however many classes there are.  What a task gives, and the driver holds for each of a bounded
number of tasks, is classes * nodes * columns * ``BINS`` pairs of numbers, whatever the rows.  A block is in memory at a time.

Each class is a booster of its own against the rest: margins F, chance 1 / (1 + exp(-2 F)), trees on the negative gradient
4 y / (1 + exp(2 y F)) for y = 1 or -1, the first on y itself with weight 1.  These are the rules of Spark's ``GBTClassifier``.
Other than there, cuts come from quantiles of all rows, and a round's rows from a hash of the row, so neither depends on how
the rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.plans.stages import shuffles_freed, staged, staged_rdd, unstage
from matchframe.shipping import ship

#: Bins of a column; the bins of two columns share a 16-bit number, so that one count serves both.
BINS = 32
#: Quantiles that are looked at for cuts, and their greatest error in rank.
LOOKS, RANK_ERROR = 512, 0.0005
#: Of many rows: rows that are sorted at a time, and the ranks that are kept of them and of a task.
CHUNK_ROWS, CHUNK_RANKS, TASK_RANKS = 1 << 17, 4096, 2048
#: Rounds between two stagings of the margins, and where rows are few; rows of a task from which on there are more tasks, and at most.
FOLD, FEW_FOLD, LEAST_ROWS, MOST_ROWS = 4, 10, 1 << 15, 1 << 19
#: Rows from which on a level's sums come from one child of every node, margins are staged more often and quantiles are of sorted chunks.
HALVED_ROWS = 1 << 19
BLOCK = "n int, bins binary, y binary, w binary, key binary, f binary"


@dataclass(frozen=True)
class Trees:
    """One class's trees, a row each: split column, threshold and children of every node, and what the node alone predicts."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @property
    def base(self) -> float:
        return float(self.value[:, 0].sum())

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Rows by columns: the changes of value at the splits on each column along every tree's path."""
        n, width = x.shape
        out = np.zeros(n * width)
        tree, row = np.arange(len(self.feature)), np.arange(n)[:, None]
        node = np.zeros((n, len(tree)), np.int64)
        for _ in range(self.depth):
            column = self.feature[tree, node]
            to = np.where(x[row, column] <= self.threshold[tree, node], self.left[tree, node], self.right[tree, node])
            change = self.value[tree, to] - self.value[tree, node]
            out += np.bincount((row * width + column).ravel(), change.ravel(), n * width)
            node = to
        return out.reshape(n, width)


@dataclass(frozen=True)
class Booster:
    """One class against the rest: trees whose node ``i`` has the children ``2 i + 1`` and ``2 i + 2``, and each column's gain."""

    columns: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gains: np.ndarray
    depth: int

    @property
    def trees(self) -> Trees:
        """Nodes that are not split lead to themselves."""
        own = np.tile(np.arange(self.feature.shape[1]), (len(self.feature), 1))
        split = np.isfinite(self.threshold)
        return Trees(self.feature, self.threshold, np.where(split, 2 * own + 1, own), np.where(split, 2 * own + 2, own), self.value, self.depth)

    def leaves(self, tree: int, columns: Sequence[np.ndarray]) -> np.ndarray:
        """What one tree predicts for rows whose values are given by column."""
        return self.value[tree, 2**self.depth - 1 :].take(path(columns, self.feature[tree], self.threshold[tree], self.depth))

    def margins(self, columns: Sequence[np.ndarray], rows: int) -> np.ndarray:
        out = np.zeros(rows)
        for tree in range(len(self.value)):
            out += self.leaves(tree, columns)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds arrays of two for the rest and the class: ``_rawp`` (margins) and ``_prob``.  A missing value counts as 0."""
        margin = F.col("_m")[0]
        out = with_margins(df, [self], "_m").withColumn("_rawp", F.array(-margin, margin))
        return out.withColumn("_prob", F.array(chance(-margin), chance(margin))).drop("_m")


def chance(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-2.0 * margin))


def turns(columns: Sequence[np.ndarray], feature: np.ndarray, cut: np.ndarray, depth: int) -> list[np.ndarray]:
    """Of every node above the leaves, which rows would turn right there; values up to a cut go left."""
    return [~(columns[feature[node]] <= cut[node]) for node in range(2**depth - 1)]


def places(right: Sequence[np.ndarray], depth: int) -> np.ndarray:
    """Places of rows among the ``2 ** depth`` nodes of a level, from the ``turns`` of the nodes above it."""
    place, taken = None, []
    for level in range(depth):
        nodes = right[2**level - 1 : 2 ** (level + 1) - 1]
        # Neighbours differ in the last turn: that one chooses between them, then the one before it among those chosen.
        for turn in reversed(taken):
            nodes = [a ^ ((a ^ b) & turn) for a, b in zip(nodes[::2], nodes[1::2], strict=True)]
        taken.append(nodes[0])
        place = nodes[0].astype(np.uint8 if depth <= 8 else np.int64) if place is None else 2 * place + nodes[0]
    return place


def path(columns: Sequence[np.ndarray], feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Places of rows among the ``2 ** depth`` nodes of a level; values up to a cut go left."""
    if not depth:
        return np.zeros(len(columns[feature[0]]), np.uint8)
    return places(turns(columns, feature, cut, depth), depth)


def cells(columns: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])


def by_column(given: pa.Array, rows: int) -> np.ndarray:
    """Columns by rows of a list column whose lists are equally long."""
    return np.ascontiguousarray(given.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).T)


def with_margins(df: DataFrame, boosters: Sequence[Booster], name: str) -> DataFrame:
    """Adds the array ``name`` with every booster's margin.  A missing value counts as 0."""
    ship(df.sparkSession)
    rows = df.withColumn(name, cells(boosters[0].columns))
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = by_column(batch.column(batch.num_columns - 1), n)
            m = np.column_stack([b.margins(x, n) for b in boosters])
            at = np.arange(0, m.size + 1, len(boosters), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(at, m.ravel())], batch.schema.names)

    return rows.mapInArrow(run, f"{given}, {name} array<double>")


def moved_margins(boosters: Sequence[Booster], own: np.ndarray, given: np.ndarray, columns: Sequence[int]) -> np.ndarray:
    """Margins by booster, moved column and row, where one column at a time has ``given`` values.  Arrays are columns by rows.

    Only the trees that split on a column are walked again for it.
    """
    n = own.shape[1]
    out = np.zeros((len(boosters), len(columns), n))
    at = {j: i for i, j in enumerate(columns)}
    for k, b in enumerate(boosters):
        plain = np.zeros(n)
        for tree, leaf in enumerate(b.value[:, 2**b.depth - 1 :]):
            feature, cut = b.feature[tree], b.threshold[tree]
            right = turns(own, feature, cut, b.depth)
            before = leaf.take(places(right, b.depth)) if b.depth else leaf[0]
            plain += before
            for j in np.unique(feature[np.isfinite(cut)]):
                if j in at:
                    mixed = [~(given[j] <= cut[node]) if feature[node] == j else r for node, r in enumerate(right)]
                    out[k, at[j]] += leaf.take(places(mixed, b.depth)) - before
        out[k] += plain
    return out


def moved_losses(boosters: Sequence[Booster], columns: Sequence[int], floor: float):
    """Per batch and repetition, of columns ``rep``, ``target``, own and given values: rows, and the sum of log losses for each moved column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rep, target = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            own, given = (by_column(batch.column(i), n) for i in (2, 3))
            p = np.clip(1.0 / (1.0 + np.exp(-2.0 * moved_margins(boosters, own, given, columns))), floor, 1.0)
            p /= p.sum(0)
            loss = -np.log(np.maximum(p[target.astype(int), :, np.arange(n)], floor))
            for r in np.unique(rep):
                here = rep == r
                sums = [pa.array([int(r)] * len(columns), pa.int32()), pa.array(columns, pa.int32()), pa.array(loss[here].sum(0))]
                yield pa.RecordBatch.from_arrays([*sums, pa.array([int(here.sum())] * len(columns), pa.int64())], ["rep", "_f", "l", "n"])

    return run


# --- fitting ---------------------------------------------------------------


def _ranked(values: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of columns by values, in any order, those at ``places`` (parts of the weight) of each column's order.  ``weights`` are by value."""
    out = np.empty((len(values), len(places)))
    for j, column in enumerate(values):
        order = column.argsort(kind="stable")
        upto = weights[order].cumsum()
        out[j] = column[order[np.minimum(np.searchsorted(upto, places * upto[-1], side="right"), len(order) - 1)]]
    return out


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, and evenly ranked values of each column: those of chunks that are sorted, ranked once more.

    A value's rank is off by half a step of ``CHUNK_RANKS`` and half a step of ``TASK_RANKS`` at most, less than ``RANK_ERROR``.
    """
    held, chunks, weights, total = [], [], [], 0
    even = lambda n: np.r_[0.0, (np.arange(1, n) + 0.5) / n]

    def close() -> None:
        x = np.sort(np.concatenate(held, 1), 1)
        n = x.shape[1]
        chunks.append(x[:, (even(min(n, CHUNK_RANKS)) * n).astype(int)])
        weights.append(np.full(chunks[-1].shape[1], n / chunks[-1].shape[1]))
        held.clear()

    for batch in batches:
        if batch.num_rows:
            held.append(by_column(batch.column(0), batch.num_rows))
            total += batch.num_rows
            if sum(x.shape[1] for x in held) >= CHUNK_ROWS:
                close()
    if held:
        close()
    if chunks:
        found = _ranked(np.concatenate(chunks, 1), np.concatenate(weights), even(TASK_RANKS))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["n", "v"])


def _cuts(rows: DataFrame, columns: Sequence[str], count: int) -> list[np.ndarray]:
    """At most ``BINS`` - 1 cuts a column: every value of columns with few of them, else quantiles.  Runs a job."""
    asked = [i / LOOKS for i in range(LOOKS)]
    if count < HALVED_ROWS:
        looks = rows.approxQuantile(list(columns), asked, RANK_ERROR)
    else:
        tasks = rows.select(F.array(*columns).alias("x")).mapInArrow(_sketch, "n long, v binary").collect()
        weights = np.concatenate([np.full(TASK_RANKS, r["n"] / TASK_RANKS) for r in tasks])
        looks = _ranked(np.concatenate([np.frombuffer(r["v"]).reshape(len(columns), -1) for r in tasks], 1), weights, np.array(asked))
    out = []
    for found in looks:
        values = np.unique(np.array(found, float))
        if len(values) >= BINS:
            ranked = np.array(found, float)
            values = np.unique(ranked[np.linspace(0, len(ranked), BINS + 1)[1:-1].astype(int)])
        out.append(values)
    return out


def _blocks(cuts: list[np.ndarray], classes: int):
    """Batches of rows as one row each: bins of two columns in one number, outcomes, weights, keys and margins of 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = by_column(batch.column(0), n)
            bins = np.zeros((len(cuts) + len(cuts) % 2, n), np.uint16)
            for j, c in enumerate(cuts):
                bins[j] = np.searchsorted(c, x[j], side="left")
            pairs = bins[0::2] + BINS * bins[1::2]
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            w = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            w = b"" if (w == 1).all() else w.tobytes()
            key = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            one = [pairs.tobytes(), y.tobytes(), w, key.tobytes(), np.zeros((classes, n)).tobytes()]
            names = ["n", "bins", "y", "w", "key", "f"]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([b], pa.binary()) for b in one]], names)

    return run


def _drawn(key: np.ndarray, number: int, share: float, seed: int) -> np.ndarray:
    """Whether rows are seen in a round: a mixed hash of their key (splitmix64) against the share."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + number * 0xD1342543DE82EF95) % 2**64)
    z = key.view(np.uint64) + start
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) < np.uint64(min(int(share * 2**64), 2**64 - 1))


@dataclass
class _Round:
    """The trees of one round, by class and node; cuts are bins (one byte, as the bins), ``BINS`` where a node is not split."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def add(self, columns: Sequence[np.ndarray], f: np.ndarray, depth: int) -> None:
        for k in range(len(f)):
            f[k] += self.value[k, 2**depth - 1 :].take(path(columns, self.feature[k], self.cut[k], depth))


class _Columns:
    """Columns of bins, unpacked from their pairs when they are asked for."""

    def __init__(self, pairs: np.ndarray) -> None:
        self.pairs, self.made = pairs, {}

    def __getitem__(self, j: int) -> np.ndarray:
        if j not in self.made:
            pair = self.pairs[j // 2]
            self.made[j] = (pair >> (BINS.bit_length() - 1) if j % 2 else pair & (BINS - 1)).astype(np.uint8)
        return self.made[j]


def _open(block: tuple, classes: int):
    n, bins, y, w, key, f = block
    return n, np.frombuffer(bins, np.uint16).reshape(-1, n), np.frombuffer(y, np.int8), np.frombuffer(w), np.frombuffer(key, np.int64), np.frombuffer(f).reshape(classes, n)


def _folded(pending: list[_Round], classes: int, depth: int):
    """Blocks with the margins of the pending rounds added."""

    def run(blocks: Iterable[tuple]) -> Iterator[tuple]:
        for block in blocks:
            _, pairs, _, _, _, f = _open(block, classes)
            f, columns = f.copy(), _Columns(pairs)
            for r in pending:
                r.add(columns, f, depth)
            yield (*block[:-1], f.tobytes())

    return run


def _sums(pending: list[_Round], now: _Round, level: int, number: int, classes: int, depth: int, share: float, seed: int, counted: np.ndarray):
    """Per class, column, node of the level and bin: the sum of what is left to explain, and the weight of the rows.

    ``counted`` names the nodes that are wanted of each class, in their order.
    """
    slots = counted.shape[1]
    size = slots * BINS * BINS
    slot = np.full((classes, 2**level), -1, np.int64)
    for k, nodes in enumerate(counted):
        slot[k, nodes] = np.arange(slots) * BINS * BINS

    def run(blocks: Iterable[tuple]) -> Iterator[bytes]:
        total = None
        for block in blocks:
            n, pairs, y, w, key, f = _open(block, classes)
            if pending or level:
                f, columns = f.copy(), _Columns(pairs)
                for r in pending:
                    r.add(columns, f, depth)
            if total is None:
                total = np.zeros((2, classes, len(pairs), size))
            seen = _drawn(key, number, share, seed) if share < 1 else np.ones(n, bool)
            each = []
            for k in range(classes):
                if level:
                    first = slot[k].take(path(columns, now.feature[k], now.cut[k], level))
                    rows = np.flatnonzero((first >= 0) & seen)
                elif not k:
                    rows = np.flatnonzero(seen)
                sign = np.where(y.take(rows) == k, 1.0, -1.0)
                left = sign if number == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * f[k].take(rows)))
                start = first.take(rows) if slots > 1 else 0
                weight = w.take(rows) if len(w) else None
                each.append((k, left if weight is None else left * weight))
                if not level and k < classes - 1:
                    continue
                for j, pair in enumerate(pairs.take(rows, 1)):
                    at = pair.astype(np.intp)
                    if slots > 1:
                        at += start
                    for kk, one in each:
                        total[0, kk, j] += np.bincount(at, one, size)
                    # Before the first split the rows are the same for all classes.
                    total[1, each[0][0], j] += np.bincount(at, weight, size)
                each = []
        if total is not None:
            if not level:
                total[1, 1:] = total[1, :1]
            grid = total.reshape(*total.shape[:3], slots, BINS, BINS)
            # A pair's lower number is its first column's bin.
            each = np.stack([grid.sum(-2), grid.sum(-1)], 3).reshape(2, classes, -1, slots, BINS)
            yield each.tobytes()

    return run


def _all_nodes(found: np.ndarray, counted: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The sums of a level from those of one child of every node and the sums ``before`` of the level above."""
    out = np.empty((*found.shape[:3], 2 * counted.shape[1], BINS))
    for k, nodes in enumerate(counted):
        out[:, k, :, nodes] = np.moveaxis(found[:, k], 2, 0)
        out[:, k, :, nodes ^ 1] = np.moveaxis(before[:, k] - found[:, k], 2, 0)
    return out


def _split(now: _Round, gains: np.ndarray, sums: np.ndarray, width: int, level: int, rate: float) -> np.ndarray:
    """Sets the splits of a level and the values of the nodes below: the greatest fall of the squared error, ties to the first.

    Gives, by class and node, the place of the child with fewer rows.
    """
    s, c = sums[:, :, :width].cumsum(-1)
    fewer = np.tile(2 * np.arange(2**level) + 1, (s.shape[0], 1))
    for k in range(s.shape[0]):
        for p in range(2**level):
            node = 2**level - 1 + p
            below = 2 * node + 1
            whole, rows = s[k, 0, p, -1], c[k, 0, p, -1]
            if not level:
                now.value[k, 0] = rate * whole / rows if rows > 0 else 0.0
            now.value[k, below : below + 2] = now.value[k, node]
            left, there = s[k, :, p, :-1], c[k, :, p, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left**2 / there + (whole - left) ** 2 / (rows - there) - whole**2 / rows
            gain = np.where((there > 0) & (rows - there > 0), gain, 0.0)
            j, b = np.unravel_index(gain.argmax(), gain.shape)
            if not gain[j, b] > 1e-12 * max(rows, 1.0):
                continue
            now.feature[k, node], now.cut[k, node] = j, b
            now.value[k, below] = rate * left[j, b] / there[j, b]
            now.value[k, below + 1] = rate * (whole - left[j, b]) / (rows - there[j, b])
            gains[k, j] += gain[j, b]
            fewer[k, p] -= there[j, b] <= rows / 2
    return fewer


def fit_boosters(
    df: DataFrame, columns: Sequence[str], classes: int = 3, *, label: str = "target", weight: str | None = None, rounds: int = 150, depth: int = 3,
    rate: float = 0.05, share: float = 0.9, seed: int = 42
) -> list[Booster]:
    """A booster for each class 0, 1, ... of ``label`` against the others.  Rows with the same values in all columns are drawn together.

    No rows give margins of 0.  A column with one value is never split.  Runs a count, a job for the cuts, one for the blocks, one for
    every level of every round, and one for every ``FOLD`` rounds (``FEW_FOLD`` of few rows) that stages the margins.  From ``HALVED_ROWS`` rows on, unweighted
    rows are only added up for the smaller child of every node; what is left of the node's own sums is the other's.
    """
    spark, columns = df.sparkSession, tuple(columns)
    ship(spark)
    plain = df.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_x{j}") for j, c in enumerate(columns)])
    cuts = _cuts(plain, plain.columns, plain.count()) if columns else []
    given = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    key = F.xxhash64(*[F.col(c) for c in df.columns])
    rows = df.select(cells(columns).alias("x"), F.col(label).cast("int").alias("y"), given.alias("w"), key.alias("key"))
    blocks = staged(rows.mapInArrow(_blocks(cuts, classes), BLOCK))
    n = blocks.agg(F.sum("n").cast("long")).first()[0] or 0
    parts = max(1, min(n // LEAST_ROWS, 2 * spark.sparkContext.defaultParallelism), math.ceil(n / MOST_ROWS))
    if n:
        with shuffles_freed(spark):
            dealt = staged(blocks.repartition(parts))
        unstage(blocks)
        blocks = staged_rdd(spark, dealt.rdd.map(tuple))
        unstage(dealt)
    # Differences of weights that are no whole numbers would leave remainders where no row is.
    halved = weight is None and n >= HALVED_ROWS
    fold = FOLD if n >= HALVED_ROWS else FEW_FOLD
    nodes = 2 ** (depth + 1) - 1
    gains, kept, pending = np.zeros((classes, len(columns))), [], []
    for number in range(rounds if n else 1):
        shape = (classes, nodes)
        now = _Round(np.zeros(shape, np.int64), np.full(shape, BINS, np.uint8), np.zeros(shape))
        for level in range(depth):
            counted = fewer if level and halved else np.tile(np.arange(2**level), (classes, 1))
            found = blocks.mapPartitions(_sums(pending, now, level, number, classes, depth, share, seed, counted)).collect() if n else []
            if not found:
                break
            got = sum(np.frombuffer(v) for v in found).reshape(2, classes, -1, counted.shape[1], BINS)
            sums = _all_nodes(got, counted, sums) if level and halved else got
            fewer = _split(now, gains, sums, len(columns), level, rate if number else 1.0)
        kept.append(now)
        pending.append(now)
        if len(pending) == fold and number < rounds - 1:
            old, blocks, pending = blocks, staged_rdd(spark, blocks.mapPartitions(_folded(pending, classes, depth))), []
            unstage(old)
    if n:
        unstage(blocks)
    # Bins become values again: bin b holds the values up to cut b.
    limits = np.full((max(len(columns), 1), BINS + 1), np.inf)
    for j, c in enumerate(cuts):
        limits[j, : len(c)] = c
    out = []
    for k in range(classes):
        feature, cut = (np.stack([getattr(r, a)[k] for r in kept]) for a in ("feature", "cut"))
        out.append(Booster(columns, feature, limits[feature, cut], np.stack([r.value[k] for r in kept]), gains[k], depth))
    return out
