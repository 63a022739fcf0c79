"""Sampled SentencePiece segmentations without replacement, and decoding.

A text is a sequence of units, one for each space-separated part with a space
mark in front; pieces do not cross units.  Each unit has a lattice: nodes between
its bytes, an edge for each vocabulary piece, and byte pieces for characters that
are no piece.  Edge scores give every segmentation a probability; backward sums
over the lattice turn them into exact probabilities of each next piece.

Gumbel top-k, top down: the whole space of a text's segmentations gets a Gumbel
value G as its maximum.  Walking down, the next piece that holds the maximum is
drawn by its probability and inherits G, and each piece not taken roots a subtree
whose maximum is a Gumbel value with its log-probability, truncated at G.  The
search is A* with these exact maxima: the best open subtree is entered next, and
its walk ends in the next best segmentation.  So the first ``samples`` walks emit
distinct segmentations, a sample without replacement.  With kappa, the best value
left open, a segmentation of log-probability p has the inclusion score
1 - exp(-exp(p - kappa)).

The subtrees of a walk lose mass quickly, and the uniform numbers have 53 bits, so
a Gumbel value exceeds its log-probability by ``SLACK`` at most: subtrees that lie
further below the values in use cannot come up, and are not drawn.  Texts whose
values lie lower get all subtrees drawn.

All draws are hashes of (seed, row key, walk, unit, place), so a row's samples do
not depend on its partition, its neighbours or a retry.  All rows of a block walk
side by side in NumPy; a task keeps the lattices of its distinct units, up to
``REMEMBER`` nodes.

Scores: a unigram model's own (``scores="model"``), or, as the given vocabulary
holds merge ranks, -log(rank + 10) (``scores="rank"``).  The model file is read where
the plan is made and broadcast; its size is the vocabulary's.

Cases: a null text has no segmentation; an empty text has one, of no pieces, with
score 1; fewer than ``samples`` possible segmentations are all emitted with score 1;
a literal space mark in a text is coded by byte pieces, so decoding is exact for
every text; null keys and repeated rows are drawn by key like others; an empty table
gives an empty result; columns named like the results are replaced, all others pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.llm.shared import share
from matchframe.llm.words import _hashes, mix, row_blocks
from matchframe.shipping import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, BLOCK, SLACK, DEPTH, REMEMBER, SLOTS = "▁", 1 << 18, 37.0, 45.0, 400_000, 1 << 20
KEY = "__sample_key"
SEGMENTATIONS = "array<struct<ids:binary,n_pieces:bigint,log_prob:double,inclusion:double>>"
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@dataclass
class Vocabulary:
    """A trie over piece bytes (the mark is a space), pieces by id, and scores."""

    slots: np.ndarray  # node * 256 + byte of each edge in an open hash table, -1 where empty
    targets: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    surface: list[bytes]
    byte_piece: np.ndarray
    byte_score: float

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node, or -1."""
        key = node * 256 + byte
        at = _slot(key)
        found = self.slots[at]
        out = np.where(found == key, self.targets[at], -1)
        missed = np.flatnonzero((found != key) & (found >= 0))
        while len(missed):
            at[missed] = (at[missed] + 1) % SLOTS
            found = self.slots[at[missed]]
            hit = found == key[missed]
            out[missed[hit]] = self.targets[at[missed[hit]]]
            missed = missed[~hit & (found >= 0)]
        return out


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * _A) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _hash_table(edges: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys, values = (np.fromiter(x, np.int64, len(edges)) for x in (edges.keys(), edges.values()))
    slots, targets = np.full(SLOTS, -1, np.int64), np.full(SLOTS, -1, np.int32)
    at = _slot(keys)
    while len(keys):
        # The first edge that wants an empty slot gets it; the others move on.
        first = np.zeros(len(keys), bool)
        first[np.unique(at, return_index=True)[1]] = True
        placed = first & (slots[at] < 0)
        slots[at[placed]], targets[at[placed]] = keys[placed], values[placed]
        keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) % SLOTS
    return slots, targets


def read_model(path: str = MODEL, scores: str = "rank") -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    surface, score, byte_piece = [b""] * size, np.zeros(size), np.full(256, -1, np.int32)
    edges: dict[int, int] = {}
    piece = [-1]
    normal = []
    for i in range(size):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_piece[int(text[3:5], 16)] = i
            surface[i] = bytes([int(text[3:5], 16)])
        elif not model.is_control(i) and not model.is_unknown(i) and text and MARK not in text[1:]:
            surface[i] = text.replace(MARK, " ").encode()
            normal.append(i)
    if (byte_piece < 0).any():
        raise ValueError("the model has no byte pieces")
    for rank, i in enumerate(normal):
        score[i] = model.get_score(i) if scores == "model" else -np.log(rank + 10)
        node = 0
        for byte in surface[i]:
            key = node * 256 + byte
            if key not in edges:
                edges[key] = len(piece)
                piece.append(-1)
            node = edges[key]
        piece[node] = i
    byte_score = float(score[normal].min()) - 1
    score[byte_piece] = byte_score
    if 4 * len(edges) > SLOTS:
        raise ValueError("the vocabulary is too large for the edge table")
    return Vocabulary(*_hash_table(edges), np.array(piece), score, surface, byte_piece, byte_score)


@dataclass
class Lattices:
    """Edges of all distinct units by source node, the shortest first, with log-probabilities of the next piece."""

    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    log_p: np.ndarray
    share: np.ndarray  # probability of the node's edges up to and including this one
    first: np.ndarray  # first edge of each node
    root: np.ndarray  # first node of each unit
    end: np.ndarray  # last node of each unit


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All integers start .. start + length - 1, range after range."""
    skip = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - skip, length)


def build_lattices(data: np.ndarray, start: np.ndarray, end: np.ndarray, v: Vocabulary) -> Lattices:
    size = end - start + 1
    root = np.cumsum(size + 1) - size - 1
    final = root + size
    n = int(final[-1]) + 1
    text = np.full(n, 0x20, np.uint8)
    inner = _ranges(root + 1, size - 1)
    text[inner] = data[_ranges(start, size - 1)]
    stop = np.repeat(final, size + 1)
    node = np.arange(n)
    lead = ((text & 0xC0) != 0x80) & (node < stop)
    wide = 1 + (text >= 0xC0).astype(np.int64) + (text >= 0xE0) + (text >= 0xF0)

    live, state, depth = np.flatnonzero(lead), None, 0
    state = np.zeros(len(live), np.int64)
    parts = []
    while len(live):
        at = live + depth
        open_ = at < stop[live]
        live, state = live[open_], state[open_]
        state = v.step(state, text[live + depth].astype(np.int64))
        open_ = state >= 0
        live, state = live[open_], state[open_]
        depth += 1
        found = v.piece[state]
        hit = found >= 0
        parts.append((live[hit], live[hit] + depth, found[hit]))
    source, target, piece = (np.concatenate([p[i] for p in parts]) for i in range(3))
    covered = np.zeros(n, bool)
    covered[source[target - source == wide[source]]] = True
    bare = np.flatnonzero(lead & ~covered)
    loose = _ranges(bare, np.minimum(wide[bare], stop[bare] - bare))
    source = np.concatenate([source, loose])
    target = np.concatenate([target, loose + 1])
    piece = np.concatenate([piece, v.byte_piece[text[loose]]])

    order = np.argsort(source, kind="stable")
    source, target, piece = source[order].astype(np.int32), target[order].astype(np.int32), piece[order].astype(np.int32)
    first = np.searchsorted(source, np.arange(n + 1))
    # Backward sums, from the units' ends: nodes at distance 1, 2, ... together, the long units first.
    back = np.full(n, -np.inf)
    back[final] = 0.0
    score = v.score[piece]
    longest = np.argsort(-size, kind="stable")
    last, far = final[longest], -size[longest]
    for distance in range(1, int(size.max()) + 1):
        nodes = last[: np.searchsorted(far, -distance, "right")] - distance
        count = first[nodes + 1] - first[nodes]
        nodes, count = nodes[count > 0], count[count > 0]
        if len(nodes):
            at = _ranges(first[nodes], count)
            back[nodes] = np.logaddexp.reduceat(score[at] + back[target[at]], np.cumsum(count) - count)
    with np.errstate(invalid="ignore"):
        log_p = score + back[target] - back[source]
    log_p[~np.isfinite(log_p)] = -np.inf
    # Shares are sums of whole numbers, so that they do not depend on what else is in the block.
    total = np.concatenate([[0], np.cumsum(np.rint(np.exp(log_p) * 2.0**34).astype(np.int64))])
    base = total[first[source]]
    share = (total[1:] - base) / np.maximum(1, total[first[source + 1]] - base)
    return Lattices(source, target, piece, log_p, share, first, root, final)


class Known:
    """The lattices of the units seen in this task; begun anew beyond ``REMEMBER`` nodes."""

    def __init__(self) -> None:
        self.hashes, self.number, self.lattices = np.zeros(0, np.uint64), np.zeros(0, np.int64), None

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, v: Vocabulary) -> tuple[Lattices, np.ndarray]:
        """Lattices, and the number of each given unit in them."""
        hashes, sample, back = np.unique(_hashes(data, start, end), return_index=True, return_inverse=True)
        if self.lattices is not None and len(self.lattices.first) > REMEMBER:
            self.__init__()
        at = np.searchsorted(self.hashes, hashes)
        inside = np.minimum(at, max(0, len(self.hashes) - 1))
        new = self.hashes[inside] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if new.any():
            made = build_lattices(data, start[sample[new]], end[sample[new]], v)
            units = 0 if self.lattices is None else len(self.lattices.root)
            self.lattices = made if self.lattices is None else _join(self.lattices, made)
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.number = np.insert(self.number, at[new], units + np.arange(int(new.sum())))
        return self.lattices, self.number[np.searchsorted(self.hashes, hashes)][back]


def _join(a: Lattices, b: Lattices) -> Lattices:
    nodes, edges = len(a.first) - 1, len(a.source)
    both = lambda x, y: np.concatenate([x, y])
    shift = np.int32(nodes)
    return Lattices(
        both(a.source, b.source + shift), both(a.target, b.target + shift), both(a.piece, b.piece), both(a.log_p, b.log_p),
        both(a.share, b.share), both(a.first[:-1], b.first + edges), both(a.root, b.root + nodes), both(a.end, b.end + nodes),
    )


def _uniform(key: np.ndarray, walk: int, unit: np.ndarray, place: np.ndarray, use: int) -> np.ndarray:
    salt = np.uint64((int(_A) * (walk + 1) + int(_D) * use) % (1 << 64))
    x = key + salt + _B * unit.astype(np.uint64) + _C * place.astype(np.uint64)
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Walk:
    """Edges of one walk per row, with each edge's unit (number in the block) and the rows' bounds."""

    edge: np.ndarray
    unit: np.ndarray
    first: np.ndarray


def _descend(lat: Lattices, node: np.ndarray, end: np.ndarray, key: np.ndarray, unit: np.ndarray, root: np.ndarray, walk: int):
    """Draw pieces from each node to its unit's end; edges in order, and how many for each start."""
    live = np.flatnonzero(node < end)
    count = np.zeros(len(node), np.int64)
    steps = []
    node = node.copy()
    while len(live):
        at = node[live]
        u = _uniform(key[live], walk, unit[live], at - root[live], 0)
        edge = lat.first[at]
        beyond = np.flatnonzero(lat.share[edge] <= u)
        while len(beyond):
            edge[beyond] += 1
            beyond = beyond[lat.share[edge[beyond]] <= u[beyond]]
        steps.append((live, edge))
        count[live] += 1
        node[live] = lat.target[edge]
        live = live[node[live] < end[live]]
    offset = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for i, (who, edge) in enumerate(steps):
        out[offset[who] + i] = edge
    return out, count


def sample_block(
    lat: Lattices, which: np.ndarray, unit_row: np.ndarray, rows: int, keys: np.ndarray, samples: int
) -> tuple[list[Walk], np.ndarray, np.ndarray]:
    """Walks 1..samples of each row; their log-probabilities (NaN where a row has no more) and kappa.

    ``which`` is the distinct unit of each unit of the block, ``unit_row`` its row.
    """
    n_units = len(which)
    first_unit = np.searchsorted(unit_row, np.arange(rows + 1))
    number = np.arange(n_units) - first_unit[unit_row]
    root, end, key = lat.root[which], lat.end[which], keys[unit_row]
    tiny = np.zeros(rows, np.int64)
    top = -np.log(-np.log(_uniform(keys, 0, tiny, tiny, 7)))
    walks: list[Walk] = []
    log_probs = np.full((samples, rows), np.nan)
    # The open subtrees: row, value, walk, place in the walk, edge.
    opened = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for walk in range(samples):
        if walk == 0:
            edge, count = _descend(lat, root, end, key, number, root, 0)
            unit = np.repeat(np.arange(n_units), count)
            first = np.searchsorted(unit_row[unit], np.arange(rows + 1))
            value, fork, alive = top, first[:-1].copy(), first_unit[1:] > first_unit[:-1]
        else:
            best = _best(opened[0], opened[1], rows)
            pick = best[best >= 0]
            r, from_walk, place, taken = opened[0][pick], opened[2][pick], opened[3][pick], opened[4][pick]
            alive = best >= 0
            if not alive.any():
                break
            value = np.full(rows, -np.inf)
            value[r] = opened[1][pick]
            base, parent_unit = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
            for w in np.unique(from_walk).tolist():
                mine = from_walk == w
                base[mine] = walks[w].first[r[mine]]
                parent_unit[mine] = walks[w].unit[place[mine]]
            before = place - base
            # After the taken piece: the rest of its unit, then all later units of the row.
            stretch = first_unit[r + 1] - parent_unit
            units = _ranges(parent_unit, stretch)
            nodes = root[units]
            nodes[np.cumsum(stretch) - stretch] = lat.target[taken]
            tail, tail_count = _descend(lat, nodes, end[units], key[units], number[units], root[units], walk)
            tail_size = np.add.reduceat(tail_count, np.cumsum(stretch) - stretch)
            size = np.zeros(rows, np.int64)
            size[r] = before + 1 + tail_size
            first = np.concatenate([[0], np.cumsum(size)])
            edge, unit = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
            for w in np.unique(from_walk).tolist():
                mine = from_walk == w
                span, to = _ranges(base[mine], before[mine]), _ranges(first[r[mine]], before[mine])
                edge[to], unit[to] = walks[w].edge[span], walks[w].unit[span]
            fork = first[:-1].copy()
            fork[r] += before
            edge[fork[r]], unit[fork[r]] = taken, parent_unit
            to = _ranges(fork[r] + 1, tail_size)
            edge[to], unit[to] = tail, np.repeat(units, tail_count)
            fork[r] += 1
            keep = np.ones(len(opened[0]), bool)
            keep[pick] = False
            opened = [x[keep] for x in opened]
        walks.append(Walk(edge, unit, first))
        steps = np.concatenate([[0], np.cumsum(np.rint(lat.log_p[edge] * 2.0**32).astype(np.int64))])
        log_probs[walk, alive] = ((steps[first[1:]] - steps[first[:-1]]) * 2.0**-32)[alive]
        row_of = np.repeat(np.arange(rows), np.diff(first))
        prefix = (steps[:-1] - steps[first[row_of]]) * 2.0**-32
        below = np.arange(len(edge)) >= fork[row_of]
        shallow = below & (prefix > -DEPTH)
        new = _siblings(lat, edge, unit, row_of, prefix, np.flatnonzero(shallow), value, keys, number, root, walk)
        wanted = samples - walk
        merged = _top(opened, new, rows, wanted)
        # Rows whose needed values may lie below what was drawn get every subtree of the walk.
        needed = _least(merged, rows, wanted)
        deep = np.flatnonzero(below & ~shallow & (needed < -DEPTH + SLACK)[row_of])
        if len(deep):
            more = _siblings(lat, edge, unit, row_of, prefix, deep, value, keys, number, root, walk)
            merged = _top(merged, more, rows, wanted)
        opened = merged
    left = _best(opened[0], opened[1], rows)
    kappa = np.where(left >= 0, opened[1][left] if len(opened[1]) else 0.0, -np.inf)
    return walks, log_probs, kappa


def _best(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The place of each row's largest value, or -1; ``row`` is sorted."""
    first = np.searchsorted(row, np.arange(rows + 1))
    out = np.full(rows, -1)
    has = np.flatnonzero(first[1:] > first[:-1])
    if len(has):
        most = np.maximum.reduceat(value, first[has])
        at = np.flatnonzero(value == np.repeat(most, first[has + 1] - first[has]))
        out[row[at][::-1]] = at[::-1]
    return out


def _top(a: list[np.ndarray], b: list[np.ndarray], rows: int, n: int) -> list[np.ndarray]:
    """The n largest values of each row of both, in row order; each is sorted by row."""
    picked = [[x[:0]] for x in b]
    for _ in range(n):
        at = _best(b[0], b[1], rows)
        at = at[at >= 0]
        for out, x in zip(picked, b, strict=True):
            out.append(x[at])
        keep = np.ones(len(b[0]), bool)
        keep[at] = False
        b = [x[keep] for x in b]
    every = [np.concatenate([x, *y]) for x, y in zip(a, picked, strict=True)]
    order = np.lexsort((-every[1], every[0]))
    row = every[0][order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return [x[order[rank < n]] for x in every]


def _least(opened: list[np.ndarray], rows: int, n: int) -> np.ndarray:
    """The smallest of each row's n values, or minus infinity if there are fewer."""
    out = np.full(rows, -np.inf)
    count = np.bincount(opened[0], minlength=rows)
    full = np.flatnonzero(count == n)
    out[full] = opened[1][np.cumsum(count)[full] - 1]
    return out


def _siblings(lat, edge, unit, row_of, prefix, at, value, keys, number, root, walk):  # noqa: PLR0913
    """The pieces not taken at the walk's places ``at``, with their subtrees' truncated Gumbel maxima."""
    source = lat.source[edge[at]]
    count = lat.first[source + 1] - lat.first[source]
    other = _ranges(lat.first[source], count)
    place = np.repeat(at, count)
    left = (other != edge[place]) & (lat.log_p[other] > -np.inf)
    other, place = other[left], place[left]
    row = row_of[place]
    phi = prefix[place] + lat.log_p[other]
    where = lat.source[other] - root[unit[place]]
    length = (lat.target[other] - lat.source[other]).astype(np.uint64)
    u = _uniform(keys[row] + _D * length, walk, number[unit[place]], where, 11)
    limit = value[row]
    # -log(exp(-limit) + E exp(-phi)), with the larger exponent taken out.
    a, b = -limit, np.log(-np.log(u)) - phi
    return [row, -np.logaddexp(a, b), np.full(len(row), walk, np.int64), place, other]


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Text bytes and their offsets of rows of ids; the first mark of a row is dropped."""
    table = np.frombuffer(b"".join(v.surface), np.uint8)
    size = np.array([len(s) for s in v.surface])
    begin = np.cumsum(size) - size
    length = size[ids]
    data = table[_ranges(begin[ids], length)]
    places = np.concatenate([[0], np.cumsum(length)])[offsets]
    heads = places[:-1][np.diff(places) > 0]
    keep = np.ones(len(data), bool)
    keep[heads[data[heads] == 0x20]] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[places]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds and row of the space-separated parts; an empty text has none."""
    space = np.flatnonzero(data == 0x20)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    start = np.sort(np.concatenate([offsets[filled], space + 1]))
    end = np.sort(np.concatenate([offsets[filled + 1], space]))
    per_row = np.diff(np.searchsorted(space, offsets))
    per_row[filled] += 1
    return start, end, np.repeat(np.arange(len(per_row)), per_row)


def encode_block(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, samples: int, v: Vocabulary, known: Known):
    """(ids, offsets) of each walk, log-probabilities and inclusion scores by walk and row."""
    rows = len(offsets) - 1
    start, end, unit_row = _units(data, offsets)
    empty = np.diff(offsets) == 0
    if not len(start):
        coded = [(np.zeros(0, np.int32), np.zeros(rows + 1, np.int64))]
        log_probs, kappa = np.zeros((1, rows)), np.full(rows, -np.inf)
    else:
        lat, which = known.of(data, start, end, v)
        walks, log_probs, kappa = sample_block(lat, which, unit_row, rows, keys, samples)
        coded = [(lat.piece[w.edge], w.first) for w in walks]
        log_probs[0, empty] = 0.0
    with np.errstate(over="ignore"):
        inclusion = -np.expm1(-np.exp(log_probs[: len(coded)] - kappa))
    return coded, log_probs[: len(coded)], inclusion


def _sample(text_at: int, key_at: int, samples: int, seed: int, vocabulary, verify: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        known = Known()
        for batch in batches:
            column = batch.column(text_at)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            key = mix(batch.column(key_at).to_numpy().view(np.uint64) + np.uint64((int(_A) * (seed + 1)) % (1 << 64)))
            for lo, hi, data, offsets in row_blocks(column, BLOCK):
                coded, log_probs, inclusion = encode_block(data, offsets, key[lo:hi], samples, v, known)
                has = ~np.isnan(log_probs) & ~missing[lo:hi]
                # Row by row, walk by walk: the ids as little-endian 32-bit numbers.
                row, walk = np.nonzero(has.T)
                begin = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in coded])])
                every = np.concatenate([ids for ids, _ in coded])
                bounds = np.stack([first for _, first in coded])
                size = bounds[walk, row + 1] - bounds[walk, row]
                ids = every[_ranges(begin[walk] + bounds[walk, row], size)].astype("<i4")
                places = np.concatenate([[0], np.cumsum(size)])
                parts = pa.StructArray.from_arrays(
                    [
                        pa.Array.from_buffers(
                            pa.binary(), len(row), [None, pa.py_buffer((places * 4).astype(np.int32)), pa.py_buffer(ids)]
                        ),
                        pa.array(size), pa.array(log_probs[walk, row]), pa.array(inclusion[walk, row]),
                    ],
                    ["ids", "n_pieces", "log_prob", "inclusion"],
                )
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has.sum(0))]).astype(np.int32), parts)
                keep = [i for i in range(batch.num_columns) if i != key_at]
                out = [batch.column(i).slice(lo, hi - lo) for i in keep] + [lists]
                names = [batch.schema.names[i] for i in keep] + ["segmentations"]
                if verify:
                    same = np.ones(hi - lo, bool)
                    text, ends = decode(ids, places, v)
                    raw, given = text.tobytes(), data.tobytes()
                    for i, r in enumerate(row.tolist()):
                        same[r] &= raw[ends[i] : ends[i + 1]] == given[offsets[r] : offsets[r + 1]]
                    out.append(pa.array(same))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def sample_segmentations(
    docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", samples: int = 2, seed: int = 0,
    path: str = MODEL, scores: str = "rank", verify: bool = True,
) -> DataFrame:
    """``docs`` with ``segmentations``, best value first, and ``round_trip``: all of them decode to the text.

    ``ids`` holds the piece ids as little-endian 32-bit numbers.  Reads the model where the plan is made.
    """
    ship(docs.sparkSession)
    vocabulary = share(docs.sparkSession, read_model(path, scores))
    given = docs.drop("segmentations", "round_trip")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    run = _sample(given.columns.index(text_col), len(given.columns), samples, seed, vocabulary, verify)
    flag = ", round_trip boolean" if verify else ""
    return given.withColumn(KEY, F.xxhash64(key_col)).mapInArrow(run, f"{schema}, segmentations {SEGMENTATIONS}{flag}")


def _decode(ids_at: int, vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids_at)
            texts = []
            for lo, hi, data, offsets in row_blocks(column, BLOCK):
                text, ends = decode(np.frombuffer(data.tobytes(), "<i4"), offsets // 4, vocabulary.value)
                raw = text.tobytes()
                texts += [raw[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            texts = [None if none else t for t, none in zip(texts, column.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode_ids(coded: DataFrame, ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """``coded`` with ``decoded``, the text of a binary column of ids; null stays null."""
    ship(coded.sparkSession)
    vocabulary = share(coded.sparkSession, read_model(path))
    given = coded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(_decode(given.columns.index(ids_col), vocabulary), f"{schema}, decoded string")
