"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of byte strings.  Greedy longest-match-first splitting
takes, again and again, the longest piece the rest of the word begins with.  At
a node v that cannot go on with the next byte, the greedy split of v's string
starts with ``popped(v)`` pieces that can be settled, and what is left of the
string is the node ``fail(v)``, from which matching goes on.  Both are computed
once, breadth first, so a word costs a number of steps linear in its length and
no piece is ever built; ``rest(v)`` is the number of pieces when the word ends.

A word is a run of bytes other than ASCII white space, matched with a space in
front of it.  Every single byte must be in the vocabulary, so every word splits.
The distinct words of a block of rows go through the automaton side by side, and
a task remembers the counts of up to ``REMEMBER`` words.

The vocabulary file is read where the plan is made; ``path`` names it.  The trie
is broadcast, and its size is that of the vocabulary.

Cases: null and empty texts have no words and no tokens; very long words cost
their length; null ids and repeated rows are counted like others; an empty table
gives an empty result; columns named like the results are replaced, all others
pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchframe.llm.words import Words, word_blocks
from matchframe.shipping import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RESULTS = ("n_words", "n_tokens")
REMEMBER = 1_000_000


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file with lines of a base64 piece and a rank."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line]


@dataclass
class Automaton:
    """Sorted edges (node * 256 + byte) with their targets, and fail, popped, rest per node."""

    edges: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    rest: np.ndarray

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node, or -1."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.targets[at], -1)


def build(pieces: Iterable[bytes]) -> Automaton:
    edges: dict[int, int] = {}
    final, above = [False], [(0, 0)]
    for piece in pieces:
        node = 0
        for byte in piece:
            key = node * 256 + byte
            to = edges.get(key)
            if to is None:
                to = edges[key] = len(final)
                final.append(False)
                above.append((node, byte))
            node = to
        final[node] = node > 0
    missing = [b for b in range(256) if b not in edges or not final[edges[b]]]
    if missing:
        raise ValueError(f"{len(missing)} single bytes are not in the vocabulary")
    n = len(final)
    depth = np.zeros(n, np.int64)
    for v in range(1, n):
        depth[v] = depth[above[v][0]] + 1
    fail, popped, rest = [-1] * n, [0] * n, [0] * n
    for v in np.argsort(depth, kind="stable")[1:].tolist():
        if final[v]:
            fail[v], popped[v] = 0, 1
        else:
            u, byte = above[v]
            z, count = fail[u], popped[u]
            while z * 256 + byte not in edges:
                count += popped[z]
                z = fail[z]
            fail[v], popped[v] = edges[z * 256 + byte], count
        rest[v] = popped[v] + rest[fail[v]]
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    order = np.argsort(keys)
    targets = np.fromiter(edges.values(), np.int64, len(edges))[order]
    return Automaton(keys[order], targets, *(np.array(x, np.int64) for x in (fail, popped, rest)))


def piece_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Pieces of each word (a byte range of ``data``) with a space in front."""
    order = np.argsort(start - end, kind="stable")
    begin, length = start[order], (end - start)[order]
    node = np.full(len(order), automaton.step(np.zeros(1, np.int64), np.array([0x20]))[0])
    count = np.zeros(len(order), np.int64)
    for i in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -i, "left"))
        byte = data[begin[:live] + i].astype(np.int64)
        at = node[:live]
        to = automaton.step(at, byte)
        stuck = np.flatnonzero(to < 0)
        while len(stuck):
            count[stuck] += automaton.popped[at[stuck]]
            at[stuck] = automaton.fail[at[stuck]]
            to[stuck] = automaton.step(at[stuck], byte[stuck])
            stuck = stuck[to[stuck] < 0]
        node[:live] = to
    out = np.empty(len(order), np.int64)
    out[order] = count + automaton.rest[node]
    return out


class Memory:
    """Counts of words seen in this task, by hash; begun anew beyond ``REMEMBER`` words."""

    def __init__(self) -> None:
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counted(self, words: Words, automaton: Automaton) -> np.ndarray:
        hashes, sample, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        inside = np.minimum(at, max(0, len(self.hashes) - 1))
        known = self.hashes[inside] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        counts = np.empty(len(hashes), np.int64)
        counts[known] = self.counts[inside[known]]
        new = sample[~known]
        counts[~known] = piece_counts(words.data, words.start[new], words.end[new], automaton)
        if len(self.hashes) + len(new) > REMEMBER:
            self.hashes, self.counts = hashes, counts
        else:
            self.hashes, self.counts = np.insert(self.hashes, at[~known], hashes[~known]), np.insert(self.counts, at[~known], counts[~known])
        return counts[back]


def _count(text_at: int, automaton):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            n_words, n_tokens = [], []
            for lo, hi, words in word_blocks(batch.column(text_at)):
                row = np.repeat(np.arange(hi - lo), words.counts)
                n_words.append(words.counts)
                pieces = memory.counted(words, automaton.value) if len(words.hash) else np.zeros(0, np.int64)
                n_tokens.append(np.bincount(row, pieces, hi - lo).astype(np.int64))
            sums = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (n_words, n_tokens)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], [*batch.schema.names, *RESULTS])

    return run


def token_counts(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens``.  Reads the vocabulary where the plan is made."""
    ship(docs.sparkSession)
    automaton = docs.sparkSession.sparkContext.broadcast(build(read_vocabulary(path)))
    given = docs.drop(*RESULTS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(_count(given.columns.index(text_col), automaton), f"{schema}, n_words long, n_tokens long")
