"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every string
that occurs in it.  A document is parsed greedily against each automaton: a
phrase is the longest match from where the last one ended.  The language that
needs the fewest phrases, normalised as phrases * log2(training symbols) / symbols,
describes the document best and wins; equal ones are decided by name.

Symbols are lower-cased letters; everything between two letters is one space.
All letters of the sample are numbered: the ``LETTERS`` most frequent ones are one
symbol, each other one a pair of symbols, so a script of thousands of letters needs
few symbols.  A letter that the sample lacks matches nothing.
Texts are parsed whole, in parts of ``PART`` symbols side by side, so each part's
end also ends a phrase, for every language alike.

The fit reads a bounded sample of the labelled rows, the only limit here: of each
language the ``sample_docs`` rows that come first by a hash of their id, up to
``sample_chars`` characters of each.  Every third of them is left out of the automata
and shows how well a text of the language can be parsed; the others share
``sample_symbols`` symbols evenly, and what short ones leave goes to longer ones.  The
automata, at most 2 * sample_symbols states of LETTERS + 3 numbers and a few pair
symbols for each language, are broadcast.

A text is ``strange`` if the phrases that it ends within its parts, for each symbol,
pass its language's limit, the middle between the 90 % quantile of the texts left out
and 1, where every symbol is a phrase; ``LIMIT`` stands for it if none was left out.  A
text of one phrase is never strange.

Cases: a null text, or one without a letter, is ``und`` with score 0; ``score`` is
1 - phrases of the winner / phrases of the second (1 if there is one language), so
0 is a tie; with no labelled rows all documents are ``und``; null ids and repeated
rows are predicted like others; an empty table gives an empty result; ``strange`` and ``phrase_rate`` are null for ``und``; columns named
like the results are replaced, all others pass through untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.llm.shared import share
from matchframe.llm.words import row_blocks
from matchframe.shipping import ship

LETTERS, PART, LIMIT = 128, 512, 0.6
UNKNOWN = "und"
RESULTS = ("lang_pred", "score", "phrase_rate", "strange")
_letters: list[np.ndarray] = []


def lower_letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def build_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton: a row per state, -1 for none; state 0 is the start."""
    # One dictionary of state * width + symbol, so that a state costs no object of its own.
    follow: dict[int, int] = {}
    link, length, last = [-1], [0], 0
    for c in symbols:
        state = len(link)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and p * width + c not in follow:
            follow[p * width + c] = state
            p = link[p]
        if p != -1:
            q = follow[p * width + c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(link)
                for x in range(width):
                    if q * width + x in follow:
                        follow[copy * width + x] = follow[q * width + x]
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and follow.get(p * width + c) == q:
                    follow[p * width + c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    table = np.full(len(link) * width, -1, np.int32)
    table[np.fromiter(follow.keys(), np.int64, len(follow))] = np.fromiter(follow.values(), np.int32, len(follow))
    table = table.reshape(-1, width)
    return table


@dataclass
class Languages:
    """Names, one stacked transition table (state * width + symbol), start states, the letters' symbols and the limits."""

    names: list[str]
    table: np.ndarray
    start: np.ndarray
    bits: np.ndarray
    width: int
    letters: np.ndarray
    limits: np.ndarray

    def symbol_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Code point -> symbol (0 between letters, 1 for a letter that matches nothing) and second symbol or 0."""
        first, second = _codes(len(self.letters))
        low = lower_letters()
        place = np.zeros((2, len(low)), np.uint16)
        place[0, self.letters], place[1, self.letters] = first, second
        return np.where(low > 0, np.maximum(place[0, low], 1), 0).astype(np.uint16), place[1, low]


def _codes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second symbol (0 for none) of ``n`` letters, the most frequent first."""
    rest = np.arange(max(0, n - LETTERS))
    side = math.isqrt(max(0, len(rest) - 1)) + 1
    own = np.arange(min(n, LETTERS)) + 2
    first = np.concatenate([own, 2 + LETTERS + rest // side])
    return first, np.concatenate([np.zeros(len(own), np.int64), 2 + LETTERS + side + rest % side])


def _stream(points: np.ndarray, keep: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the kept code points, and for each code point the place where its symbols begin, with the end."""
    first, second = tables[0][points], tables[1][points]
    size = np.where(keep, 1 + (second > 0), 0)
    at = np.concatenate([[0], np.cumsum(size)])
    symbols = np.repeat(first, size)
    pair = keep & (second > 0)
    symbols[at[1:][pair] - 1] = second[pair]
    return symbols, at


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _even(sizes: Sequence[int], room: int) -> int:
    """The greatest level to which all sizes can be cut so that they fit into ``room``."""
    left = sorted(sizes)
    for i, size in enumerate(left):
        if size * (len(left) - i) > room:
            return room // (len(left) - i)
        room -= size
    return left[-1] if left else 0


def _sample_symbols(text: str, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    points = _points(text)
    letter = tables[0][points] > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return _stream(points, keep, tables)[0]


def fit(texts: dict[str, list[str]], sample_symbols: int, apart: dict[str, list[str]] | None = None) -> Languages:
    """Automata of the given texts, one list per language; texts ``apart`` give the limits."""
    low, names = lower_letters(), sorted(texts)
    counts: Counter = Counter()
    for name in names:
        for text in texts[name]:
            found, times = np.unique(low[_points(text)], return_counts=True)
            counts.update(dict(zip(found.tolist(), times.tolist(), strict=True)))
    counts.pop(0, None)
    letters = np.array([c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))], np.uint32)
    first, second = _codes(len(letters))
    end = int(max(first.max(initial=1), second.max(initial=1))) + 1
    known = Languages(names, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), end + 1, letters, np.zeros(0))
    symbols_of = known.symbol_tables()
    tables, starts, bits, base = [], [], [], 0
    for name in names:
        parts = [_sample_symbols(text, symbols_of) for text in texts[name]]
        level = _even([len(p) + 1 for p in parts], sample_symbols)
        # A text's own end matches nothing, so that no phrase runs over it.
        symbols = np.concatenate([np.append(p[: max(0, level - 1)], end) for p in parts]) if parts else np.zeros(0, int)
        table = build_automaton(symbols.tolist(), known.width)
        table[:, 1] = -1
        tables.append(np.where(table >= 0, (table + base) * known.width, -1).astype(np.int32))
        starts.append(base * known.width)
        bits.append(np.log2(max(2, len(symbols))))
        base += len(table)
    if tables:
        known.table, known.start, known.bits = np.concatenate(tables).ravel(), np.array(starts, np.int32), np.array(bits)
    known.limits = np.full(len(names), LIMIT)
    for i, name in enumerate(names):
        held = [s for text in (apart or {}).get(name, []) if len(s := _sample_symbols(text, symbols_of))]
        if held:
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in held])])
            need = phrases(np.concatenate(held), offsets, known)[:, i]
            known.limits[i] = (1 + np.quantile(_inner_rate(need, np.diff(offsets)), 0.9)) / 2
    return known


def _inner_rate(need: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Phrases that end inside a part, per symbol; the last of each part ends with it in any case."""
    return (need - -(-symbols // PART)) / np.maximum(1, symbols)


def phrases(symbols: np.ndarray, offsets: np.ndarray, languages: Languages) -> np.ndarray:
    """Phrases per row (between ``offsets``) and language."""
    length = np.diff(offsets)
    parts = -(-length // PART)
    row = np.repeat(np.arange(len(length)), parts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[row] + number * PART
    size = np.minimum(PART, offsets[row + 1] - begin)
    order = np.argsort(-size, kind="stable")
    row, begin, size = row[order], begin[order], size[order]
    n, start = len(languages.names), languages.start[:, None]
    counts = np.zeros((n, len(row)), np.int64)
    state = np.broadcast_to(start, (n, len(row))).copy()
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))
        symbol = symbols[begin[:live] + step].astype(np.int32)
        to = languages.table[state[:, :live] + symbol]
        miss = to < 0
        fresh = languages.table[start + symbol]
        # A miss ends a phrase; a symbol that the language lacks is one by itself.
        lacks = fresh < 0
        counts[:, :live] += miss
        counts[:, :live] += lacks & (state[:, :live] != start)
        state[:, :live] = np.where(miss, np.where(lacks, start, fresh), to)
    counts += state != start
    out = np.zeros((len(length), n))
    for i in range(n):
        out[:, i] = np.bincount(row, counts[i], len(length))
    return out


def _predict(text_at: int, languages):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Languages = languages.value
        tables = known.symbol_tables()
        for batch in batches:
            for lo, hi, data, offsets in row_blocks(batch.column(text_at)):
                names, scores, rates, odd = [], [], [], []
                # Code points per row from the byte offsets: every byte but a continuation begins one.
                heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
                points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                ends = heads[1:]
                is_letter = tables[0][points] > 0
                keep = is_letter.copy()
                keep[1:] |= is_letter[:-1]
                inner = heads[(heads > 0) & (heads < len(points))]
                keep[inner] = is_letter[inner]
                letter = np.concatenate([[0], np.cumsum(is_letter)])
                symbols, kept = _stream(points, keep, tables)
                has = letter[ends] > letter[heads[:-1]]
                places = kept[heads]
                counts = phrases(symbols, places, known) if known.names else np.zeros((len(has), 0))
                need, length = counts * known.bits, np.diff(places)
                inside = _inner_rate(counts, length[:, None])
                for i in range(len(has)):
                    if not has[i] or not known.names:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        rates.append(None)
                        odd.append(None)
                        continue
                    best = int(np.argmin(need[i]))
                    others = np.delete(need[i], best)
                    names.append(known.names[best])
                    scores.append(float(1 - need[i, best] / others.min()) if len(others) else 1.0)
                    rates.append(float(counts[i, best] / max(1, length[i])))
                    odd.append(bool(inside[i, best] > known.limits[best]))
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64()), pa.array(odd, pa.bool_())],
                    [*batch.schema.names, *RESULTS],
                )

    return run


def identify(
    docs: DataFrame, labelled: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    sample_docs: int = 96, sample_chars: int = 20_000, sample_symbols: int = 40_000,
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``phrase_rate`` (phrases per symbol of the winner) and ``strange``.

    ``labelled`` says which rows the fit may see; of those it uses text, language
    and, for the choice of the sample, the id.  Runs a job for the fit.
    """
    spark = docs.sparkSession
    ship(spark)
    usable = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    picked = usable.select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("place"),
        F.substring(F.col(text_col), 1, sample_chars).alias("text"),
    )
    first = Window.partitionBy("lang").orderBy("place", "text")
    rows = picked.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_docs).orderBy("lang", "nth").collect()
    texts: dict[str, list[str]] = {}
    apart: dict[str, list[str]] = {}
    for r in rows:
        (apart if r["nth"] % 3 == 0 else texts).setdefault(r["lang"], []).append(r["text"])
    languages = share(spark, fit(texts, sample_symbols, apart))
    given = docs.drop(*RESULTS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(
        _predict(given.columns.index(text_col), languages), f"{schema}, lang_pred string, score double, phrase_rate double, strange boolean"
    )
