"""URL filter: rules first, then a ratio of two character language models.

Rules name a host and the start of a path; a rule fits its host and all of its
subdomains, and of several the longest wins.  URLs that some rule decides are
the examples: accepted and rejected ones each train a variable-order Markov
model of characters, and a URL without a rule is judged by the difference of its
two log-likelihoods per character.

* Symbols: the bytes of host and path without the scheme, lower-cased, each digit
  as ``0`` and each character beyond printable ASCII as ``~``.
* Counts of every symbol after its 0 to ``ORDER`` preceding symbols come from all
  decided URLs and are exact: a string of ``ORDER`` + 1 symbols is one number, tasks
  count their batches, and Spark keeps a row for each distinct string.  Counts of
  the shorter strings and of the contexts are aggregates of these rows, so the model
  grows with the distinct strings of the input.
* A symbol's log-likelihoods follow from the string that ends in it, so Spark joins
  them to each distinct string once.  Up to ``IN_PLACE`` distinct strings travel to the
  tasks as sorted arrays.  Of more, only those that make up at least one part in
  ``IN_PLACE`` of all occurrences do, at most ``IN_PLACE`` again; the others, none of which
  is frequent, meet the URLs in a shuffle.  Both ways give the same scores.
* Smoothing: a context seen n times gives (count + ``WEIGHT`` * p) / (n + ``WEIGHT``)
  with p from the context one symbol shorter, down to a uniform p.  An unseen
  context changes nothing, so the order that counts varies from symbol to symbol.
* Calibration: one of ``FOLDS`` parts of the decided URLs is left out, scored, and
  binned into ``BINS`` cells; the threshold is the cell border with the least mean
  of the two error rates.  The final models use all decided URLs.

Cases: a null URL, or one without ``://``, has an empty host and path and no rule
and is scored as an empty text; with no rejected (or accepted) examples all open
URLs are allowed (blocked); ties at the threshold are allowed; an empty table
gives an empty result; repeated rows are judged alike and count as often as they
occur; columns named like the results are replaced, others are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.llm.shared import share
from matchframe.plans.stages import staged
from matchframe.shipping import ship

ORDER, WEIGHT, SYMBOLS = 4, 2.0, 96
IN_PLACE = 1_000_000
FOLDS, BINS, REACH = 5, 4_000, 4.0
LABELS = ("allow", "block")
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
EDGE = b"\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = url.isNotNull() & url.contains("://")
    rest = F.substr(url, F.locate("://", url) + F.lit(3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + F.lit(1)), r"^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting rule as (rule, verdict), or null; of equally long ones the first by name."""
    ranked = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r[0] + r[1]))
    out = F.lit(None)
    for name, start, verdict in reversed(ranked):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(host: Column, path: Column) -> Column:
    text = F.lower(F.concat(host, path))
    return F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7e]", "~"), "[0-9]", "0")


def grams(chars: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """The string of ``ORDER`` + 1 symbols that ends in each symbol, as a number with the last one lowest, and its row."""
    rows = [EDGE * ORDER + c.encode() + EDGE for c in chars]
    data = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64)
    length = np.array([len(r) for r in rows], np.int64)
    begin = np.repeat(np.cumsum(length) - length, length)
    counted = np.flatnonzero(np.arange(len(data)) - begin >= ORDER)
    gram = np.zeros(len(counted), np.int64)
    for k in range(ORDER + 1):
        gram |= data[counted - k] << (8 * k)
    return gram, np.repeat(np.arange(len(rows)), length)[counted]


def _count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, part, n): part is 0 for open URLs, else 1 + 2 * held-out + (1 if rejected)."""
    for batch in batches:
        if batch.empty:
            continue
        gram, row = grams(batch["chars"])
        part = np.where(batch["label"].isna(), 0, 1 + 2 * (batch["fold"] == 0) + (batch["label"] == LABELS[1]))
        found, n = np.unique(gram * 8 + part[row], return_counts=True)
        yield pd.DataFrame({"gram": found >> 3, "part": found & 7, "n": n})


def count_grams(rows: DataFrame) -> DataFrame:
    """Per distinct string: its occurrences ``n``, and those in accepted and rejected URLs without (a, b) and with (fa, fb) the held-out part."""
    n, part = F.col("n"), F.col("part")
    of = lambda *parts: F.sum(F.when(part.isin(*parts), n).otherwise(0))
    counted = rows.mapInPandas(_count, "gram long, part int, n long").groupBy("gram")
    return counted.agg(F.sum(n).alias("n"), of(1).alias("a"), of(2).alias("b"), of(1, 3).alias("fa"), of(2, 4).alias("fb"))


def log_ratios(counted: DataFrame) -> DataFrame:
    """(gram, n, trained, final): log-likelihood of a string's last symbol as accepted, less that as rejected, in both models."""
    models = ("a", "b", "fa", "fb")
    out, p = counted, {m: F.lit(1.0 / SYMBOLS) for m in models}
    for k in range(ORDER + 1):
        string = F.col("gram").bitwiseAND(F.lit(256 ** (k + 1) - 1))
        context = F.shiftright("gram", 8).bitwiseAND(F.lit(256**k - 1))
        for kind, key, size in (("s", string, k + 1), ("c", context, k)):
            if size == ORDER + 1:
                out = out.withColumns({f"{kind}_{m}": F.col(m) for m in models})
                continue
            sums = counted.groupBy(key.alias("_key")).agg(*[F.sum(m).alias(f"{kind}_{m}") for m in models])
            # Strings of up to two symbols: at most SYMBOLS squared rows.
            out = out.withColumn("_key", key).join(F.broadcast(sums) if size <= 2 else sums, "_key").drop("_key")
        out = out.withColumns({f"_{m}": (F.col(f"s_{m}") + WEIGHT * p[m]) / (F.col(f"c_{m}") + WEIGHT) for m in models})
        out = out.drop(*[f"{kind}_{m}" for kind in "sc" for m in models])
        out = out.withColumnsRenamed({f"_{m}": f"p{k}_{m}" for m in models})
        p = {m: F.col(f"p{k}_{m}") for m in models}
    return out.select("gram", "n", (F.log(p["a"]) - F.log(p["b"])).alias("trained"), (F.log(p["fa"]) - F.log(p["fb"])).alias("final"))


def _sum_known(held):
    """Adds the sum over the strings that travel, the number of symbols, and the strings that do not travel."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values = held.value
        for batch in batches:
            gram, row = grams(batch["chars"])
            at = np.minimum(np.searchsorted(keys, gram), max(len(keys) - 1, 0))
            known = keys[at] == gram if len(keys) else np.zeros(len(gram), bool)
            sums = np.bincount(row[known], values[at[known]], len(batch)) if known.any() else np.zeros(len(batch))
            cuts = np.cumsum(np.bincount(row[~known], minlength=len(batch)))[:-1]
            others = [None] * len(batch) if known.all() else [x if len(x) else None for x in np.split(gram[~known], cuts)]
            yield batch.assign(known=sums, symbols=np.bincount(row, minlength=len(batch)), others=pd.Series(others, batch.index, object))

    return run


def with_scores(rows: DataFrame, ratios: DataFrame, which: str, in_place: int) -> DataFrame:
    """``rows`` with ``score``: the mean log-likelihood difference per symbol, above 0 if more like the accepted ones.

    ``rows`` needs ``chars`` and a unique ``row``; runs jobs that count the strings and collect those that travel.
    """
    size = ratios.agg(F.count("*").alias("strings"), F.sum("n").alias("n")).first()
    whole = size["strings"] <= in_place
    travels = ratios if whole else ratios.where(F.col("n") * F.lit(float(in_place)) >= F.lit(size["n"]))
    table = travels.select("gram", which).orderBy("gram").toArrow()
    held = share(rows.sparkSession, (table["gram"].to_numpy(), table[which].to_numpy()))
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInPandas(_sum_known(held), f"{given}, known double, symbols long, others array<long>")
    if not whole:
        out = staged(out)
        rest = out.select("row", F.explode("others").alias("gram")).join(ratios.select("gram", which), "gram")
        out = out.join(rest.groupBy("row").agg(F.sum(which).alias("_rest")), "row", "left")
        out = out.withColumn("known", F.col("known") + F.coalesce("_rest", F.lit(0.0))).drop("_rest")
    return out.withColumn("score", F.col("known") / F.col("symbols")).drop("known", "symbols", "others")


def threshold(bins: list[tuple[int, str, int]]) -> float:
    """The border of the score cells with the least mean of both error rates; of equal ones the middle."""
    table = {label: np.zeros(BINS) for label in LABELS}
    for cell, label, n in bins:
        table[label][cell] += n
    totals = {k: v.sum() for k, v in table.items()}
    if not totals["block"] or not totals["allow"]:
        return -np.inf if totals["allow"] or not totals["block"] else np.inf
    lost = np.concatenate([[0], np.cumsum(table["allow"])]) / totals["allow"]
    passed = 1 - np.concatenate([[0], np.cumsum(table["block"])]) / totals["block"]
    best = np.flatnonzero(np.isclose(lost + passed, (lost + passed).min()))
    return float(best[len(best) // 2]) * 2 * REACH / BINS - REACH


def url_filter(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES,
    in_place: int = IN_PLACE,
) -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (null where a rule decides).

    Runs the jobs that count, calibrate and stage the URLs.
    """
    ship(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns(
        {
            "decided": rule_of(F.col("host"), F.col("path"), rules),
            "chars": symbols(F.col("host"), F.col("path")),
            "fold": F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)).cast("int"),
            "row": F.monotonically_increasing_id(),
        }
    )
    rows = staged(rows)
    label = F.col("decided.verdict").alias("label")
    ratios = staged(log_ratios(staged(count_grams(rows.select("chars", "fold", label)))))

    left_out = with_scores(rows.where("decided IS NOT NULL AND fold = 0").select("row", "chars", label), ratios, "trained", in_place)
    cell = F.least(F.greatest(F.floor((F.col("score") + REACH) * BINS / (2 * REACH)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    bins = left_out.groupBy(cell.alias("cell"), "label").agg(F.count(F.lit(1)).alias("n")).collect()
    least = threshold([(r["cell"], r["label"], r["n"]) for r in bins])

    ruled = rows.where("decided IS NOT NULL").select(
        "id", "host", "path", "decided.rule", "decided.verdict", F.lit(None).cast("double").alias("score")
    )
    rest = with_scores(rows.where("decided IS NULL").select("row", "id", "host", "path", "chars"), ratios, "final", in_place)
    judged = rest.select(
        "id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.when(F.col("score") >= F.lit(least), "allow").otherwise("block").alias("verdict"), "score",
    )
    return ruled.union(judged).withColumnRenamed("id", id_col)
