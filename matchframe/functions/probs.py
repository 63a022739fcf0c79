"""Column algebra on probability triples and prices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]
P = ("p_home", "p_draw", "p_away")
FLOOR = 1e-15


def triple(names: Sequence[str] = P) -> Triple:
    h, d, a = (F.col(n) for n in names)
    return h, d, a


def named(p: Triple, names: Sequence[str] = P) -> dict[str, Column]:
    return dict(zip(names, p, strict=True))


def hash_uniform(*parts: Column) -> Column:
    """Reproducible uniform number in [0, 1) from the first 32 bits of an MD5."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def normalize_probs(p: Triple, floor: float = FLOOR) -> Triple:
    c = [F.least(F.greatest(x, F.lit(floor)), F.lit(1.0)) for x in p]
    total = c[0] + c[1] + c[2]
    return c[0] / total, c[1] / total, c[2] / total


def argmax3(p: Triple) -> Column:
    """0, 1 or 2; the first maximum wins."""
    h, d, a = p
    return F.when((h >= d) & (h >= a), 0).when(d >= a, 1).otherwise(2)


def pick(index: Column, p: Triple) -> Column:
    return F.when(index == 0, p[0]).when(index == 1, p[1]).otherwise(p[2])


def odds_to_probs(h: Column, d: Column, a: Column) -> dict[str, Column]:
    raw = [1.0 / x for x in (h, d, a)]
    total = raw[0] + raw[1] + raw[2]
    p = (raw[0] / total, raw[1] / total, raw[2] / total)
    return {
        "market_home_prob": p[0],
        "market_draw_prob": p[1],
        "market_away_prob": p[2],
        "market_margin": total - 1.0,
        "market_favorite_class": argmax3(p),
        "market_favorite_prob": F.greatest(*p),
    }


def fair_odds(p: Triple) -> Triple:
    q = normalize_probs(p)
    return 1.0 / q[0], 1.0 / q[1], 1.0 / q[2]


def temperature_scale(p: Triple, t: Column) -> Triple:
    q = [F.pow(x, 1.0 / t) for x in normalize_probs(p)]
    total = q[0] + q[1] + q[2]
    return q[0] / total, q[1] / total, q[2] / total


def blend(p: Triple, q: Triple, w: Column) -> Triple:
    return normalize_probs(tuple(w * x + (1.0 - w) * y for x, y in zip(p, q, strict=True)))


def residual(p: Triple, market: Triple, w: Column) -> Triple:
    return normalize_probs(tuple(m + w * (x - m) for x, m in zip(p, market, strict=True)))


def log_loss(p: Triple, target: Column) -> Column:
    return -F.log(pick(target, normalize_probs(p)))


def brier(p: Triple, target: Column) -> Column:
    q = normalize_probs(p)
    parts = [F.pow(x - (target == i).cast("int"), 2) for i, x in enumerate(q)]
    return parts[0] + parts[1] + parts[2]


def draw_overlay(p: Triple, mask: Column, boost: Column) -> Triple:
    """Move ``boost`` of the non-draw mass to the draw where ``mask`` holds."""
    h, d, a = normalize_probs(p)
    new = F.when(mask, d + boost * (1.0 - d)).otherwise(d)
    rest = h + a
    scale = F.when(rest > 0, (1.0 - new) / rest).otherwise(1.0)
    return normalize_probs((h * scale, new, a * scale))


def softmax3(z: Triple) -> Triple:
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = e[0] + e[1] + e[2]
    return e[0] / total, e[1] / total, e[2] / total


def _poisson_cells(mean: Column, top: int) -> list[Column]:
    """Unnormalised probabilities of 0..top; the mean is at least 0.05."""
    lam = F.greatest(mean, F.lit(0.05))
    return [F.exp(-lam) * F.pow(lam, F.lit(float(k))) / math.factorial(k) for k in range(top + 1)]


def with_poisson_1x2(df: DataFrame, home: str, away: str, names: Sequence[str] = P, top: int = 10) -> DataFrame:
    """Adds win, draw and loss mass of two independent Poisson scores truncated at ``top``.

    Cells, then sums: each step is its own projection, so no cell is computed
    twice and all of it stays in generated code.
    """
    cells = {f"_{s}{k}": c for s, m in (("h", home), ("a", away)) for k, c in enumerate(_poisson_cells(F.col(m), top))}
    h, a = ([F.col(f"_{s}{k}") for k in range(top + 1)] for s in "ha")

    def total(xs: list[Column]) -> Column:
        out = xs[0]
        for x in xs[1:]:
            out = out + x
        return out

    def beats(x: list[Column], y: list[Column]) -> Column:
        return total([x[i] * total(y[:i]) for i in range(1, top + 1)])

    sums = {"_w": beats(h, a), "_d": total([x * y for x, y in zip(h, a, strict=True)]), "_l": beats(a, h)}
    mass = F.col("_w") + F.col("_d") + F.col("_l")
    return (
        df.withColumns(cells)
        .withColumns(sums)
        .withColumns({n: F.col(c) / mass for n, c in zip(names, ("_w", "_d", "_l"), strict=True)})
        .drop(*cells, *sums)
    )
