"""Streamed ratings equal those of a whole table, however the rows are split."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchframe.operators.ratings import EloConfig, elo_features, elo_state
from matchframe.plans.feature_queries import ELO_COLUMNS
from matchframe.streaming.ratings import elo_stream, write_ratings

SCHEMA = "pool string, match_id long, match_date date, season int, home string, away string, hg int, ag int"
CFG = EloConfig(k=30.0, home_advantage=75.0, margin=True, carryover=0.8)
START = dt.date(2020, 8, 1)


def matches(n: int = 150) -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for i in range(n):
        pool = rng.choice(["p", "p", "p", "q"])
        home, away = rng.sample([f"{pool}{k}" for k in range(6)], 2)
        day = i // 3
        rows.append((pool, i, START + dt.timedelta(days=day), 2020 + day // 20, home, away, rng.randrange(5), rng.randrange(4)))
    return rows


def replay(spark, tmp_path, files: list[list[tuple]], delay: int, state=None):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        rated = elo_stream(stream, CFG, delay_days=delay, state=state)
        query = write_ratings(rated, out, str(tmp_path / "progress"))
        query.awaitTermination()
        assert query.exception() is None
    good = {r["match_id"]: tuple(r[c] for c in ELO_COLUMNS) for r in spark.read.parquet(f"{out}/rated").collect()}
    aside = sorted((r["match_id"], r["outcome"]) for r in spark.read.parquet(f"{out}/aside").collect())
    return good, aside


def batch(spark, rows, state=None):
    rated = elo_features(spark.createDataFrame(rows, SCHEMA), CFG, state=state)
    return {r["match_id"]: tuple(r[c] for c in ELO_COLUMNS) for r in rated.collect()}


def ticks() -> list[tuple]:
    return [(p, None, START + dt.timedelta(days=400), None, None, None, None, None) for p in ("p", "q")]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_within_the_delay_equals_the_batch(spark, tmp_path, seed):
    rows, rng = matches(), random.Random(seed)
    cuts = sorted(rng.sample(range(1, 50), 3))
    files = [[r for r in rows if lo <= (r[2] - START).days + (r[1] * 7919 + seed) % 5 < hi] for lo, hi in zip([0, *cuts], [*cuts, 99])]
    for part in files:
        rng.shuffle(part)
    assert sum(map(len, files)) == len(rows)
    good, aside = replay(spark, tmp_path, [*files, ticks()], delay=5)
    assert aside == [] and good == batch(spark, rows)


def test_late_repeated_and_incomplete_rows_go_aside(spark, tmp_path):
    rows = matches()
    early = [r for r in rows if (r[2] - START).days < 30]
    late = next(r for r in early if r[0] == "p")
    first = [r for r in early if r is not late] + [("p", 900, None, 2020, "p1", "p2", 1, 0), ("p", 901, START, 2020, "p1", None, 1, 0)]
    again = [r for r in early if r is not late][:2]
    rest = [r for r in rows if (r[2] - START).days >= 30]
    good, aside = replay(spark, tmp_path, [first, [late, *again, *rest], ticks()], delay=2)
    assert aside == sorted([(900, "incomplete"), (901, "incomplete"), *((r[1], "late") for r in (late, *again))])
    assert good == batch(spark, [r for r in rows if r is not late])


def test_goes_on_from_the_state_of_a_table(spark, tmp_path):
    rows = matches()
    old, new = [r for r in rows if (r[2] - START).days < 25], [r for r in rows if (r[2] - START).days >= 25]
    before = spark.createDataFrame(old, SCHEMA)
    last = before.groupBy("pool").agg(F.max("match_date").alias("match_date"))
    state = elo_state(before, CFG).join(last, "pool")
    good, aside = replay(spark, tmp_path, [[old[0], *new], ticks()], delay=3, state=state)
    whole = batch(spark, rows)
    assert aside == [(old[0][1], "late")] and good == {r[1]: whole[r[1]] for r in new}
