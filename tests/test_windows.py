"""Sliced histories equal plain windows, also when one team holds a third of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchframe.operators import windows as W
from matchframe.operators.joins import active_interval_join, asof_last, dedupe_keep


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        team = 0 if i % 3 == 0 else rng.randrange(1, 30)
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(0, 700) if i % 5 else 40)
        rows.append((i, team, day, day.year, rng.randrange(0, 4), None if rng.random() < 0.3 else rng.random()))
    return spark.createDataFrame(rows, "match_id long, team long, match_date date, season int, points int, x double").repartition(3).cache()


def result(df):
    return {r["match_id"]: tuple(None if v is None else round(float(v), 9) for k, v in r.asDict().items() if k != "match_id") for r in df.collect()}


@pytest.mark.parametrize("width", [16, 45, 400])
def test_row_frames(skewed, width):
    plain = Window.partitionBy("team").orderBy("match_date", "match_id")
    want = skewed.select("match_id", F.sum("points").over(plain.rowsBetween(-5, -1)).alias("s"), F.lag("points").over(plain).alias("l"))
    h = W.History(skewed, ["team"], rows=5, width=width)
    got = h.real(h.frame.withColumns({"s": F.sum(W.real_row(F.col("points"))).over(h.last(5)), "l": F.max(W.real_row(F.col("points"))).over(h.last(1))}))
    assert result(got.select("match_id", "s", "l")) == result(want)


@pytest.mark.parametrize("width", [16, 45, 400])
def test_day_frames_both_ways(skewed, width):
    plain = Window.partitionBy("team").orderBy(F.unix_date("match_date"))
    one = F.lit(1)
    want = skewed.select("match_id", F.sum(one).over(plain.rangeBetween(-14, -1)).alias("b"), F.sum(one).over(plain.rangeBetween(1, 14)).alias("a"))
    h = W.History(skewed, ["team"], days=14, ahead=14, day_sums={"n": one}, width=width)
    got = h.real(h.frame.withColumns({"b": F.sum("n").over(h.within_days(1, 14)), "a": F.sum("n").over(h.next_days(1, 14))}))
    assert result(got.select("match_id", "b", "a")) == result(want)


@pytest.mark.parametrize("width", [16, 45, 400])
def test_running_totals_by_season(skewed, width):
    plain = Window.partitionBy("team", "season").orderBy("match_date", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select("match_id", F.sum("points").over(plain).alias("s"), F.count("points").over(plain).alias("n"))
    h = W.History(skewed, ["team"], totals={"tp": F.col("points"), "tn": F.lit(1)}, totals_by=["season"], width=width)
    run = h.running(["season"])
    got = h.real(h.frame.withColumns({"s": F.sum("tp").over(run), "n": F.coalesce(F.sum("tn").over(run), F.lit(0))}))
    assert result(got.select("match_id", "s", "n")) == result(want)


@pytest.mark.parametrize("width", [16, 45, 400])
def test_last_valid_rows(skewed, width):
    rows = sorted((r.team, r.match_date, r.match_id, r.x) for r in skewed.collect())
    want, past = {}, {}
    for team, _, mid, x in rows:
        seen = past.setdefault(team, [])
        last = seen[-3:]
        want[mid] = (round(sum(last), 9) if last else None,)
        if x is not None:
            seen.append(x)
    ok = F.col("x").isNotNull()
    h = W.History(skewed, ["team"], rows=3, rows_where=ok, width=width)
    k = F.coalesce(F.sum(W.real_row(F.when(ok, 1))).over(h.running()), F.lit(0))
    got = h.real(h.frame.withColumn("k", k).withColumn("s", F.sum(W.real_row(F.col("x"))).over(h.part().orderBy("k").rangeBetween(-3, -1))))
    assert result(got.select("match_id", "s")) == want


def test_no_slice_holds_the_whole_busy_key(skewed):
    h = W.History(skewed, ["team"], rows=5, width=45)
    sizes = h.frame.groupBy("team", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] < skewed.where("team = 0").count() / 2


def test_suggested_width_follows_the_busiest_key(skewed):
    busiest = skewed.where("team = 0").count()
    assert W.suggest_chunk_days(skewed, ["team"], target_rows=busiest) >= 600
    assert W.suggest_chunk_days(skewed, ["team"], target_rows=busiest // 10) <= 70


@pytest.mark.parametrize("rows", [10, 500, 1_000_000])
def test_ranks_in_slices(skewed, monkeypatch, rows):
    monkeypatch.setattr(W, "SLICE_ROWS", rows)
    plain = Window.partitionBy("season").orderBy(F.col("points").desc_nulls_last())
    want = skewed.select("match_id", F.rank().over(plain).alias("r"))
    got = W.tied_rank(skewed, ["season"], "points", name="r")
    assert result(got.select("match_id", "r")) == result(want)
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("x").asc_nulls_last())
    want = skewed.select("match_id", F.rank().over(order).alias("r"))
    got = W.tied_rank(skewed, [], "x", name="r", descending=False)
    assert result(got.select("match_id", "r")) == result(want)
    drawn = skewed.withColumn("u", F.abs(F.xxhash64("match_id") % 1000) / 1000)
    order = Window.partitionBy("season").orderBy("u", "match_id")
    want = drawn.select("match_id", F.row_number().over(order).alias("r"))
    got = W.uniform_rank(drawn, ["season"], "u", name="r", ties=["match_id"])
    assert result(got.select("match_id", "r")) == result(want)


def test_exact_quantiles(skewed):
    want = skewed.groupBy("season").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.9))).alias("q")).collect()
    got = {(r.season, r.q): r.value for r in W.exact_quantiles(skewed, ["season"], "x", [0.25, 0.9]).collect()}
    for r in want:
        assert got[r.season, 0.25] == pytest.approx(r.q[0])
        assert got[r.season, 0.9] == pytest.approx(r.q[1])


def test_asof_and_intervals_against_brute_force(spark, skewed):
    events = skewed.select("match_id", "team", "match_date")
    rng = random.Random(3)
    facts = []
    for i in range(200):
        start = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(0, 700))
        end = None if i % 7 == 0 else start + dt.timedelta(days=rng.choice([0, 3, 31, 32, 33, 200, 600]))
        facts.append((i, 0 if i % 3 == 0 else rng.randrange(1, 30), start - dt.timedelta(days=rng.randrange(-2, 3)), start, end))
    f = spark.createDataFrame(facts, "fact long, team long, report_date date, unavailable_from date, expected_return_date date")
    ev = [tuple(r) for r in events.collect()]
    want = {(m, x) for m, t, d in ev for x, ft, rep, a, b in facts if ft == t and rep <= d and a <= d and (b is None or b >= d)}
    got = [(r.match_id, r.fact) for r in active_interval_join(events, f).collect()]
    assert len(got) == len(set(got)) and set(got) == want

    days = spark.createDataFrame([(x, t, a, b) for x, t, _, a, b in facts], "fact long, team long, match_date date, known date")
    days = dedupe_keep(days, ["team", "match_date"], ["fact"])
    kept = [tuple(r) for r in days.select("fact", "team", "match_date", "known").collect()]
    for known in (None, "known"):
        got = {r.match_id: r.fact for r in asof_last(events, days, value=["fact"], known=known).collect()}
        for m, t, d in ev:
            seen = [(a, x) for x, ft, a, k in kept if ft == t and a < d and (known is None or k is None or k < d)]
            assert got[m] == (max(seen)[1] if seen else None)


def test_open_intervals_give_their_true_pairs_only(spark):
    """A key with many open facts: the equi join itself yields the true pairs, no candidates beside them."""
    from matchframe.operators.joins import covering_blocks

    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    facts = spark.createDataFrame([(i, 0, day(i), None) for i in range(1000)], "fact long, team long, s date, e date")
    events = spark.createDataFrame([(i, 0, day(i * 10)) for i in range(100)], "match_id long, team long, match_date date")
    hit = active_interval_join(events, facts, known="s", start="s", end="e")
    assert hit.count() == sum(min(1000, i * 10 + 1) for i in range(100))
    spans = [(a, b) for a in (0, 1, 7, 8, 63, 511) for b in (a + 1, a + 8, a + 65, a + 5000, 8**6)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", F.inline(covering_blocks(F.col("a"), F.col("b"))))
    days = {}
    for r in df.collect():
        days.setdefault((r.a, r.b), []).append((r._slot * 8**r._level, (r._slot + 1) * 8**r._level))
    for (a, b), blocks in days.items():
        blocks.sort()
        assert blocks[0][0] == a and blocks[-1][1] == b and len(blocks) < 90
        assert all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))


def test_few_rows_a_key_are_one_slice(skewed):
    h = W.History(skewed, ["team"], rows=5, days=14, day_sums={"n": F.lit(1)}, whole=W.fits_whole(["team"], skewed))
    assert h.whole and h.frame.count() == 900
    plain = Window.partitionBy("team").orderBy("match_date", "match_id").rowsBetween(-5, -1)
    got = h.real(h.frame.withColumn("v", F.sum("points").over(h.last(5)))).select("match_id", "v")
    assert result(got) == result(skewed.withColumn("v", F.sum("points").over(plain)).select("match_id", "v"))


def test_busy_keys_and_set_widths_are_sliced(skewed, spark, monkeypatch):
    monkeypatch.setattr(W, "WHOLE_ROWS", 299)
    assert not W.fits_whole(["team"], skewed) and W.fits_whole(["team"], skewed.where("team > 0"))
    assert not W.fits_whole(["team"], *[skewed.where("team > 0")] * 20)
    monkeypatch.undo()
    spark.conf.set("spark.matchframe.chunkDays", "45")
    try:
        assert not W.fits_whole(["team"], skewed)
    finally:
        spark.conf.unset("spark.matchframe.chunkDays")
    assert W.fits_whole(["team"], skewed.limit(0))


@pytest.mark.parametrize("name", ["W1_form_features", "W4_shot_volume_features", "W17_absence_features", "W19_lineup_continuity", "W20_lineup_familiarity", "W21_lineup_rotation"])
def test_slices_and_whole_keys_agree(spark, name):
    from matchframe.plans.catalog import REGISTRY

    sf = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(str, REGISTRY[name].run(spark, sf).collect()))
    whole = rows()
    spark.conf.set("spark.matchframe.chunkDays", "45")
    try:
        assert rows() == whole and whole
    finally:
        spark.conf.unset("spark.matchframe.chunkDays")
