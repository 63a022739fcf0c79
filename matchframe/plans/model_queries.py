"""Model fitting, validation and explanation (M1-M12, P12, P22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.functions.probs import P, log_loss, normalize_probs, triple
from matchframe.operators import manyfits as N
from matchframe.operators import metrics as A
from matchframe.operators import ml as M
from matchframe.operators import ratings as E
from matchframe.operators import rolling as R
from matchframe.operators import tuning as T
from matchframe.plans.probability_queries import _ERR, _SCORE, cal_sql
from matchframe.plans.registry import query
from matchframe.plans.stages import staged
from matchframe.plans.tables import Tables

FORM = ["home_points_last_5", "away_points_last_5", "home_goals_scored_avg", "away_goals_scored_avg"]
XG = ["home_xg_diff", "away_xg_diff"]
REST = ["home_days_rest", "away_days_rest", "home_matches_last_14_days", "away_matches_last_14_days"]
GROUPS = {"form": FORM, "xg": XG, "rest": REST}
ALL = FORM + XG + REST
TRIPLE = "match_id:i p_home:d6 p_draw:d6 p_away:d6"


# The feature set of the production model.
REST_NAMES = ("days_rest", "matches_last_14_days", "had_midweek_match", "days_since_last_match")
PRODUCTION = [
    *[f"{side}_{c}" for c in ("points_last_5", "goals_scored_avg") for side in ("home", "away")],
    "home_advantage",
    *[f"{side}_{c}" for c in ("xg_avg", "xga_avg", "xg_diff") for side in ("home", "away")],
    *[f"{side}_{c}" for c in REST_NAMES for side in ("home", "away")],
    *M.ELO_COLUMNS, "elo_recent_change", "rolling_elo_form",
    *[f"{side}_{c}_avg_{w}" for w in ("last5", "last10", "season") for c in ("shots", "shots_on_target") for side in ("home", "away")],
]

RATING = [*M.ELO_COLUMNS, "elo_recent_change", "rolling_elo_form"]
SHOTS = [c for c in PRODUCTION if "shots" in c]
PRODUCTION_GROUPS = {
    "form": FORM, "xg": [c for c in PRODUCTION if "xg" in c], "rest": [c for c in PRODUCTION if c.split("_", 1)[1] in REST_NAMES],
    "rating": RATING, "shots": SHOTS,
}


def data(t: Tables):
    """Features of all matches, staged: every fit reads them several times."""
    ids = t.matches.select("match_id", "match_date", "season", "pool")
    return staged(R.match_features(t.long).join(ids, "match_id"))


def halves(t: Tables):
    split = T.time_split(data(t))
    return split.where("is_test = 0"), split.where("is_test = 1")


def production_rows(t: Tables):
    """All matches with form, xG, rest, ratings and shots, staged."""
    ids = t.matches.select("match_id", "match_date")
    rows = R.match_and_shot_features(t.long).join(ids, "match_id")
    rated = E.elo_features(t.matches, E.EloConfig(k=30.0, home_advantage=75.0)).drop("pool")
    return staged(rows.join(rated, "match_id"))


def production(t: Tables):
    """Train and test rows of the production columns."""
    split = T.time_split(production_rows(t))
    return split.where("is_test = 0"), split.where("is_test = 1")


@query(
    "M1_time_split",
    "pool:i cutoff:s train:i test:i",
    """WITH d AS (SELECT pool, match_date, count(*) AS n FROM @matches GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY pool ORDER BY match_date) AS c, sum(n) OVER (PARTITION BY pool) AS tot FROM d),
    k AS (SELECT pool, min(match_date) AS cutoff FROM c WHERE c > floor(tot * 0.8 + 1e-9) GROUP BY pool)
    SELECT pool, cutoff, count(*) FILTER (WHERE match_date < cutoff) AS train, count(*) FILTER (WHERE match_date >= cutoff) AS test FROM @matches JOIN k USING (pool) GROUP BY pool, cutoff""",
)
def m1(t: Tables):
    rows = T.time_split(t.matches, keys=["pool"])
    is_test = F.col("is_test")
    counts = rows.groupBy("pool").agg(F.sum(1 - is_test).alias("train"), F.sum(is_test).alias("test"))
    return counts.join(T.split_cutoff(t.matches, keys=["pool"]), "pool")


@query("M2_fit_outcome_model", TRIPLE)
def m2(t: Tables):
    train, test = production(t)
    return M.fit_outcome_model(train, PRODUCTION).transform(test.na.fill(0.0, PRODUCTION))


@query("M2_fit_boosted_model", TRIPLE)
def m2_boosted(t: Tables):
    train, test = production(t)
    return M.fit_outcome_model(train, PRODUCTION, kind="boosted").transform(test.na.fill(0.0, PRODUCTION))


# Coefficients to apply: outcome by column of ``ALL``.
_COEFFICIENTS = [[round(0.05 * ((i * 7 + j * 3) % 11 - 5), 2) for j in range(len(ALL))] for i in range(3)]
_INTERCEPTS = [0.2, -0.1, -0.3]


@query(
    "M2_apply_coefficients",
    TRIPLE,
    f"""WITH f AS (SELECT match_id, hg + 1.0 AS x0, ag * 2.0 AS x1, hxg AS x2, axg AS x3, coalesce(hs, 0) / 10.0 AS x4, coalesce(as_, 0) / 10.0 AS x5, coalesce(hst, 0) * 1.0 AS x6,
      coalesce(ast, 0) * 1.0 AS x7, hxg - axg AS x8, match_id % 5 * 1.0 AS x9 FROM @matches),
    z AS (SELECT match_id, {", ".join(f"{b} + " + " + ".join(f"({w}) * x{j}" for j, w in enumerate(row)) + f" AS z{i}" for i, (row, b) in enumerate(zip(_COEFFICIENTS, _INTERCEPTS)))} FROM f)
    SELECT match_id, exp(z0) / (exp(z0) + exp(z1) + exp(z2)) AS p_home, exp(z1) / (exp(z0) + exp(z1) + exp(z2)) AS p_draw, exp(z2) / (exp(z0) + exp(z1) + exp(z2)) AS p_away FROM z""",
)
def m2_apply(t: Tables):
    """The applying half of a logistic model, on coefficients that both sides know."""
    c = F.col
    cells = [
        c("hg") + 1.0, c("ag") * 2.0, c("hxg"), c("axg"), c("hs") / 10.0, c("as_") / 10.0, c("hst") * 1.0, c("ast") * 1.0, c("hxg") - c("axg"),
        c("match_id") % 5 * 1.0,
    ]
    rows = t.matches.select("match_id", *[x.alias(f"x{j}") for j, x in enumerate(cells)])
    return M.apply_logistic(rows, [f"x{j}" for j in range(10)], _COEFFICIENTS, _INTERCEPTS)


_CUT_SQL = """d AS (SELECT match_date, count(*) AS n FROM @matches GROUP BY ALL), c AS (SELECT *, sum(n) OVER (ORDER BY match_date) AS c, sum(n) OVER () AS tot FROM d),
    k AS (SELECT min(match_date) AS cutoff FROM c WHERE c > floor(tot * 0.8 + 1e-9))"""


@query(
    "M2_fit_facts",
    "kind:s rows:i mass:d6 valid:i better_than_prior:i",
    f"WITH {_CUT_SQL}, n AS (SELECT count(*) AS n FROM @matches, k WHERE match_date >= cutoff) SELECT kind, n AS rows, n AS mass, n AS valid, 1 AS better_than_prior FROM n, (VALUES ('forest'), ('logistic')) AS v(kind)",
)
def m2_facts(t: Tables):
    """What holds for any sound fit: it scores every test row, with chances that sum to 1, and beats the class shares on its training rows."""
    return _fit_facts(*halves(t), ALL, ("forest", "logistic"))


def _fit_facts(train, test, columns, kinds, gains=False):
    train, test = staged(train.na.fill(0.0, columns)), test.na.fill(0.0, columns)
    out = None
    share = train.groupBy("target").agg(F.count("*").alias("n"))
    whole = share.agg(F.sum("n").alias("t"))
    prior = share.join(F.broadcast(whole)).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias("prior"))
    for kind in kinds:
        model = M.fit_outcome_model(train, columns, kind=kind)
        total = sum((F.col(p) for p in P), F.lit(0.0))
        inside = F.least(*P) >= 0
        facts = model.transform(test).agg(F.count("*").alias("rows"), F.sum(total).alias("mass"), F.sum(inside.cast("int")).alias("valid"))
        loss = model.transform(train).agg(F.avg(log_loss(triple(), F.col("target"))).alias("loss"))
        one = facts.join(F.broadcast(loss)).join(F.broadcast(prior)).withColumn("better_than_prior", (F.col("loss") < F.col("prior")).cast("int"))
        if gains:
            gain = M.gain_importance(model, train).where("importance >= 0").agg(F.count("*").alias("features"), F.sum("importance").alias("gain"))
            one = one.join(F.broadcast(gain))
        one = one.withColumn("kind", F.lit(kind)).drop("loss", "prior")
        out = one if out is None else out.unionByName(one)
    return out


def seasons_of(t: Tables):
    return production_rows(t).join(t.matches.select("match_id", "season"), "match_id")


@query(
    "M2_production_facts",
    "kind:s rows:i mass:d6 valid:i better_than_prior:i features:i gain:d6",
    f"""WITH {_CUT_SQL}, n AS (SELECT count(*) AS n FROM @matches, k WHERE match_date >= cutoff)
    SELECT kind, n AS rows, n AS mass, n AS valid, 1 AS better_than_prior, {len(PRODUCTION)} AS features, 1.0 AS gain FROM n, (VALUES ('forest'), ('boosted')) AS v(kind)""",
)
def m2_production_facts(t: Tables):
    """As ``M2_fit_facts`` for the production fits, and their gains: a share for every column, together 1."""
    return _fit_facts(*production(t), PRODUCTION, ("forest", "boosted"), gains=True)


@query(
    "M3_walk_forward_seasons",
    "season:i matches:i",
    "SELECT season, count(*) AS matches FROM @matches WHERE season > (SELECT min(season) FROM @matches) GROUP BY season",
)
def m3_seasons(t: Tables):
    return M.walk_forward(seasons_of(t), PRODUCTION, kind="logistic").groupBy("season").agg(F.count("*").alias("matches"))


@query("M3_walk_forward", "season:i matches:i accuracy:d6 log_loss:d6 brier_score:d6")
def m3(t: Tables):
    return A.score_probs(M.walk_forward(seasons_of(t), PRODUCTION, kind="logistic"), ["season"])


_MASS = "home:d3 draw:d3 away:d3"
_COUNTS = ", ".join(f"sum(w * CASE WHEN result = '{r}' THEN 1 ELSE 0 END) AS {n}" for r, n in (("H", "home"), ("D", "draw"), ("A", "away")))


@query(
    "M3_walk_forward_balance",
    f"season:i {_MASS}",
    f"""WITH s AS (SELECT DISTINCT season AS test FROM @matches WHERE season > (SELECT min(season) FROM @matches))
    SELECT test AS season, {_COUNTS} FROM (SELECT test, result, 1.0 AS w FROM s JOIN @matches ON season < test) AS m GROUP BY test""",
)
def m3_balance(t: Tables):
    """The fits themselves: an unpenalised fit gives its training rows as many wins, draws and losses as they have."""
    rows = staged(seasons_of(t))
    seasons = sorted(r["season"] for r in rows.select("season").distinct().collect())[1:]
    weights = M.earlier_seasons(seasons)
    scored = N.fit_many(rows, PRODUCTION, weights, len(seasons)).transform(rows)
    return N.fitted_mass(scored, weights).withColumn("season", F.get(F.array(*[F.lit(s) for s in seasons]), F.col("fit")))


_METRICS = "model_version:s matches:i accuracy:d6 log_loss:d6 brier_score:d6 ece:d6"


@query("M4_compare_feature_sets", _METRICS)
def m4(t: Tables):
    return M.compare_feature_sets(production_rows(t), {"form": FORM, "form_xg": FORM + XG, "all": PRODUCTION}, kind="logistic")


@query("M4_blended_model", _METRICS)
def m4_blend(t: Tables):
    """The production columns and the same without ratings, half and half."""
    train, test = production(t)
    plain = [c for c in PRODUCTION if "elo" not in c]
    scored = M.blended_fit(train, test, PRODUCTION, plain, kind="boosted")
    return M.metrics_of(scored.withColumn("model_version", F.lit("blend")))


_DELTAS = _METRICS + " log_loss_delta:d6 brier_score_delta:d6 ece_delta:d6"


@query("M5_add_one_group", _DELTAS)
def m5_add(t: Tables):
    return M.add_one_group(production_rows(t), FORM, {g: c for g, c in PRODUCTION_GROUPS.items() if g != "form"}, kind="logistic")


@query("M5_remove_one_group", _DELTAS)
def m5_remove(t: Tables):
    return M.remove_one_group(production_rows(t), PRODUCTION_GROUPS, kind="logistic")


@query(
    "M5_deltas_to_base",
    _DELTAS,
    f"""WITH c AS ({cal_sql("@versions", "model_version")}), e AS (SELECT model_version, sum(abs({_ERR}) * "count") / sum("count") AS ece FROM c GROUP BY ALL),
    s AS (SELECT model_version, {_SCORE} FROM @versions GROUP BY model_version), j AS (SELECT * FROM s JOIN e USING (model_version)), b AS (SELECT * FROM j WHERE model_version = 'production')
    SELECT j.*, j.log_loss - b.log_loss AS log_loss_delta, j.brier_score - b.brier_score AS brier_score_delta, j.ece - b.ece AS ece_delta FROM j, b""",
)
def m5_deltas(t: Tables):
    """The comparing half of the group searches, on given predictions."""
    return M.with_deltas(M.metrics_of(t.versions), "production")


@query("M6_parameter_search", _METRICS)
def m6(t: Tables):
    matches = t.matches.withColumn("target", F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).otherwise(2))
    return M.parameter_search(matches, kind="logistic")


@query("M7_bootstrap_models", "row_id:i class:s mean:d6 std:d6 lower_95:d6 upper_95:d6")
def m7(t: Tables):
    train, test = production(t)
    return M.bootstrap_models(train, test, PRODUCTION, kind="logistic")


@query("M8_subset_ensemble", "row_id:i class:s mean:d6 std:d6")
def m8(t: Tables):
    train, test = production(t)
    return M.subset_ensemble(train, test, PRODUCTION, kind="logistic")


def _mass_sql(n: int, tag: str, weight: str) -> str:
    draw = f"CAST(('0x' || substr(md5(concat_ws('-', CAST(42 + r AS VARCHAR), '{tag}', CAST(match_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
    return f"""WITH {_CUT_SQL}, u AS (SELECT r, result, {draw} AS u FROM @matches, k, (SELECT unnest(range({n})) AS r) AS n WHERE match_date < cutoff)
    SELECT r AS fit, {_COUNTS} FROM (SELECT r, result, {weight} AS w FROM u) AS m GROUP BY r"""


def _mass(t: Tables, n: int, tag: str, weight):
    train, _ = production(t)
    weights = M.replicate_weights(n, M.bootstrap_draw(M.SEED, tag), weight)
    return N.fitted_mass(N.fit_many(train, PRODUCTION, weights, n).transform(train), weights)


@query("M7_bootstrap_balance", f"fit:i {_MASS}", _mass_sql(40, "b", " + ".join(f"CAST(u >= {x!r}::DOUBLE AS INTEGER)" for x in M.poisson_limits())))
def m7_balance(t: Tables):
    """As ``M3_walk_forward_balance``: the 40 replicates' chances add up to their weighted outcomes."""
    return _mass(t, 40, "b", M.poisson_weight)


@query("M8_subset_balance", f"fit:i {_MASS}", _mass_sql(30, "s", "CASE WHEN u < 0.85 THEN 1 ELSE 0 END"))
def m8_balance(t: Tables):
    """As ``M7_bootstrap_balance`` for the random subsets."""
    return _mass(t, 30, "s", lambda u: (u < 0.85).cast("double"))


@query("M9_gain_importance", "feature:s importance:d6")
def m9(t: Tables):
    train, _ = production(t)
    return M.gain_importance(M.fit_outcome_model(train, PRODUCTION), train)


@query("M10_permutation_importance", "feature:s importance:d6 std:d6")
def m10(t: Tables):
    train, test = production(t)
    model = M.fit_outcome_model(train, PRODUCTION, kind="boosted")
    return M.permutation_importance(model, test)


@query(
    "M10_partners",
    "rep:i rows:i givers:i fixed:i given:i",
    "SELECT rep, count(*) AS rows, count(*) AS givers, 0 AS fixed, sum(match_id) AS given FROM @matches, (SELECT unnest(range(5)) AS rep) AS r GROUP BY rep",
)
def m10_partners(t: Tables):
    """The shuffling half: in every repetition each row gives to exactly one other."""
    pairs = M.shuffled_partners(t.matches.select("match_id", F.col("match_id").alias("_x")), ["match_id"], "_x", 5)
    itself = (F.col("match_id") == F.col("_from")).cast("int")
    return pairs.groupBy("rep").agg(
        F.count("*").alias("rows"), F.count_distinct("_from").alias("givers"), F.sum(itself).alias("fixed"), F.sum("_from").alias("given")
    )


@query("M11_additive_contributions", "feature:s class:s mean_abs_contribution:d6")
def m11(t: Tables):
    train, test = halves(t)
    return M.additive_contributions(M.fit_outcome_model(train, ALL, kind="logistic"), test)


@query("M11_path_contributions", "feature:s class:s mean_abs_contribution:d6")
def m11_paths(t: Tables):
    train, test = production(t)
    return M.additive_contributions(M.fit_outcome_model(train, PRODUCTION, kind="boosted"), test)


@query(
    "M11_path_facts",
    "kind:s class:s rows:i exact:i",
    f"""WITH {_CUT_SQL}, n AS (SELECT count(*) AS n FROM @matches, k WHERE match_date >= cutoff)
    SELECT kind, class, n AS rows, n AS exact FROM n, (VALUES ('boosted'), ('forest')) AS v(kind), (VALUES ('home_win'), ('draw'), ('away_win')) AS w(class)""",
)
def m11_facts(t: Tables):
    """Every test row's contributions and base give the chances that the fitted production model gives."""
    train, test = production(t)
    out = []
    for kind in ("boosted", "forest"):
        model = M.fit_outcome_model(train, PRODUCTION, kind=kind)
        total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x)
        value = 1.0 / (1.0 + F.exp(-2.0 * total)) if kind == "boosted" else total
        sums = M.path_contributions(model, test).groupBy("match_id").pivot("class", list(M.CLASSES)).agg(F.first(value))
        sums = sums.withColumns(dict(zip([f"_{p}" for p in P], normalize_probs(triple(M.CLASSES)), strict=True)))
        both = model.transform(test.na.fill(0.0, PRODUCTION)).select("match_id", *P).join(sums, "match_id")
        cells = [F.struct(F.lit(c).alias("class"), (F.abs(F.col(p) - F.col(f"_{p}")) < 1e-9).cast("int").alias("same")) for c, p in zip(M.CLASSES, P, strict=True)]
        one = both.select(F.inline(F.array(*cells))).groupBy("class").agg(F.count("*").alias("rows"), F.sum("same").alias("exact"))
        out.append(one.withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


@query(
    "M12_selection_gate",
    "model_version:s log_loss:d6 log_loss_delta:d6 brier_score_delta:d6 ece_delta:d6 adopt:i",
    f"""WITH c AS ({cal_sql("@versions", "model_version")}), e AS (SELECT model_version, sum(abs({_ERR}) * "count") / sum("count") AS ece FROM c GROUP BY ALL),
    s AS (SELECT model_version, {_SCORE} FROM @versions GROUP BY model_version), j AS (SELECT * FROM s JOIN e USING (model_version)), b AS (SELECT * FROM j WHERE model_version = 'production'),
    d AS (SELECT j.model_version, j.log_loss, j.brier_score AS br, j.log_loss - b.log_loss AS log_loss_delta, j.brier_score - b.brier_score AS brier_score_delta, j.ece - b.ece AS ece_delta FROM j, b WHERE j.model_version <> 'production')
    SELECT *, CASE WHEN log_loss_delta < 0 AND brier_score_delta <= 0 AND ece_delta <= 0.01 THEN 1 ELSE 0 END AS adopt FROM d ORDER BY log_loss, br LIMIT 1""",
)
def m12(t: Tables):
    return T.selection_gate(M.metrics_of(t.versions), "production")


@query("P12_logistic_stack", TRIPLE)
def p12(t: Tables):
    split = T.time_split(t.pm)
    return M.logistic_stack(split.where("is_test = 0"), split.where("is_test = 1"))


@query("P22_compare_calibrations", "method:s matches:i accuracy:d6 log_loss:d6 brier_score:d6 ece:d6 selected:i")
def p22(t: Tables):
    """Fit on the first part of the training days, calibrate on the rest, score the test days."""
    train, test = production(t)
    inner = T.time_split(train.drop("is_test").na.fill(0.0, PRODUCTION))
    model = M.fit_outcome_model(inner.where("is_test = 0"), PRODUCTION, kind="boosted")
    scored = staged(model.transform(test.na.fill(0.0, PRODUCTION)).select("target", *P))
    return M.compare_calibrations(model.transform(inner.where("is_test = 1")), scored, PRODUCTION)
