"""Probability algebra, scorelines, evaluation and back-tests (P, A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.functions import probs as X
from matchframe.operators import availability as V
from matchframe.operators import betting as B
from matchframe.operators import metrics as A
from matchframe.operators import rolling as R
from matchframe.operators import scoreline as S
from matchframe.operators import tuning as T
from matchframe.plans.registry import query
from matchframe.plans.tables import CTES, Tables

CTES["pm"] = """SELECT *, 1 / odds_h / s AS m_home, 1 / odds_d / s AS m_draw, 1 / odds_a / s AS m_away
FROM (SELECT p.*, 1 / odds_h + 1 / odds_d + 1 / odds_a AS s FROM @probs AS p) AS x"""
PICK = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END"
MPICK = PICK.replace("p_", "m_")
PA = "CASE target WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END"
MA = PA.replace("p_", "m_")
BRIER = "pow(p_home - CASE WHEN target = 0 THEN 1 ELSE 0 END, 2) + pow(p_draw - CASE WHEN target = 1 THEN 1 ELSE 0 END, 2) + pow(p_away - CASE WHEN target = 2 THEN 1 ELSE 0 END, 2)"
EDGES = A.bin_edges()
TRIPLE = "p_home:d8 p_draw:d8 p_away:d8"


def bin_sql(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} < {EDGES[i + 1]!r}::DOUBLE THEN {i}" for i in range(9)) + " ELSE 9 END"


def named_triple(p) -> list:
    return [c.alias(n) for n, c in zip(X.P, p, strict=True)]


# --- P ---------------------------------------------------------------------


@query(
    "P1_odds_to_probs",
    "match_id:i market_home_prob:d8 market_draw_prob:d8 market_away_prob:d8 market_margin:d8 market_favorite_class:i market_favorite_prob:d8",
    f"""SELECT match_id, m_home AS market_home_prob, m_draw AS market_draw_prob, m_away AS market_away_prob, s - 1 AS market_margin, {MPICK} AS market_favorite_class,
      greatest(m_home, m_draw, m_away) AS market_favorite_prob FROM @pm""",
)
def p1(t: Tables):
    return t.probs.withColumns(X.odds_to_probs(F.col("odds_h"), F.col("odds_d"), F.col("odds_a")))


_BOOK_PRICES = """SELECT match_id, CASE WHEN match_id % 3 = 0 THEN odds_h END AS AvgCH, odds_d AS AvgCD, odds_a AS AvgCA,
  CASE WHEN match_id % 5 = 0 THEN 1.0 ELSE odds_h + 0.1 END AS B365H, odds_d AS B365D, odds_a AS B365A, odds_h + 0.2 AS AvgH, odds_d AS AvgD, odds_a AS AvgA FROM @probs"""


@query(
    "P2_select_odds",
    "match_id:i mode:s home_odds:d4 odds_source:s",
    f"""WITH b AS ({_BOOK_PRICES})
    SELECT match_id, 'benchmark' AS mode, coalesce(AvgCH, AvgH) AS home_odds, CASE WHEN AvgCH IS NOT NULL THEN 'average closing odds' ELSE 'average listed odds' END AS odds_source FROM b
    UNION ALL SELECT match_id, 'research', CASE WHEN B365H > 1 THEN B365H ELSE coalesce(AvgCH, AvgH) END, CASE WHEN B365H > 1 THEN 'Bet365 listed odds' WHEN AvgCH IS NOT NULL THEN 'average closing odds' ELSE 'average listed odds' END FROM b
    UNION ALL SELECT match_id, 'preclosing', AvgH, 'average pre-closing odds' FROM b UNION ALL SELECT match_id, 'none', NULL, NULL FROM b""",
)
def p2(t: Tables):
    return T.select_odds_by_mode(t.sql(_BOOK_PRICES), ("benchmark", "research", "preclosing", "none"))


@query("P3_fair_odds", "match_id:i h:d8 d:d8 a:d8", "SELECT match_id, 1 / p_home AS h, 1 / p_draw AS d, 1 / p_away AS a FROM @probs")
def p3(t: Tables):
    f = X.fair_odds(X.triple())
    return t.probs.select("match_id", f[0].alias("h"), f[1].alias("d"), f[2].alias("a"))


@query(
    "P4_market_edges",
    "match_id:i edge_home:d8 edge_draw:d8 edge_away:d8",
    "SELECT match_id, p_home - m_home AS edge_home, p_draw - m_draw AS edge_draw, p_away - m_away AS edge_away FROM @pm",
)
def p4(t: Tables):
    return A.disagreement_table(t.pm).select("match_id", "edge_home", "edge_draw", "edge_away")


@query(
    "P5_normalize_probs",
    "match_id:i " + TRIPLE,
    """WITH c AS (SELECT match_id, least(greatest(hxg, 1e-15), 1) AS h, least(greatest(axg, 1e-15), 1) AS d, least(greatest(hxg - axg, 1e-15), 1) AS a FROM @matches)
    SELECT match_id, h / (h + d + a) AS p_home, d / (h + d + a) AS p_draw, a / (h + d + a) AS p_away FROM c""",
)
def p5(t: Tables):
    p = X.normalize_probs((F.col("hxg"), F.col("axg"), F.col("hxg") - F.col("axg")))
    return t.matches.select("match_id", *named_triple(p))


@query(
    "P6_temperature_scale",
    "match_id:i " + TRIPLE,
    """WITH c AS (SELECT match_id, exp(ln(p_home) / 1.5) AS h, exp(ln(p_draw) / 1.5) AS d, exp(ln(p_away) / 1.5) AS a FROM @probs)
    SELECT match_id, h / (h + d + a) AS p_home, d / (h + d + a) AS p_draw, a / (h + d + a) AS p_away FROM c""",
)
def p6(t: Tables):
    return t.probs.select("match_id", *named_triple(X.temperature_scale(X.triple(), F.lit(1.5))))


_TEMP = "(SELECT unnest([" + ", ".join(map(str, T.TEMPERATURES)) + "]::DOUBLE[]) AS temperature) AS g"
_TEMP_LOSS = f"""SELECT {{k}}temperature, avg(-ln(pow(pa, 1 / temperature) / (pow(p_home, 1 / temperature) + pow(p_draw, 1 / temperature) + pow(p_away, 1 / temperature)))) AS loss
  FROM (SELECT *, {PA} AS pa FROM {{src}}) AS x, {_TEMP} GROUP BY {{k}}temperature"""


@query(
    "P7_choose_temperature",
    "season:i temperature:d4 loss:d6",
    f"WITH l AS ({_TEMP_LOSS.format(k='season, ', src='@probs')}) SELECT season, min_by(temperature, loss) AS temperature, min(loss) AS loss FROM l GROUP BY season",
)
def p7(t: Tables):
    return T.choose_temperature(t.probs, ["season"])


@query(
    "P8_blend",
    "match_id:i " + TRIPLE,
    "SELECT match_id, 0.3 * p_home + 0.7 * m_home AS p_home, 0.3 * p_draw + 0.7 * m_draw AS p_draw, 0.3 * p_away + 0.7 * m_away AS p_away FROM @pm",
)
def p8(t: Tables):
    return t.pm.select("match_id", *named_triple(X.blend(X.triple(), X.triple(T.MARKET), F.lit(0.3))))


def weights_sql(name: str, ws: list[float]) -> str:
    return f"(SELECT unnest([{', '.join(map(repr, ws))}]::DOUBLE[]) AS {name}) AS g"


@query(
    "P9_tune_blend",
    "season:i weight:d4 loss:d6",
    f"""WITH l AS (SELECT season, weight, avg(-ln(weight * pa + (1 - weight) * ma)) AS loss FROM (SELECT *, {PA} AS pa, {MA} AS ma FROM @pm) AS x, {weights_sql("weight", T.BLEND_WEIGHTS)} GROUP BY ALL)
    SELECT season, min_by(weight, loss) AS weight, min(loss) AS loss FROM l GROUP BY season""",
)
def p9(t: Tables):
    return T.tune_blend(t.pm, keys=["season"])


_CUT = """d AS (SELECT match_date, count(*) AS n FROM {src} GROUP BY match_date), c AS (SELECT match_date, sum(n) OVER (ORDER BY match_date) AS c, sum(n) OVER () AS tot FROM d),
  k AS (SELECT min(match_date) AS cutoff FROM c WHERE c > floor(tot * 0.8 + 1e-9))"""


@query(
    "P9_tempered_blend",
    "weight:d4 temperature:d4 loss:d6",
    f"""WITH {_CUT.format(src="@pm")}, late AS (SELECT pm.*, {PA} AS pa, {MA} AS ma FROM @pm AS pm, k WHERE match_date >= cutoff),
    tl AS (SELECT temperature, avg(-ln(pow(pa, 1 / temperature) / (pow(p_home, 1 / temperature) + pow(p_draw, 1 / temperature) + pow(p_away, 1 / temperature)))) AS loss FROM late, {_TEMP} GROUP BY temperature),
    b AS (SELECT min_by(temperature, loss) AS tt FROM tl),
    sc AS (SELECT pow(pa, 1 / tt) / (pow(p_home, 1 / tt) + pow(p_draw, 1 / tt) + pow(p_away, 1 / tt)) AS pa, ma FROM late, b),
    l AS (SELECT weight, avg(-ln(weight * pa + (1 - weight) * ma)) AS loss FROM sc, {weights_sql("weight", T.COARSE_WEIGHTS)} GROUP BY weight)
    SELECT min_by(weight, loss) AS weight, min(loss) AS loss, any_value(tt) AS temperature FROM l, b""",
)
def p9_tempered(t: Tables):
    return T.tempered_blend(t.pm)


@query(
    "P10_tune_residual",
    "season:i weight:d4 loss:d6",
    f"""WITH q AS (SELECT season, weight, target, least(greatest(m_home + weight * (p_home - m_home), 1e-15), 1) AS h, least(greatest(m_draw + weight * (p_draw - m_draw), 1e-15), 1) AS d,
      least(greatest(m_away + weight * (p_away - m_away), 1e-15), 1) AS a FROM @pm, {weights_sql("weight", T.RESIDUAL_WEIGHTS)}),
    l AS (SELECT season, weight, avg(-ln(CASE target WHEN 0 THEN h WHEN 1 THEN d ELSE a END / (h + d + a))) AS loss FROM q GROUP BY ALL)
    SELECT season, min_by(weight, loss) AS weight, min(loss) AS loss FROM l GROUP BY season""",
)
def p10(t: Tables):
    return T.tune_residual(t.pm, ["season"])


META = [
    *[f"{n}_{c}" for n in ("model", "market") for c in ("home_logit_vs_draw", "away_logit_vs_draw", "home_prob", "draw_prob", "away_prob", "favorite_prob")],
    "edge_home", "edge_draw", "edge_away", "abs_edge_max", "model_minus_market_favorite",
]


def _meta_sql() -> str:
    out = []
    for n, v in (("model", "p"), ("market", "m")):
        out += [f"ln({v}_home / {v}_draw) AS {n}_home_logit_vs_draw", f"ln({v}_away / {v}_draw) AS {n}_away_logit_vs_draw"]
        out += [f"{v}_{c} AS {n}_{c}_prob" for c in ("home", "draw", "away")]
        out.append(f"greatest({v}_home, {v}_draw, {v}_away) AS {n}_favorite_prob")
    out += [f"p_{c} - m_{c} AS edge_{c}" for c in ("home", "draw", "away")]
    out.append("greatest(abs(p_home - m_home), abs(p_draw - m_draw), abs(p_away - m_away)) AS abs_edge_max")
    out.append("greatest(p_home, p_draw, p_away) - greatest(m_home, m_draw, m_away) AS model_minus_market_favorite")
    return f"SELECT match_id, {', '.join(out)} FROM @pm"


@query("P11_meta_features", "match_id:i " + " ".join(c + ":d8" for c in META), _meta_sql())
def p11(t: Tables):
    return t.pm.select("match_id", *[c.alias(n) for n, c in T.meta_features(t.pm).items()])


@query(
    "P13_draw_overlay",
    "match_id:i " + TRIPLE,
    """SELECT match_id, CASE WHEN hit THEN p_home * (1 - nd) / (p_home + p_away) ELSE p_home END AS p_home, CASE WHEN hit THEN nd ELSE p_draw END AS p_draw,
      CASE WHEN hit THEN p_away * (1 - nd) / (p_home + p_away) ELSE p_away END AS p_away
    FROM (SELECT *, p_draw + 0.04 * (1 - p_draw) AS nd, hxg >= 1.5 AND abs(p_home - p_away) <= 0.12 AS hit FROM @probs) AS x""",
)
def p13(t: Tables):
    mask = T.overlay_mask(
        F.lit("draw_score_and_low_spread"), F.col("hxg"), F.abs(F.col("p_home") - F.col("p_away")), F.lit(1.5), F.lit(0.12)
    )
    return t.probs.select("match_id", *named_triple(X.draw_overlay(X.triple(), mask, F.lit(0.04))))


def _overlay_sql() -> str:
    vals = ["('none', 0, 0.08::DOUBLE, 0.0::DOUBLE)"]
    for s in T.STRATEGIES:
        for i in range(4):
            for j in range(4):
                if (s == "draw_score" and j) or (s == "low_spread" and i):
                    continue
                vals += [f"('{s}', {i}, {T.SPREADS[j]}::DOUBLE, {b}::DOUBLE)" for b in T.BOOSTS]
    y = [f"CASE WHEN target = {i} THEN 1.0 ELSE 0.0 END" for i in range(3)]
    cal = lambda c: f"max(CASE WHEN is_test = 0 THEN {c} END)"
    tst = lambda c: f"max(CASE WHEN is_test = 1 THEN {c} END)"
    return f"""WITH {_CUT.format(src="@probs")}, r AS (SELECT p.*, CASE WHEN match_date >= cutoff THEN 1 ELSE 0 END AS is_test, hxg / 3 AS sc FROM @probs AS p, k),
    th AS (SELECT quantile_cont(sc, [0.5, 0.6, 0.7, 0.8]) AS q FROM r WHERE is_test = 0),
    w AS (SELECT r.*, g.strategy, q[g.ti + 1] AS threshold, g.sp AS spread_threshold, g.boost, CASE g.strategy WHEN 'none' THEN false WHEN 'draw_score' THEN sc >= q[g.ti + 1]
      WHEN 'low_spread' THEN abs(p_home - p_away) <= g.sp ELSE sc >= q[g.ti + 1] AND abs(p_home - p_away) <= g.sp END AS m FROM r, th, (VALUES {", ".join(vals)}) AS g(strategy, ti, sp, boost)),
    z0 AS (SELECT *, p_home / (p_home + p_draw + p_away) AS ph, p_draw / (p_home + p_draw + p_away) AS pd, p_away / (p_home + p_draw + p_away) AS pw FROM w),
    z AS (SELECT *, CASE WHEN m THEN pd + boost * (1.0::DOUBLE - pd) ELSE pd END AS nd FROM z0), z1 AS (SELECT *, (1.0::DOUBLE - nd) / (ph + pw) AS sc2 FROM z),
    s AS (SELECT strategy, threshold, spread_threshold, boost, is_test, m, target, ph * sc2 / (ph * sc2 + nd + pw * sc2) AS h, nd / (ph * sc2 + nd + pw * sc2) AS d, pw * sc2 / (ph * sc2 + nd + pw * sc2) AS a FROM z1),
    cl AS (SELECT *, unnest([0, 1, 2]) AS kk, unnest([h, d, a]) AS p, unnest([{", ".join(y)}]) AS y FROM s),
    bn AS (SELECT strategy, threshold, spread_threshold, boost, is_test, kk, {bin_sql("p")} AS b, count(*) AS n, abs(sum(y) - sum(p)) AS e FROM cl GROUP BY ALL),
    ec AS (SELECT strategy, threshold, spread_threshold, boost, is_test, sum(e) / sum(n) AS ece FROM bn GROUP BY ALL),
    sm AS (SELECT strategy, threshold, spread_threshold, boost, is_test, avg(-ln(CASE target WHEN 0 THEN h WHEN 1 THEN d ELSE a END)) AS ll,
      avg(pow(h - {y[0]}, 2) + pow(d - {y[1]}, 2) + pow(a - {y[2]}, 2)) AS br, count(*) FILTER (WHERE m) AS adj FROM s GROUP BY ALL),
    f AS (SELECT strategy, threshold, spread_threshold, boost, {cal("ll")} AS calibration_log_loss, {cal("br")} AS calibration_brier, {cal("ece")} AS calibration_ece, {cal("adj")} AS calibration_adjusted,
      {tst("ll")} AS test_log_loss, {tst("br")} AS test_brier, {tst("ece")} AS test_ece, {tst("adj")} AS test_adjusted FROM sm JOIN ec USING (strategy, threshold, spread_threshold, boost, is_test) GROUP BY ALL),
    o AS (SELECT * FROM f WHERE strategy = 'none' OR calibration_adjusted >= 20),
    v AS (SELECT o.*, row_number() OVER (PARTITION BY o.strategy = 'none' ORDER BY CASE WHEN o.calibration_log_loss < n.calibration_log_loss AND o.calibration_brier - n.calibration_brier <= 0.001
      AND o.calibration_ece - n.calibration_ece <= 0.01 THEN 0 ELSE 1 END, o.calibration_log_loss, o.calibration_brier) AS rn FROM o, (SELECT * FROM f WHERE strategy = 'none') AS n)
    SELECT *, CASE WHEN strategy <> 'none' AND rn = 1 THEN 1 ELSE 0 END AS selected FROM v"""


@query(
    "P14_tune_draw_overlay",
    "strategy:s threshold:d6 spread_threshold:d3 boost:d3 calibration_log_loss:d6 calibration_brier:d6 calibration_ece:d6 calibration_adjusted:i test_log_loss:d6 test_brier:d6 test_ece:d6 test_adjusted:i selected:i",
    _overlay_sql(),
)
def p14(t: Tables):
    rows = T.time_split(t.probs.withColumn("draw_score", F.col("hxg") / 3))
    return T.tune_draw_overlay(rows)


_IMPACT = "least(0.004 + 0.010 * least(greatest(expected_starter, 0), 1) + 0.026 * least(greatest(importance_score, 0), 1) + CASE WHEN matches_remaining >= 2 THEN 0.004 ELSE 0 END, 0.04)"


@query(
    "P15_suspension_adjust",
    "match_id:i home_impact:d6 away_impact:d6 adj_p_home:d8 adj_p_draw:d8 adj_p_away:d8",
    f"""WITH j AS (SELECT t.match_id, t.is_home, least(sum({_IMPACT}), 0.06) AS i FROM @t t JOIN @suspensions a ON a.team = t.team AND a.suspended_from <= t.match_date
      AND a.matches_remaining > 0 AND (a.suspended_until IS NULL OR a.suspended_until >= t.match_date) GROUP BY ALL),
    w AS (SELECT match_id, max(CASE WHEN is_home = 1 THEN i END) AS hi, max(CASE WHEN is_home = 0 THEN i END) AS ai FROM j GROUP BY match_id),
    a AS (SELECT p.match_id, coalesce(hi, 0) AS hi, coalesce(ai, 0) AS ai, p_home, p_draw, p_away FROM @probs p LEFT JOIN w USING (match_id)),
    b AS (SELECT *, CASE WHEN hi > 0 THEN least(hi, p_home - 1e-9) ELSE 0 END AS x FROM a),
    c AS (SELECT *, p_home - x AS h, p_draw + x * 0.35 AS d, p_away + x * 0.65 AS w FROM b), e AS (SELECT *, CASE WHEN ai > 0 THEN least(ai, w - 1e-9) ELSE 0 END AS y FROM c)
    SELECT match_id, hi AS home_impact, ai AS away_impact, h + y * 0.65 AS adj_p_home, d + y * 0.35 AS adj_p_draw, w - y AS adj_p_away FROM e""",
)
def p15(t: Tables):
    return V.suspension_adjust(t.probs, t.long, t.suspensions)


def prior_sql(gap: str, w: str, z: tuple[str, str, str]) -> str:
    e = [f"exp({x})" for x in z]
    tot = " + ".join(e)
    return ", ".join(f"(1 - {w}) * p_{c} + {w} * {x} / ({tot}) AS adj_p_{c}" for c, x in zip(("home", "draw", "away"), e, strict=True))


CTES["team_scores"] = "SELECT DISTINCT team, CAST(team % 17 AS DOUBLE) / 16 AS score, CAST(team % 13 AS DOUBLE) / 6 - 1 AS strength FROM @t WHERE team % 7 <> 0"


@query(
    "P16_squad_prior",
    "match_id:i squad_prior_weight:d4 adj_p_home:d8 adj_p_draw:d8 adj_p_away:d8",
    f"""WITH n AS (SELECT match_id, row_number() OVER (PARTITION BY team, season ORDER BY match_date, match_id) AS k FROM @t),
    f AS (SELECT match_id, min(k) AS ph FROM n GROUP BY match_id),
    j AS (SELECT p.*, CASE WHEN ph <= 5 THEN 0.08 WHEN ph <= 12 THEN 0.05 ELSE 0.025 END AS w, h.score - a.score AS g FROM @probs p JOIN f USING (match_id)
      LEFT JOIN @team_scores h ON h.team = p.home LEFT JOIN @team_scores a ON a.team = p.away)
    SELECT match_id, w AS squad_prior_weight, {prior_sql("g", "w", ("0.18 + 0.65 * g", "-0.05 - 0.04 * abs(g)", "-0.18 - 0.65 * g"))} FROM j WHERE g IS NOT NULL
    UNION ALL SELECT match_id, w, p_home, p_draw, p_away FROM j WHERE g IS NULL""",
)
def p16(t: Tables):
    return T.squad_prior(t.probs, t.team_scores)


@query(
    "P17_long_term_prior",
    "match_id:i adj_p_home:d8 adj_p_draw:d8 adj_p_away:d8",
    f"""WITH j AS (SELECT p.*, coalesce(h.strength, 0) - coalesce(a.strength, 0) AS g FROM @probs p LEFT JOIN @team_scores h ON h.team = p.home LEFT JOIN @team_scores a ON a.team = p.away)
    SELECT match_id, {prior_sql("g", "0.35", ("0.22 + 0.52 * g", "-0.06 - 0.05 * abs(g)", "-0.22 - 0.52 * g"))} FROM j""",
)
def p17(t: Tables):
    return T.long_term_prior(t.probs, t.team_scores)


CTES["goal_rows"] = "SELECT *, hxg AS home_xg_avg, axg AS away_xg_avg, CASE WHEN match_id % 9 = 0 THEN NULL ELSE axg END AS home_xga_avg, hxg / 2 AS away_xga_avg FROM @probs"
_EG = """e AS (SELECT *, least(greatest((0.55 * CASE WHEN home_xg_avg > 0 THEN home_xg_avg ELSE 1.45 END + 0.45 * CASE WHEN away_xga_avg > 0 THEN away_xga_avg ELSE 1.45 END) * exp(0.22 * (p_home - p_away)), 0.2), 4.0) AS eh,
  least(greatest((0.55 * CASE WHEN away_xg_avg > 0 THEN away_xg_avg ELSE 1.15 END + 0.45 * CASE WHEN home_xga_avg > 0 THEN home_xga_avg ELSE 1.15 END) * exp(-0.22 * (p_home - p_away)), 0.2), 4.0) AS ea FROM @goal_rows),
  g0 AS (SELECT match_id, hg, ag, p_home, p_draw, p_away, i AS h, j AS a, exp(-eh) * pow(eh, i) / factorial(i::INT) * exp(-ea) * pow(ea, j) / factorial(j::INT) AS p FROM e, generate_series(0, 6) AS x(i), generate_series(0, 6) AS y(j)),
  g AS (SELECT *, p / sum(p) OVER (PARTITION BY match_id) AS q, sum(p) OVER (PARTITION BY match_id, sign(h - a)) AS bt FROM g0),
  al AS (SELECT match_id, hg, ag, p_home, p_draw, p_away, h, a, p / bt * CASE WHEN h > a THEN p_home WHEN h = a THEN p_draw ELSE p_away END AS p FROM g)"""


@query("P18_expected_goals", "match_id:i expected_home_goals:d8 expected_away_goals:d8", f"WITH {_EG} SELECT match_id, eh AS expected_home_goals, ea AS expected_away_goals FROM e")
def p18(t: Tables):
    return S.expected_goals(t.goal_rows)


@query("P19_scoreline_grid", "match_id:i h:i a:i p:d8", f"WITH {_EG} SELECT match_id, h, a, q AS p FROM g")
def p19(t: Tables):
    return S.scoreline_grid(S.with_cells(S.expected_goals(t.goal_rows)))


@query("P20_align_scorelines", "match_id:i home:d8 draw:d8 away:d8 top:d8",
       f"WITH {_EG} SELECT match_id, sum(p) FILTER (WHERE h > a) AS home, sum(p) FILTER (WHERE h = a) AS draw, sum(p) FILTER (WHERE h < a) AS away, max(p) AS top FROM al GROUP BY match_id")
def p20(t: Tables):
    grid = S.scoreline_grid(S.estimate_scorelines(t.goal_rows))
    return S.bucket_probabilities(grid).join(grid.groupBy("match_id").agg(F.max("p").alias("top")), "match_id")


@query(
    "P21_top_scorelines",
    "match_id:i bucket:s rank:i h:i a:i p:d8",
    f"""WITH {_EG}, l AS (SELECT match_id, 'all' AS bucket, 5 AS lim, h, a, p FROM al UNION ALL SELECT match_id, CASE WHEN h > a THEN 'home' WHEN h = a THEN 'draw' ELSE 'away' END, 3, h, a, p FROM al),
    r AS (SELECT *, row_number() OVER (PARTITION BY match_id, bucket ORDER BY round(p, 12) DESC, h, a) AS rank FROM l) SELECT * FROM r WHERE rank <= lim""",
)
def p21(t: Tables):
    return S.top_scorelines(S.estimate_scorelines(t.goal_rows))


@query(
    "P21_predicted_scoreline",
    "match_id:i pred_h:i pred_a:i pred_p:d8",
    f"""WITH {_EG}, b AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, h, a) AS rn FROM (SELECT *, {PICK} AS pk FROM al) AS x
      WHERE pk = CASE WHEN h > a THEN 0 WHEN h = a THEN 1 ELSE 2 END) SELECT match_id, h AS pred_h, a AS pred_a, p AS pred_p FROM b WHERE rn = 1""",
)
def p21_pick(t: Tables):
    return S.estimate_scorelines(t.goal_rows)


# --- A ---------------------------------------------------------------------

_SCORE = f"count(*) AS matches, avg(CASE WHEN {PICK} = target THEN 1.0 ELSE 0 END) AS accuracy, avg(-ln({PA})) AS log_loss, avg({BRIER}) AS brier_score"


@query("A1_score_probs", "pool:i matches:i accuracy:d8 log_loss:d8 brier_score:d8", f"SELECT pool, {_SCORE} FROM @probs GROUP BY pool")
def a1(t: Tables):
    return A.score_probs(t.probs, ["pool"])


@query("A1_confusion", "season:i actual:i predicted:i n:i", f"SELECT season, target AS actual, {PICK} AS predicted, count(*) AS n FROM @probs GROUP BY ALL")
def a1_confusion(t: Tables):
    return A.confusion(t.probs, ["season"])


def class_rows(src: str, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS class, {i} AS k, p_{o} AS p, CASE WHEN target = {i} THEN 1.0 ELSE 0 END AS y, {PICK} AS pk FROM {src}"
        for i, (c, o) in enumerate(zip(A.CLASSES, ("home", "draw", "away"), strict=True))
    )


@query("A2_brier_by_class", "season:i class:s brier:d8", f"WITH c AS ({class_rows('@probs', 'season')}) SELECT season, class, avg(pow(p - y, 2)) AS brier FROM c GROUP BY ALL")
def a2(t: Tables):
    return A.brier_by_class(t.probs, ["season"])


def cal_sql(src: str, keys: str) -> str:
    edges = "([" + ", ".join(repr(e) for e in EDGES) + "]::DOUBLE[])"
    return f"""SELECT {keys}, class, bin, {edges}[bin + 1] AS bin_lower, {edges}[bin + 2] AS bin_upper, count(*) AS "count", avg(p) AS mean_predicted_probability, avg(y) AS observed_frequency
      FROM (SELECT *, {bin_sql("p")} AS bin FROM ({class_rows(src, keys)}) AS c) AS b GROUP BY {keys}, class, bin"""


@query("A3_calibration_table", "season:i class:s bin:i bin_lower:d4 bin_upper:d4 count:i mean_predicted_probability:d8 observed_frequency:d8", cal_sql("@probs", "season"))
def a3(t: Tables):
    return A.calibration_table(t.probs, ["season"])


_ERR = "(observed_frequency - mean_predicted_probability)"


@query(
    "A4_calibration_summary",
    "season:i class:s mean_absolute_calibration_error:d8 mean_signed_calibration_error:d8 diagnosis:s ece:d8",
    f"""WITH c AS ({cal_sql("@probs", "season")}), s AS (SELECT season, class, sum(abs({_ERR}) * "count") / sum("count") AS a, sum({_ERR} * "count") / sum("count") AS g FROM c GROUP BY ALL),
    e AS (SELECT season, sum(abs({_ERR}) * "count") / sum("count") AS ece FROM c GROUP BY season)
    SELECT season, class, a AS mean_absolute_calibration_error, g AS mean_signed_calibration_error, CASE WHEN g < -0.02 THEN 'overconfident / overpredicted'
      WHEN g > 0.02 THEN 'underconfident / underpredicted' ELSE 'reasonably calibrated' END AS diagnosis, ece FROM s JOIN e USING (season)""",
)
def a4(t: Tables):
    table = A.calibration_table(t.probs, ["season"])
    return A.calibration_summary(table, ["season"]).join(A.ece(table, ["season"]), "season")


@query(
    "A5_class_performance",
    "season:i class:s support:i one_vs_rest_brier:d8 actual_class_accuracy:d8 actual_class_mean_probability:d8 actual_class_log_loss:d8",
    f"""WITH c AS ({class_rows("@probs", "season")}) SELECT season, class, sum(y) AS support, avg(pow(p - y, 2)) AS one_vs_rest_brier,
      avg(CASE WHEN pk = k THEN 1.0 ELSE 0 END) FILTER (WHERE y = 1) AS actual_class_accuracy, avg(p) FILTER (WHERE y = 1) AS actual_class_mean_probability,
      avg(-ln(p)) FILTER (WHERE y = 1) AS actual_class_log_loss FROM c GROUP BY ALL""",
)
def a5(t: Tables):
    return A.class_performance(t.probs, ["season"])


@query(
    "A6_confidence_table",
    "season:i bin:i count:i mean_confidence:d8 accuracy:d8 confidence_minus_accuracy:d8",
    f"""WITH c AS (SELECT season, greatest(p_home, p_draw, p_away) AS p, CASE WHEN {PICK} = target THEN 1.0 ELSE 0 END AS hit FROM @probs)
    SELECT season, {bin_sql("p")} AS bin, count(*) AS "count", avg(p) AS mean_confidence, avg(hit) AS accuracy, avg(p) - avg(hit) AS confidence_minus_accuracy FROM c GROUP BY ALL""",
)
def a6(t: Tables):
    return A.confidence_table(t.probs, ["season"])


@query(
    "A7_worst_predictions",
    "match_id:i predicted:i predicted_confidence:d8 individual_log_loss:d8",
    f"SELECT match_id, {PICK} AS predicted, greatest(p_home, p_draw, p_away) AS predicted_confidence, -ln({PA}) AS individual_log_loss FROM @probs ORDER BY 4 DESC, 1 LIMIT 25",
)
def a7(t: Tables):
    return A.worst_predictions(t.probs)


_FLAGS = f"""SELECT match_id, home, away, CASE WHEN {PICK} <> target AND greatest(p_home, p_draw, p_away) > 0.70 THEN 1 ELSE 0 END AS high_confidence_wrong,
  CASE WHEN p_home >= greatest(p_draw, p_away) AND target <> 0 THEN 1 ELSE 0 END AS home_favorite_failure, CASE WHEN target = 1 AND {PICK} = 0 THEN 1 ELSE 0 END AS draw_as_home,
  CASE WHEN coalesce(hs, 0) + 15 > 30 OR coalesce(as_, 0) + 15 > 30 THEN 1 ELSE 0 END AS suspicious_rest_gap, CASE WHEN home % 10 = 3 OR away % 10 = 3 THEN 1 ELSE 0 END AS promoted_team_involved FROM @probs"""


def _flagged(t: Tables):
    rest = tuple(F.coalesce(F.col(c), F.lit(0)) + 15 for c in ("hs", "as_"))
    return A.failure_flags(t.probs, rest=rest, promoted=(F.col("home") % 10 == 3) | (F.col("away") % 10 == 3))


@query("A7_failure_flags", "match_id:i high_confidence_wrong:i home_favorite_failure:i draw_as_home:i suspicious_rest_gap:i promoted_team_involved:i", _FLAGS)
def a7_flags(t: Tables):
    return _flagged(t)


@query("A7_failure_teams", "team:i n:i", f"WITH f AS ({_FLAGS}) SELECT team, count(*) AS n FROM (SELECT home AS team FROM f WHERE high_confidence_wrong = 1 UNION ALL SELECT away FROM f WHERE high_confidence_wrong = 1) AS x GROUP BY team")
def a7_teams(t: Tables):
    return A.failure_teams(_flagged(t))


_LEAST = "CASE WHEN p_home <= p_draw AND p_home <= p_away THEN 0 WHEN p_draw <= p_away THEN 1 ELSE 2 END"
_DRAWS = f"""coalesce(sum(CASE WHEN target = 1 AND {PICK} = 1 THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN target = 1 THEN 1.0 ELSE 0 END), 0), 0) AS draw_recall,
  coalesce(sum(CASE WHEN target = 1 AND {PICK} = 1 THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN {PICK} = 1 THEN 1.0 ELSE 0 END), 0), 0) AS draw_precision,
  avg(-ln(p_draw)) FILTER (WHERE target = 1) AS draw_log_loss_on_draws, -avg(CASE WHEN target = 1 THEN ln(p_draw) ELSE ln(1 - p_draw) END) AS draw_log_loss,
  avg(CASE WHEN {_LEAST} <> 1 THEN 1.0 ELSE 0 END) AS draw_top2_rate, avg(CASE WHEN target = 1 THEN 1.0 ELSE 0 END) AS actual_draw_rate, avg(CASE WHEN {PICK} = 1 THEN 1.0 ELSE 0 END) AS predicted_draw_top1_rate,
  avg(p_draw) AS mean_draw_probability, avg(p_draw) - avg(CASE WHEN target = 1 THEN 1.0 ELSE 0 END) AS draw_probability_gap, avg(CASE WHEN {_LEAST} <> target THEN 1.0 ELSE 0 END) AS double_chance_hit_rate"""
_DRAW_COLS = "draw_recall draw_precision draw_log_loss_on_draws draw_log_loss draw_top2_rate actual_draw_rate predicted_draw_top1_rate mean_draw_probability draw_probability_gap double_chance_hit_rate draw_calibration_error".split()


@query(
    "A8_draw_metrics",
    "season:i " + " ".join(c + ":d8" for c in _DRAW_COLS),
    f"""WITH c AS ({cal_sql("@probs", "season")}), e AS (SELECT season, sum(abs({_ERR}) * "count") / sum("count") AS draw_calibration_error FROM c WHERE class = 'draw' GROUP BY season),
    m AS (SELECT season, {_DRAWS} FROM @probs GROUP BY season) SELECT * FROM m JOIN e USING (season)""",
)
def a8(t: Tables):
    return A.draw_metrics(t.probs, ["season"])


_SEGMENTS = "SELECT *, unnest(list_filter(['all', CASE WHEN p_home > 0.5 THEN 'home_favorite' END, CASE WHEN hg + ag <= 2 THEN 'low_scoring' END], lambda x: x IS NOT NULL)) AS segment FROM @probs"


@query(
    "A9_segment_metrics",
    "segment:s matches:i accuracy:d8 log_loss:d8 brier_score:d8 ece:d8 draw_recall:d8 draw_log_loss:d8",
    f"""WITH s AS ({_SEGMENTS}), c AS ({cal_sql("s", "segment")}), e AS (SELECT segment, sum(abs({_ERR}) * "count") / sum("count") AS ece FROM c GROUP BY segment),
    m AS (SELECT segment, {_SCORE}, {_DRAWS} FROM s GROUP BY segment) SELECT * FROM m JOIN e USING (segment)""",
)
def a9(t: Tables):
    return A.segment_metrics(t.probs, {"all": F.lit(True), "home_favorite": F.col("p_home") > 0.5, "low_scoring": F.col("hg") + F.col("ag") <= 2})


_SM = "correct_score_accuracy top_3_hit_rate top_5_hit_rate mean_probability_assigned_to_actual scoreline_log_loss mean_1x2_alignment_error max_1x2_alignment_error".split()


@query(
    "A10_scoreline_metrics",
    "season:i test_matches:i " + " ".join(c + ":d8" for c in _SM),
    f"""WITH {_EG}, r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, h, a) AS rn FROM al),
    m AS (SELECT match_id, max(rn) FILTER (WHERE h = hg AND a = ag) AS place, greatest(coalesce(max(p) FILTER (WHERE h = hg AND a = ag), 1e-15), 1e-15) AS pa FROM r GROUP BY match_id)
    SELECT p.season, count(*) AS test_matches, avg(CASE WHEN place = 1 THEN 1.0 ELSE 0 END) AS correct_score_accuracy, avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0 END) AS top_3_hit_rate,
      avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0 END) AS top_5_hit_rate, avg(pa) AS mean_probability_assigned_to_actual, -avg(ln(pa)) AS scoreline_log_loss, 0 AS mean_1x2_alignment_error, 0 AS max_1x2_alignment_error
    FROM m JOIN @probs p USING (match_id) GROUP BY p.season""",
)
def a10(t: Tables):
    return S.scoreline_metrics(S.estimate_scorelines(t.goal_rows), ["season"])


_DIS = f"""SELECT *, {PICK} AS model_pick, {MPICK} AS market_pick, greatest(abs(p_home - m_home), abs(p_draw - m_draw), abs(p_away - m_away)) AS max_abs_edge,
  -ln({PA}) AS model_log_loss, -ln({MA}) AS market_log_loss, CASE WHEN {PICK} = target THEN 1 ELSE 0 END AS model_correct, CASE WHEN {MPICK} = target THEN 1 ELSE 0 END AS market_correct FROM @pm"""


@query(
    "A11_disagreement_table",
    "match_id:i model_pick:i market_pick:i max_abs_edge:d8 model_log_loss:d8 market_log_loss:d8 model_correct:i market_correct:i edge_correct:i model_market_disagree:i",
    f"SELECT *, CASE WHEN model_correct = 1 AND model_log_loss < market_log_loss THEN 1 ELSE 0 END AS edge_correct, CASE WHEN model_pick <> market_pick THEN 1 ELSE 0 END AS model_market_disagree FROM ({_DIS}) AS d",
)
def a11(t: Tables):
    return A.disagreement_table(t.pm)


@query(
    "A11_disagreement_summary",
    "segment:s matches:i model_accuracy:d8 market_accuracy:d8 mean_abs_edge:d8",
    f"""WITH d AS ({_DIS}), q AS (SELECT quantile_cont(max_abs_edge, 0.75) AS q FROM d),
    s AS (SELECT 'all_test_matches' AS segment, * FROM d UNION ALL SELECT 'model_market_disagreements', * FROM d WHERE model_pick <> market_pick
      UNION ALL SELECT 'large_edges_top_quartile', d.* FROM d, q WHERE max_abs_edge >= q)
    SELECT segment, count(*) AS matches, avg(model_correct) AS model_accuracy, avg(market_correct) AS market_accuracy, avg(max_abs_edge) AS mean_abs_edge FROM s GROUP BY segment""",
)
def a11_summary(t: Tables):
    return A.disagreement_summary(A.disagreement_table(t.pm))


CTES["versions"] = """SELECT season, target, 'production' AS model_version, p_home, p_draw, p_away FROM @pm
UNION ALL SELECT season, target, 'market', m_home, m_draw, m_away FROM @pm
UNION ALL SELECT season, target, 'half', (p_home + m_home) / 2, (p_draw + m_draw) / 2, (p_away + m_away) / 2 FROM @pm"""


@query(
    "A12_metric_deltas",
    "model_version:s mean_log_loss_delta:d8 splits_log_loss_improved:i mean_brier_score_delta:d8 splits_brier_score_improved:i splits_tested:i",
    f"""WITH s AS (SELECT season, model_version, {_SCORE} FROM @versions GROUP BY season, model_version),
    j AS (SELECT a.*, a.log_loss - b.log_loss AS dl, a.brier_score - b.brier_score AS db FROM s a JOIN s b ON a.season = b.season AND b.model_version = 'production' AND a.model_version <> 'production')
    SELECT model_version, avg(dl) AS mean_log_loss_delta, count(*) FILTER (WHERE dl < 0) AS splits_log_loss_improved, avg(db) AS mean_brier_score_delta,
      count(*) FILTER (WHERE db < 0) AS splits_brier_score_improved, count(DISTINCT season) AS splits_tested FROM j GROUP BY model_version""",
)
def a12(t: Tables):
    return A.metric_deltas(A.score_probs(t.versions, ["season", "model_version"]), "production", ["log_loss", "brier_score"])


_CORR = ["hxg", "axg", "hs", "as_", "hst", "p_home", "p_draw"]


@query("A13_correlation", "a:s b:s corr:d8", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}::DOUBLE, {b}::DOUBLE) AS corr FROM @probs" for a in _CORR for b in _CORR if a != b))
def a13(t: Tables):
    return A.correlation(t.probs, _CORR)


_CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}::DOUBLE, {b}::DOUBLE)) AS c FROM @probs" for a in _CORR for b in _CORR if a != b)


@query(
    "A13_correlation_groups",
    "feature_group:s features:i mean_abs_corr:d8 max_abs_corr:d8 high_corr_pairs:i",
    f"""WITH p AS ({_CORR_SQL}), g AS (SELECT *, CASE WHEN a IN ('hxg', 'axg') THEN 'xg' WHEN a LIKE 'p%' THEN 'probs' ELSE 'shots' END AS ga,
      CASE WHEN b IN ('hxg', 'axg') THEN 'xg' WHEN b LIKE 'p%' THEN 'probs' ELSE 'shots' END AS gb FROM p)
    SELECT ga AS feature_group, count(DISTINCT a) AS features, avg(c) AS mean_abs_corr, max(c) AS max_abs_corr, count(*) FILTER (WHERE c >= 0.8) AS high_corr_pairs FROM g WHERE ga <> gb GROUP BY ga""",
)
def a13_groups(t: Tables):
    return A.correlation_groups(A.correlation(t.probs, _CORR), {"xg": ["hxg", "axg"], "probs": ["p_home", "p_draw"], "shots": ["hs", "as_", "hst"]})


@query("A13_most_correlated", "a:s mean_abs_corr:d8 max_abs_corr:d8 partner:s", f"WITH p AS ({_CORR_SQL}) SELECT a, avg(c) AS mean_abs_corr, max(c) AS max_abs_corr, max_by(b, c) AS partner FROM p GROUP BY a")
def a13_partner(t: Tables):
    return A.most_correlated(A.correlation(t.probs, _CORR))


@query(
    "A14_group_importance",
    "feature_group:s importance:d4",
    """WITH f AS (SELECT CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'home_elo' WHEN 1 THEN 'home_shots_avg' WHEN 2 THEN 'away_xg_avg' WHEN 3 THEN 'away_days_rest' ELSE 'misc' END AS feature, p_retailprice AS importance FROM part)
    SELECT CASE feature WHEN 'home_elo' THEN 'Elo' WHEN 'home_shots_avg' THEN 'Shot volume' WHEN 'away_xg_avg' THEN 'xG/xGA' WHEN 'away_days_rest' THEN 'Schedule/fatigue' ELSE 'Other' END AS feature_group,
      sum(importance) AS importance FROM f GROUP BY ALL""",
)
def a14(t: Tables):
    return A.group_importance(t.sql(
        "SELECT CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'home_elo' WHEN 1 THEN 'home_shots_avg' WHEN 2 THEN 'away_xg_avg' WHEN 3 THEN 'away_days_rest' ELSE 'misc' END AS feature, p_retailprice AS importance FROM part"
    ))


_O = "OVER (PARTITION BY team ORDER BY match_date, match_id)"
_EXPW = [f"CASE WHEN n > {a} THEN pow(0.75, {a}) ELSE 0 END" for a in range(5)]


@query(
    "A15_regime_change",
    "team:i mean_abs_points_recency_gap:d6 max_abs_points_recency_gap:d6 mean_abs_xg_recency_gap:d6 max_abs_xg_recency_gap:d6",
    f"""WITH l AS (SELECT team, least(row_number() {_O} - 1, 5) AS n, {", ".join(f"coalesce(lag(points, {a + 1}) {_O}, 0) AS p{a}, coalesce(lag(xgf, {a + 1}) {_O}, 0) AS x{a}" for a in range(5))} FROM @t),
    g AS (SELECT team, CASE WHEN n = 0 THEN 0 ELSE ({" + ".join(f"{w} * p{a}" for a, w in enumerate(_EXPW))}) / ({" + ".join(_EXPW)}) END - (p0 + p1 + p2 + p3 + p4) / 5.0 AS pg,
      CASE WHEN n = 0 THEN 0 ELSE ({" + ".join(f"{w} * x{a}" for a, w in enumerate(_EXPW))}) / ({" + ".join(_EXPW)}) - (x0 + x1 + x2 + x3 + x4) / n END AS xg FROM l)
    SELECT team, avg(abs(pg)) AS mean_abs_points_recency_gap, max(abs(pg)) AS max_abs_points_recency_gap, avg(abs(xg)) AS mean_abs_xg_recency_gap, max(abs(xg)) AS max_abs_xg_recency_gap FROM g GROUP BY team""",
)
def a15(t: Tables):
    weighted = R.recency_weighted(t.long).join(R.match_features(t.long), "match_id").join(t.matches.select("match_id", "home", "away"), "match_id")
    sides = F.inline(
        F.array(
            *[
                F.struct(
                    F.col(s).alias("team"),
                    (F.col(f"{s}_points_weighted_exponential") - F.col(f"{s}_points_last_5") / 5.0).alias("points_recency_gap"),
                    (F.col(f"{s}_xg_weighted_exponential") - F.col(f"{s}_xg_avg")).alias("xg_recency_gap"),
                )
                for s in ("home", "away")
            ]
        )
    )
    return A.regime_change(weighted.select(sides), ["points_recency_gap", "xg_recency_gap"])


_REST = "SELECT team, points, coalesce(match_date - max(match_date) OVER (PARTITION BY team ORDER BY match_date RANGE BETWEEN INTERVAL 100000 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 14) AS days_rest FROM @t"


def _rested(t: Tables):
    load = R.calendar_load(t.long).select("match_id", "is_home", "days_rest", "fixture_congestion_score")
    return t.long.select("match_id", "is_home", "team", "points").join(load, ["match_id", "is_home"])


@query(
    "A16_split_effect",
    "team:i matches_with:i mean_with:d8 mean_without:d8 delta:d8",
    f"""WITH r AS ({_REST}) SELECT team, count(*) FILTER (WHERE days_rest <= 4) AS matches_with, avg(points) FILTER (WHERE days_rest <= 4) AS mean_with,
      avg(points) FILTER (WHERE days_rest > 4) AS mean_without, avg(points) FILTER (WHERE days_rest <= 4) - avg(points) FILTER (WHERE days_rest > 4) AS delta FROM r GROUP BY team""",
)
def a16(t: Tables):
    return A.split_effect(_rested(t), F.col("days_rest") <= 4)


@query(
    "A17_group_correlation",
    "team:i correlation:d8",
    f"WITH r AS ({_REST}) SELECT team, CASE WHEN count(*) >= 10 AND count(DISTINCT days_rest) >= 2 THEN corr(days_rest::DOUBLE, points::DOUBLE) END AS correlation FROM r GROUP BY team",
)
def a17(t: Tables):
    return A.group_correlation(_rested(t), "days_rest")


_STYLES = """SELECT x.team, x.points, CAST((x.match_id * 3 + x.team) % 6 AS INT) AS style, CAST((x.match_id * 3 + x.opponent) % 6 AS INT) AS opp FROM @t AS x"""


@query(
    "A18_style_performance",
    "view:s a:i b:i matches:i points_per_match:d8",
    f"""WITH s AS ({_STYLES}) SELECT 'style' AS view, style AS a, -1 AS b, count(*) AS matches, avg(points) AS points_per_match FROM s GROUP BY ALL
    UNION ALL SELECT 'team_vs_style', team, opp, count(*), avg(points) FROM s GROUP BY ALL UNION ALL SELECT 'matchup', style, opp, count(*), avg(points) FROM s GROUP BY ALL""",
)
def a18(t: Tables):
    s = t.sql(_STYLES)
    parts = []
    for view, keys in (("style", ["style"]), ("team_vs_style", ["team", "opp"]), ("matchup", ["style", "opp"])):
        p = A.style_performance(s, keys)
        b = F.col(keys[1]) if len(keys) > 1 else F.lit(-1)
        parts.append(p.select(F.lit(view).alias("view"), F.col(keys[0]).cast("long").alias("a"), b.cast("long").alias("b"), "matches", "points_per_match"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Twenty replicates per match and class around the model's probability.
_REP = """SELECT match_id AS row_id, class, r AS replicate, p + CAST((match_id * 7 + r * 31) % 101 - 50 AS DOUBLE) / 1000 AS p FROM
  (SELECT match_id, 'home_win' AS class, p_home AS p FROM @probs UNION ALL SELECT match_id, 'draw', p_draw FROM @probs UNION ALL SELECT match_id, 'away_win', p_away FROM @probs) AS c,
  (SELECT unnest(range(20)) AS r) AS g"""


def _replicates(t: Tables):
    rows = A.by_class(t.probs, ["match_id"]).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(19))))
    shift = ((F.col("match_id") * 7 + F.col("replicate") * 31) % 101 - 50) / F.lit(1000.0)
    return rows.select(F.col("match_id").alias("row_id"), "class", "replicate", (F.col("p") + shift).alias("p"))


_INT = f"SELECT row_id, class, avg(p) AS mean, stddev_pop(p) AS std, quantile_cont(p, 0.025) AS lower_95, quantile_cont(p, 0.975) AS upper_95 FROM ({_REP}) AS r GROUP BY ALL"


@query("A20_replicate_intervals", "row_id:i class:s mean:d8 std:d8 lower_95:d8 upper_95:d8", _INT)
def a20(t: Tables):
    return A.replicate_intervals(_replicates(t))


@query(
    "A19_stability_table",
    "row_id:i stability_score:d8 mean_probability_std:d8 max_probability_std:d8 confidence_label:s",
    f"""WITH i AS ({_INT}), s AS (SELECT row_id, avg(std) AS m, max(std) AS x FROM i GROUP BY row_id)
    SELECT row_id, greatest(0, least(1, 1 - m / 0.18)) AS stability_score, m AS mean_probability_std, x AS max_probability_std,
      CASE WHEN 1 - m / 0.18 >= 0.75 THEN 'High confidence' WHEN 1 - m / 0.18 >= 0.5 THEN 'Medium confidence' ELSE 'Low confidence' END AS confidence_label FROM s""",
)
def a19(t: Tables):
    return A.stability_table(A.replicate_intervals(_replicates(t)))


@query(
    "A21_hit_rate",
    "season:i round:i matches:i hit_rate:d8",
    f"""SELECT season, match_id % 38 + 1 AS round, count(*) AS matches, avg(CASE WHEN {PICK} = target THEN 1.0 ELSE 0 END) AS hit_rate FROM @probs GROUP BY ALL""",
)
def a21(t: Tables):
    from matchframe.sources.sinks import forecast_snapshot

    f = forecast_snapshot(t.probs.select("match_id", *X.P), F.lit("2001-09-01"), "v1")
    results = t.matches.select("match_id", "season", "result", (F.col("match_id") % 38 + 1).alias("round"))
    return A.hit_rate(f, results, ["match_id"], ["season", "round"])


# --- B ---------------------------------------------------------------------

_EDGE_SQL = f"""SELECT *, 1 / (p_home / (p_home + p_draw + p_away)) AS home_fair_odds, odds_h / (1 / (p_home / (p_home + p_draw + p_away))) - 1 AS home_edge,
  odds_d / (1 / (p_draw / (p_home + p_draw + p_away))) - 1 AS draw_edge, odds_a / (1 / (p_away / (p_home + p_draw + p_away))) - 1 AS away_edge, {PICK} AS model_pick, {MPICK} AS market_pick,
  greatest(p_home, p_draw, p_away) AS model_confidence FROM @pm"""
_BETS = f"""e AS ({_EDGE_SQL}), o AS (
  SELECT match_id, match_date, target, model_pick, market_pick, model_confidence, 0 AS k, 'home' AS bet_type, odds_h AS price, home_edge AS edge FROM e
  UNION ALL SELECT match_id, match_date, target, model_pick, market_pick, model_confidence, 1, 'draw', odds_d, draw_edge FROM e
  UNION ALL SELECT match_id, match_date, target, model_pick, market_pick, model_confidence, 2, 'away', odds_a, away_edge FROM e),
  b AS (SELECT *, CASE WHEN k = target THEN 1 ELSE 0 END AS won, CASE WHEN k = target THEN price - 1 ELSE -1 END AS profit FROM o),
  eb AS (SELECT * FROM b, (VALUES (0.0::DOUBLE), (0.03::DOUBLE), (0.05::DOUBLE), (0.08::DOUBLE), (0.10::DOUBLE)) AS g(threshold) WHERE edge > threshold)"""


@query("B1_edge_table", "match_id:i home_fair_odds:d8 home_edge:d8 draw_edge:d8 away_edge:d8 model_pick:i market_pick:i model_confidence:d8", _EDGE_SQL)
def b1(t: Tables):
    return B.edge_table(t.pm)


@query("B2_edge_bets", "match_id:i bet_type:s threshold:d2 edge:d8 profit:d4 won:i", f"WITH {_BETS} SELECT * FROM eb")
def b2(t: Tables):
    return B.edge_bets(B.edge_table(t.pm))


@query(
    "B3_pick_bets",
    "picker:s match_id:i bet_type:s profit:d4 edge:d8",
    f"WITH {_BETS} SELECT 'model' AS picker, * FROM b WHERE k = model_pick UNION ALL SELECT 'market', * FROM b WHERE k = market_pick",
)
def b3(t: Tables):
    e = B.edge_table(t.pm)
    a, b = (B.pick_bets(e, p).withColumn("picker", F.lit(p)) for p in ("model", "market"))
    return a.unionByName(b)


_CUM = """cu AS (SELECT *, sum(profit) OVER (PARTITION BY {k} ORDER BY match_date, match_id, bet_type ROWS UNBOUNDED PRECEDING) AS cum FROM {src}),
  pk AS (SELECT *, greatest(max(cum) OVER (PARTITION BY {k} ORDER BY match_date, match_id, bet_type ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM cu),
  md AS (SELECT {k}, max(dd) AS maximum_drawdown FROM pk GROUP BY {k})"""


@query("B4_max_drawdown", "threshold:d2 maximum_drawdown:d4", f"WITH {_BETS}, {_CUM.format(k='threshold', src='eb')} SELECT * FROM md")
def b4(t: Tables):
    return B.max_drawdown(B.edge_bets(B.edge_table(t.pm)), ["threshold"])


_SUM_COLS = "hit_rate:d8 profit:d4 stake:d2 roi:d8 yield:d8 maximum_drawdown:d4 average_edge:d8 average_odds:d8"


def _summary_sql(k: str, src: str) -> str:
    return f"""s AS (SELECT {k}, count(*) AS bets, avg(won) AS hit_rate, sum(profit) AS profit, count(*) AS stake, sum(profit) / count(*) AS roi, sum(profit) / count(*) AS yield,
      avg(edge) AS average_edge, avg(price) AS average_odds FROM {src} GROUP BY {k}), {_CUM.format(k=k, src=src)} SELECT * FROM s JOIN md USING ({k})"""


@query("B5_bet_summary_by_threshold", "threshold:d2 bets:i " + _SUM_COLS, f"WITH {_BETS}, {_summary_sql('threshold', 'eb')}")
def b5(t: Tables):
    return B.bet_summary(B.edge_bets(B.edge_table(t.pm)), ["threshold"])


@query("B5_bet_summary_by_type", "bet_type:s bets:i " + _SUM_COLS, f"WITH {_BETS}, x AS (SELECT * FROM eb WHERE threshold = 0.05), {_summary_sql('bet_type', 'x')}")
def b5_type(t: Tables):
    return B.bet_summary(B.edge_bets(B.edge_table(t.pm), [0.05]), ["bet_type"])


@query(
    "B5_bet_summary_by_confidence",
    "bucket:s bets:i " + _SUM_COLS,
    f"""WITH {_BETS}, x AS (SELECT *, CASE WHEN model_confidence >= 0.62 THEN 'high_confidence' WHEN model_confidence >= 0.48 THEN 'medium_confidence' ELSE 'low_confidence' END AS bucket
      FROM b WHERE k = model_pick), {_summary_sql('bucket', 'x')}""",
)
def b5_confidence(t: Tables):
    from matchframe.functions.clean import confidence_bucket

    bets = B.pick_bets(B.edge_table(t.pm)).withColumn("bucket", confidence_bucket(F.col("model_confidence")))
    return B.bet_summary(bets, ["bucket"])
