"""Registered scoring / routing / contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.operators import inseason as ins
from fieldcast.operators import scoring as M
from fieldcast.plans.q_inseason import SEASON, WEEK, _PIT_SQL, _UPCOMING_SQL, weekly_projection
from fieldcast.plans.q_preseason import CONTEXT_SQL, context_table
from fieldcast.plans.registry import register, sql_round

KEYS = ("player_id", "season")
REQ_KEY = ("player_id", "season", "week")


def _d(col, default):
    x = f"CAST({col} AS DOUBLE)"
    return f"coalesce(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, {float(default)})"


def _vec_sql(source: str) -> str:
    """M2 + M3 over a context-shaped relation, written from the contract."""
    feats = []
    for f in S.PRESEASON_FEATURE_ORDER:
        src = f"CAST({f} AS INTEGER)" if f in ("is_rookie", "qb_changed") else f
        feats.append(f"{_d(src, S.PRESEASON_DEFAULTS[f])} AS {f}")
    return f"""SELECT * REPLACE (w * draft_round + (1.0 - w) * 4.0 AS draft_round,
                           w * draft_pick + (1.0 - w) * 120.0 AS draft_pick)
FROM (SELECT *, CASE WHEN career_games IS NULL OR isnan(career_games) THEN 1.0
                     ELSE greatest(0.0, 1.0 - career_games / 32.0) END AS w
      FROM (SELECT player_id, season, depth_chart_rank AS raw_depth, prior_snap_share AS raw_snap,
                   draft_pick AS raw_pick, {', '.join(feats)} FROM {source}) v0) v1"""


_C = "least(greatest(prior_games / 8.0, 0.0), 1.0)"
PRE_HEURISTIC = (
    "greatest((CASE WHEN is_rookie > 0.5 THEN 13.0 * exp(-least(greatest(draft_pick, 1), 300) / 90.0)"
    f" ELSE (0.6 * prior_last4_points_per_game + 0.4 * prior_points_per_game) * {_C} + 6.0 * (1.0 - {_C}) END)"
    " * (1.0 + ((CASE WHEN depth_chart_rank <= 1 THEN 1.15 WHEN depth_chart_rank <= 2 THEN 1.0 ELSE 0.65 END)"
    " * (1.0 + 0.25 * (least(greatest(prior_snap_share, 0), 1) - 0.5))"
    " * (1.0 + 0.3 * least(greatest(prior_carry_share, 0), 1)) - 1.0)"
    f" * (CASE WHEN is_rookie > 0.5 THEN 1.0 ELSE 1.0 - {_C} END))"
    " * (CASE WHEN qb_changed > 0.5 THEN 0.93 ELSE 1.0 END), 0.0)")
PRE_CONFIDENCE = sql_round(
    "least(greatest(0.45 * least(prior_games / 12.0, 1.0)"
    " + 0.25 * ((CASE WHEN raw_depth IS NOT NULL THEN 0.5 ELSE 0.0 END)"
    " + (CASE WHEN raw_snap IS NOT NULL THEN 0.5 ELSE 0.0 END))"
    " + 0.3 * (1.0 - 5.0 / (5.0 + 8.0)), 0.05), CASE WHEN is_rookie > 0.5 THEN 0.55 ELSE 0.85 END)", 3)
IN_HEURISTIC = ("greatest((0.45 * fantasy_points_last_3 + 0.3 * fantasy_points_last_1 + 0.25 * season_avg_points)"
                " * (1.0 + (16.5 - opponent_rank) / 165.0), 0.0)")
IN_CONFIDENCE = sql_round(
    f"least(greatest(0.65 * (CASE WHEN abs({IN_HEURISTIC}) + 6.5 > 0 THEN 1.0 - 6.5 / (abs({IN_HEURISTIC}) + 6.5)"
    " ELSE 0.0 END) + 0.35 * least(games_played / 4.0, 1.0), 0.05), 0.95)", 3)
BASIS = """CASE WHEN is_rookie > 0.5 THEN
    CASE WHEN raw_pick IS NOT NULL AND raw_pick <> 0
         THEN printf('rookie - draft capital (pick %d) and projected role', raw_pick)
         ELSE 'rookie - projected role only, undrafted or draft position unknown' END
  WHEN prior_games >= 12 THEN printf('prior season (%d games) plus role', CAST(prior_games AS INTEGER))
  WHEN prior_games > 0 THEN printf('partial prior season (%d games), shrunk toward baseline', CAST(prior_games AS INTEGER))
  ELSE 'no prior production - role and experience only' END"""

CTX = f"ctx AS ({CONTEXT_SQL})"
VEC = f"vec AS ({_vec_sql('ctx')})"


def _vector(t):
    return M.preseason_vector(context_table(t))


def _requests(t):
    return t.player_stats.select("player_id", "season", "week", "opponent", "is_home")


@register("m1_validate_contract", sql=f"""
WITH {CTX}
SELECT player_id, season, list_filter([{', '.join(
    f"CASE WHEN {f} < {lo} OR {f} > {hi} THEN '{f}' END" for f, (lo, hi) in S.PRESEASON_RANGES.items())}],
    lambda x: x IS NOT NULL) AS violations,
  len(list_filter([{', '.join(
    f"CASE WHEN {f} < {lo} OR {f} > {hi} THEN '{f}' END" for f, (lo, hi) in S.PRESEASON_RANGES.items())}],
    lambda x: x IS NOT NULL)) = 0 AS valid
FROM (SELECT * REPLACE (CAST(is_rookie AS INTEGER) AS is_rookie, CAST(qb_changed AS INTEGER) AS qb_changed)
      FROM ctx) c""")
def q_validate(t):
    c = context_table(t).withColumns({"is_rookie": F.col("is_rookie").cast("int"),
                                      "qb_changed": F.col("qb_changed").cast("int")}) \
        .select(*KEYS, *S.PRESEASON_FEATURE_ORDER)
    return M.validate_contract(c, S.PRESEASON_FEATURE_ORDER, S.PRESEASON_RANGES, keys=KEYS) \
        .select(*KEYS, "violations", "valid")


@register("m2_preseason_defaults", doubles=S.PRESEASON_FEATURE_ORDER, sql=f"""
WITH {CTX}
SELECT player_id, season, {', '.join(
    _d(f"CAST({f} AS INTEGER)" if f in ('is_rookie', 'qb_changed') else f, S.PRESEASON_DEFAULTS[f]) + f' AS {f}'
    for f in S.PRESEASON_FEATURE_ORDER)} FROM ctx""")
def q_defaults(t):
    c = context_table(t).withColumns({"is_rookie": F.col("is_rookie").cast("int"),
                                      "qb_changed": F.col("qb_changed").cast("int")})
    return M.preseason_defaults(c, keep=KEYS)


@register("m3_draft_decay", doubles=("draft_round", "draft_pick", "career_games"), sql=f"""
WITH {CTX}, {VEC}
SELECT player_id, season, draft_round, draft_pick, career_games FROM vec""")
def q_decay(t):
    return _vector(t).select(*KEYS, "draft_round", "draft_pick", "career_games")


@register("m5_heuristic_preseason", doubles=("prediction",), sql=f"""
WITH {CTX}, {VEC}
SELECT player_id, season, {sql_round(sql_round(PRE_HEURISTIC, 3), 2)} AS prediction FROM vec""")
def q_pre_heuristic(t):
    return M.score_preseason(_vector(t)).select(*KEYS, "prediction")


@register("m6_confidence_in_season", doubles=("prediction", "confidence"), sql=f"""
WITH pit AS ({_PIT_SQL})
SELECT player_id, season, week, {sql_round(sql_round(IN_HEURISTIC, 3), 2)} AS prediction,
       {IN_CONFIDENCE} AS confidence FROM pit""")
def q_in_confidence(t):
    feats = ins.point_in_time_features(_requests(t), t.player_stats)
    return M.score_inseason(feats).select(*REQ_KEY, "prediction", "confidence")


@register("m7_confidence_preseason", doubles=("confidence",), sql=f"""
WITH {CTX}, {VEC}
SELECT player_id, season, {PRE_CONFIDENCE} AS confidence FROM vec""")
def q_pre_confidence(t):
    return M.score_preseason(_vector(t)).select(*KEYS, "confidence")


@register("m8_projection_basis", sql=f"""
WITH {CTX}, {VEC}
SELECT player_id, season, {BASIS} AS basis FROM vec""")
def q_basis(t):
    return _vector(t).select(*KEYS, M.projection_basis().alias("basis"))


_ASOF = """asof_ctx AS (
  SELECT r.player_id, r.season, r.week, max(c.season) AS ctx_season
  FROM req r JOIN ctx c ON c.player_id = r.player_id AND c.season <= r.season
  GROUP BY r.player_id, r.season, r.week)"""


@register("m10_asof_context", doubles=("ctx_prior_points_per_game",), sql=f"""
WITH req AS (SELECT player_id, season, week FROM player_stats), {CTX}, {_ASOF}
SELECT a.player_id, a.season, a.week, a.ctx_season, c.prior_games AS ctx_prior_games,
       c.prior_points_per_game AS ctx_prior_points_per_game, c.is_rookie AS ctx_is_rookie
FROM asof_ctx a JOIN ctx c ON c.player_id = a.player_id AND c.season = a.ctx_season""")
def q_asof(t):
    a = M.asof_context(_requests(t), context_table(t), REQ_KEY)
    return a.select(*REQ_KEY, "ctx_season", "ctx_prior_games", "ctx_prior_points_per_game", "ctx_is_rookie")


@register("m9_route_model", doubles=("prediction", "confidence"), sql=f"""
WITH req AS (SELECT player_id, season, week FROM player_stats), {CTX}, {_ASOF},
pit AS ({_PIT_SQL}),
routed AS (
  SELECT p.*, a.ctx_season,
    CASE WHEN p.games_played >= 1 THEN 'in_season' WHEN a.ctx_season IS NOT NULL THEN 'preseason'
         ELSE 'in_season' END AS mode
  FROM pit p LEFT JOIN asof_ctx a ON a.player_id = p.player_id AND a.season = p.season AND a.week = p.week),
pre_ctx AS (
  SELECT r.player_id, r.season AS req_season, r.week, c.* EXCLUDE (player_id, season), c.season AS ctx_season
  FROM routed r JOIN ctx c ON c.player_id = r.player_id AND c.season = r.ctx_season WHERE r.mode = 'preseason'),
pre_vec AS ({_vec_sql('ctx')}),
pre_keys AS (SELECT player_id, req_season, week, ctx_season FROM pre_ctx)
SELECT player_id, season, week, mode, {sql_round(sql_round(IN_HEURISTIC, 3), 2)} AS prediction,
       {IN_CONFIDENCE} AS confidence, '{M.FALLBACK_VERSION}' AS model_version,
       CAST(NULL AS INTEGER) AS context_season
FROM routed WHERE mode = 'in_season'
UNION ALL
SELECT k.player_id, k.req_season AS season, k.week, 'preseason' AS mode,
       {sql_round(sql_round(PRE_HEURISTIC, 3), 2)} AS prediction, {PRE_CONFIDENCE} AS confidence,
       '{M.PRESEASON_FALLBACK_VERSION}' AS model_version, k.ctx_season AS context_season
FROM pre_vec v JOIN pre_keys k ON k.player_id = v.player_id AND k.ctx_season = v.season""")
def q_route(t):
    return M.route_model(_requests(t), t.player_stats, context_table(t))


@register("m11_batch_score", doubles=("prediction", "confidence"), sql=f"""
SELECT player_id, {SEASON} AS season, {WEEK} AS week, coalesce(team, 'UNK') AS opponent,
       {sql_round(sql_round(IN_HEURISTIC, 3), 2)} AS prediction, CAST(NULL AS DOUBLE) AS confidence,
       '{M.FALLBACK_VERSION}' AS model_version
FROM ({_UPCOMING_SQL}) u""")
def q_batch_score(t):
    feats = ins.upcoming_features(t.players, t.player_stats, SEASON, WEEK)
    return M.batch_score_weekly(feats, SEASON, WEEK)


@register("m11_batch_score_fitted")
def q_batch_score_fitted(t):
    """The weekly batch scored by the stored in-season ridge."""
    from fieldcast.plans import q_training as Q
    feats = ins.upcoming_features(t.players, t.player_stats, SEASON, WEEK)
    return M.batch_score_weekly(feats, SEASON, WEEK, Q.model(t, Q.IN_RIDGE))


@register("m9_route_fitted")
def q_route_fitted(t):
    """Every game's request routed to stored models of either kind, with the spread that the registry has for each."""
    from fieldcast.operators import models as store
    from fieldcast.plans import q_training as Q
    inside, before = Q.model(t, Q.IN_RIDGE), Q.model(t, Q.PRE_MONOTONE)
    std = {r["version"]: r["residual_std"] for r in store.registry(t.spark, Q.model_root(t)).collect()}
    return M.route_model(_requests(t), t.player_stats, context_table(t), inseason_model=inside, preseason_model=before,
                         residual_std=std)


@register("m12_resolve_version", sql=f"""
SELECT model_version,
  CASE WHEN model_version = 'ridge_fs1' THEN model_version WHEN model_version = 'ridge_ps5' THEN NULL
       ELSE '{M.FALLBACK_VERSION}' END AS resolved_version,
  model_version = 'ridge_ps5' AS refused
FROM (SELECT DISTINCT model_version FROM predictions UNION VALUES ('ridge_fs1'), ('ridge_ps5')) d""")
def q_resolve(t):
    """Versions of the log, and two that the store has: the in-season one resolves, the other's feature order is refused."""
    from fieldcast.operators import models as store
    from fieldcast.plans import q_training as Q
    asked = [(Q.model(t, v).version,) for v in (Q.IN_RIDGE, Q.PRE_RIDGE)]
    versions = t.predictions.select("model_version").union(t.spark.createDataFrame(asked, "model_version string")).distinct()
    return M.resolve_version(versions, store.registry(t.spark, Q.model_root(t)).select("version", "feature_order"))


@register("m13_compare_players", doubles=("prediction",), sql=f"""
WITH u AS (SELECT *, {sql_round(IN_HEURISTIC, 2)} AS prediction FROM ({_UPCOMING_SQL}) x),
g AS (SELECT team, position, count(*) AS n FROM u GROUP BY team, position)
SELECT u.team || '/' || u.position AS comparison_id, u.player_id, u.prediction,
  CASE WHEN g.n < 2 THEN 'fewer than 2 players' WHEN g.n > 8 THEN 'more than 8 players' END AS refused,
  CASE WHEN g.n BETWEEN 2 AND 8 THEN
    CAST(row_number() OVER (PARTITION BY u.team, u.position ORDER BY u.prediction DESC, u.player_id) AS INTEGER) END
    AS position_in_comparison
FROM u JOIN g ON g.team = u.team AND g.position = u.position""")
def q_compare(t):
    scored = weekly_projection(t).withColumn("comparison_id", F.concat_ws("/", "team", "position"))
    return M.compare_players(scored.select("comparison_id", "player_id", "prediction"))
