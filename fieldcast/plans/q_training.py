"""Registered training, evaluation and attribution queries.

Relational steps (dataset, preparation, splits, metrics of fixed scorers,
gates) have DuckDB oracles. Fitted models are stored once and read back by
version; SQL cannot express their coefficients, so those queries are rows-only,
and check queries beside them have oracles: a fit is optimal on the rows it was
trained on, no sweep reverses, baseline plus contributions give the projection.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.operators import explain as E
from fieldcast.operators import inseason as ins
from fieldcast.operators import models as store
from fieldcast.operators import scoring as M
from fieldcast.operators import training as T
from fieldcast.plans.q_inseason import _WINDOWS_SQL
from fieldcast.plans.q_preseason import CONTEXT_DOUBLES, CONTEXT_SQL, context_table
from fieldcast.plans.q_scoring import PRE_HEURISTIC, _vec_sql
from fieldcast.plans.registry import register, sql_round
from fieldcast.session import cut_lineage, staging_path
from fieldcast.sources.fixtures import _fingerprint

FEATURES = list(S.PRESEASON_FEATURE_ORDER)
IN_FEATURES = list(S.FEATURE_ORDER)
PRE_RIDGE, PRE_MONOTONE, PRE_TREES, IN_RIDGE, IN_TREES = "ridge_ps5", "monotone_ps5", "gbt_ps5", "ridge_fs1", "gbt_fs1"
ALPHA = 1.0
BOARD_SEASON = 2002
TOP = 6

_DS = f"""ds AS (
  SELECT c.player_id, c.season, p.position, {', '.join('c.' + f for f in FEATURES)}, e.actual_ppg, e.games_played
  FROM ({CONTEXT_SQL}) c JOIN players p ON p.player_id = c.player_id
  JOIN (SELECT player_id, season, avg(fantasy_points) AS actual_ppg, count(*) AS games_played
        FROM player_stats WHERE week <= {S.TARGET_WEEKS} GROUP BY player_id, season
        HAVING count(*) >= {S.MIN_TARGET_GAMES}) e ON e.player_id = c.player_id AND e.season = c.season)"""
_PREP = f"""vec AS ({_vec_sql('ds')}),
prep AS (SELECT v.player_id, v.season, d.actual_ppg, {', '.join('v.' + f for f in FEATURES)}, v.prediction,
                v.season = (SELECT max(season) FROM ds) AS is_valid
         FROM (SELECT *, {sql_round(sql_round(PRE_HEURISTIC, 3), 2)} AS prediction FROM vec) v
         JOIN (SELECT player_id, season, actual_ppg FROM ds) d ON d.player_id = v.player_id AND d.season = v.season)"""


def _metrics_sql(rel: str, label: str, pred: str, by: str = "") -> str:
    e = f"({pred} - {label})"
    grp = f"{by}, " if by else ""
    return f"""SELECT {grp}{sql_round(f'sqrt(avg({e} * {e}))', 4)} AS rmse, {sql_round(f'avg(abs({e}))', 4)} AS mae,
  {sql_round(f'CASE WHEN sum(({label} - m_y) * ({label} - m_y)) > 0 THEN 1 - sum({e} * {e}) / sum(({label} - m_y) * ({label} - m_y)) ELSE 0.0 END', 4)} AS r2,
  {sql_round(f'stddev_pop({e})', 4)} AS residual_std, count(*) AS n_valid
FROM (SELECT *, avg({label}) OVER ({'PARTITION BY ' + by if by else ''}) AS m_y FROM {rel}) q
{'GROUP BY ' + by if by else ''}"""


# ------------------------------------------------------------------ builders
def dataset(t):
    return T.preseason_dataset(context_table(t), t.players, t.player_stats)


def prepared(t):
    """T2 output with the heuristic projection and the season split."""
    vec = M.preseason_vector(dataset(t), keys=("player_id", "season", "actual_ppg"))
    scored = M.score_preseason(vec).select("player_id", "season", "actual_ppg", *FEATURES, "prediction")
    return T.season_split(scored)


def in_season_frame(t):
    """The rolling windows of the positions that are projected (as F7), split by week."""
    windows = ins.training_windows(t.player_stats, t.players)
    return T.time_split(windows.where(F.upper("position").isin(*S.FLEX_POSITIONS)))


_IN_SEASON_SQL = f"SELECT * FROM ({_WINDOWS_SQL}) f WHERE upper(position) IN ('WR', 'RB', 'TE')"


def in_season_training(t):
    """F7's frame, all ten features, split by week."""
    return T.time_split(ins.finalise_training(ins.training_windows(t.player_stats, t.players)))


_ROOTS: dict[tuple, str] = {}
_FRAMES: dict[tuple, object] = {}


def model_root(t) -> str:
    """The model store of these tables, one a session."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, _fingerprint(t.sf_dir, ("lineitem", "supplier", "events")))
    if key not in _ROOTS:
        _ROOTS[key] = staging_path(t.spark, "models")
    return _ROOTS[key]


def _training_rows(t, kind: str):
    """The prepared rows of a kind, stored once: several models are fitted on them."""
    key = (model_root(t), kind)
    if key not in _FRAMES:
        _FRAMES[key] = cut_lineage(prepared(t) if kind == "preseason" else in_season_training(t))
    return _FRAMES[key]


def model(t, version: str):
    """A stored model, fitted and saved with its holdout metrics the first time that it is asked for."""
    root = model_root(t)
    if store.registry(t.spark, root).where(F.col("version") == version).isEmpty():
        kind = "preseason" if version in (PRE_RIDGE, PRE_MONOTONE, PRE_TREES) else "in_season"
        features, label = (FEATURES, "actual_ppg") if kind == "preseason" else (IN_FEATURES, "fantasy_points")
        rows = _training_rows(t, kind).drop("prediction")
        if version in (PRE_TREES, IN_TREES):
            fitted = store.TreeModel(features, T.train_gbt(rows, features, label), version)
        else:
            fitted = T.fit_linear(rows.where(~F.col("is_valid")), features, label, ALPHA,
                                  directions=S.MONOTONE if version == PRE_MONOTONE else None, version=version)
        scored = fitted.score(rows.where("is_valid"), "prediction")
        store.save_model(t.spark, root, fitted, kind, T.regression_metrics(scored, label, "prediction").first().asDict())
    return store.load_model(t.spark, root, version)


# ------------------------------------------------------------------ T1-T4
@register("t1_preseason_dataset", doubles=tuple(c for c in CONTEXT_DOUBLES if c in FEATURES) + ("actual_ppg",),
          sql=f"WITH {_DS} SELECT * FROM ds")
def q_dataset(t):
    return dataset(t)


@register("t2_preseason_prepare", doubles=("actual_ppg", *FEATURES), sql=f"""
WITH {_DS}, {_PREP}
SELECT player_id, season, actual_ppg, {', '.join(FEATURES)} FROM prep""")
def q_prepare(t):
    return T.preseason_prepare(dataset(t)).select("player_id", "season", "actual_ppg", *FEATURES)


@register("t3_time_split", sql=f"""
SELECT player_id, season, week, week > (SELECT max(week) FROM ({_IN_SEASON_SQL}) m) - 4 AS is_valid
FROM ({_IN_SEASON_SQL}) w""")
def q_time_split(t):
    return in_season_frame(t).select("player_id", "season", "week", "is_valid")


@register("t4_season_split", sql=f"""
WITH {_DS} SELECT player_id, season, season = (SELECT max(season) FROM ds) AS is_valid FROM ds""")
def q_season_split(t):
    return T.season_split(dataset(t)).select("player_id", "season", "is_valid")


# ------------------------------------------------------------------ T8 / T9 / T12 / T13
@register("t8_regression_metrics", doubles=("rmse", "mae", "r2", "residual_std"), sql=f"""
WITH {_DS}, {_PREP}
{_metrics_sql('(SELECT * FROM prep WHERE is_valid)', 'actual_ppg', 'prediction')}""")
def q_metrics(t):
    """Holdout-season metrics of the pre-season heuristic."""
    return T.regression_metrics(prepared(t).where("is_valid"), "actual_ppg", "prediction")


@register("t9_naive_baselines", doubles=("rmse", "mae", "r2", "residual_std"), sql=f"""
WITH {_DS}, {_PREP}
SELECT 'naive_carry_forward' AS model, * FROM (
  {_metrics_sql('(SELECT * FROM prep WHERE is_valid)', 'actual_ppg', 'prior_points_per_game')}) a
UNION ALL
SELECT 'naive_last3_avg' AS model, * FROM (
  {_metrics_sql(f"(SELECT * FROM ({_IN_SEASON_SQL}) w WHERE week > (SELECT max(week) FROM ({_IN_SEASON_SQL}) m) - 4)",
                'target', 'fantasy_points_last_3')}) b""")
def q_naive(t):
    pre = T.naive_metrics(prepared(t).where("is_valid"), "actual_ppg", "prior_points_per_game",
                          "naive_carry_forward")
    ins_ = T.naive_metrics(in_season_frame(t).where("is_valid"), "target", "fantasy_points_last_3",
                           "naive_last3_avg")
    return pre.unionByName(ins_)


@register("t12_slice_metrics", doubles=("rmse", "mae", "r2", "residual_std"), sql=f"""
WITH {_DS}, {_PREP}, m AS ({_metrics_sql('(SELECT * FROM prep WHERE is_valid)', 'actual_ppg', 'prediction',
                                         'is_rookie')})
SELECT is_rookie, rmse, mae, r2, residual_std, n_valid, n_valid < 1 AS refused FROM m""")
def q_slices(t):
    return T.slice_metrics(prepared(t).where("is_valid"), "actual_ppg", "prediction", "is_rookie")


@register("t13_training_source_gate", sql=f"""
WITH {_DS} SELECT least(count(*), {S.MIN_TRAINING_ROWS}) AS rows_checked,
  count(*) >= {S.MIN_TRAINING_ROWS} AS passes FROM ds""")
def q_gate(t):
    rows = dataset(t)
    n = rows.limit(S.MIN_TRAINING_ROWS).agg(F.count(F.lit(1)).alias("rows_checked"))
    return n.withColumn("passes", F.lit(T.training_source_gate(rows)))


# ------------------------------------------------------------------ T5-T7, T10, T11, T14
def _coefficients(t, version):
    m = model(t, version)
    d = F.create_map(*[x for k, v in S.MONOTONE.items() for x in (F.lit(k), F.lit(v))])
    return m.coefficients(t.spark).withColumn("direction", F.coalesce(d[F.col("feature")], F.lit(0)))


@register("t5_train_ridge")
def q_ridge(t):
    """The pre-season ridge, and the in-season one on its ten features."""
    one, two = (model(t, v).coefficients(t.spark).withColumn("model_version", F.lit(v)) for v in (PRE_RIDGE, IN_RIDGE))
    return one.unionByName(two)


@register("t6_train_gbt")
def q_gbt(t):
    valid = _training_rows(t, "preseason").where("is_valid").drop("prediction")
    return model(t, PRE_TREES).score(valid).select("player_id", "season", "actual_ppg", "prediction")


@register("t7_train_monotone")
def q_monotone(t):
    return _coefficients(t, PRE_MONOTONE).withColumn("respects", F.col("coef") * F.col("direction") >= 0)


def _optimal(t, kind: str, version: str, label: str):
    """Of each feature of a linear fit: whether its penalised gradient over the training rows vanishes, or, where a
    sign binds, points out of what is allowed. Taken from residuals, not from the sums that the fit used."""
    m = model(t, version)
    rows = _training_rows(t, kind).where(~F.col("is_valid")).drop("prediction")
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in m.features}
    resid = rows.withColumn("_e", F.col(label) - m.predict()).withColumns({f: v for f, v in x.items()})
    sums = resid.agg(*[F.struct(F.covar_pop(f, "_e").alias("g"), F.var_pop(f).alias("v"), F.count(F.lit(1)).alias("n")).alias(f)
                       for f in m.features])
    table = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(c)).alias("coef"), F.col(f).alias("s"),
                               F.lit(S.MONOTONE.get(f, 0) if version == PRE_MONOTONE else 0).alias("direction"))
                      for f, c in zip(m.features, m.coef)])
    r = F.explode(table).alias("r")
    sd = F.when(F.col("r.s.v") > 0, F.sqrt("r.s.v")).otherwise(F.lit(1.0))
    # the derivative of the objective by the standardised coefficient, for each row
    slope = (F.col("r.s.n") * F.col("r.s.g") / sd - F.lit(ALPHA) * F.col("r.coef") * sd) / F.col("r.s.n")
    bound = (F.col("r.direction") != 0) & (F.abs(F.col("r.coef") * sd) < 1e-9)
    ok = F.when(bound, slope * F.col("r.direction") <= 1e-6).otherwise(F.abs(slope) <= 1e-6)
    return sums.select(r).select(F.col("r.feature").alias("feature"), F.col("r.s.n").alias("training_rows"), ok.alias("optimal"))


def _optimal_sql(features, rows: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, ({rows}) AS training_rows, true AS optimal" for f in features)


_N_TRAIN = f"WITH {_DS} SELECT count(*) FROM ds WHERE season < (SELECT max(season) FROM ds)"
_N_VALID = f"WITH {_DS} SELECT count(*) FROM ds WHERE season = (SELECT max(season) FROM ds)"


@register("t5_ridge_is_optimal", sql=f"WITH n AS ({_N_TRAIN} ) {_optimal_sql(FEATURES, 'SELECT * FROM n')}")
def q_ridge_optimal(t):
    return _optimal(t, "preseason", PRE_RIDGE, "actual_ppg")


@register("t5_in_season_ridge_is_optimal", sql=f"""
WITH n AS (SELECT count(*) FROM ({_IN_SEASON_SQL}) f WHERE week <= (SELECT max(week) FROM ({_IN_SEASON_SQL}) g) - 4)
{_optimal_sql(IN_FEATURES, 'SELECT * FROM n')}""")
def q_in_season_ridge_optimal(t):
    return _optimal(t, "in_season", IN_RIDGE, "fantasy_points")


@register("t7_monotone_is_optimal", sql=f"WITH n AS ({_N_TRAIN} ) {_optimal_sql(FEATURES, 'SELECT * FROM n')}")
def q_monotone_optimal(t):
    return _optimal(t, "preseason", PRE_MONOTONE, "actual_ppg")


def _entrants(t, kind: str, label: str, entrants):
    """Holdout metrics of (model, framework, column or version, is_baseline) over one scored frame."""
    valid = _training_rows(t, kind).where("is_valid")
    columns = []
    for name, _, source, _ in entrants:
        if source in valid.columns:
            valid = valid.withColumn(f"_p_{name}", F.col(source).cast("double"))
        else:
            valid = model(t, source).score(valid.withColumnRenamed("prediction", "_kept"), f"_p_{name}") \
                .withColumnRenamed("_kept", "prediction")
        columns.append(f"_p_{name}")
    valid = cut_lineage(valid.select(label, *columns))
    parts = [T.regression_metrics(valid, label, c).select(
        F.lit(kind).alias("kind"), F.lit(name).alias("model"), F.lit(fw).alias("framework"), "rmse", "mae",
        F.lit(base).alias("is_baseline")) for c, (name, fw, _, base) in zip(columns, entrants)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@register("t10_bake_off")
def q_bake_off(t):
    pre = _entrants(t, "preseason", "actual_ppg", [
        ("naive_carry_forward", "none", "prior_points_per_game", True),
        (M.PRESEASON_FALLBACK_VERSION, "heuristic", "prediction", False),
        (PRE_RIDGE, "linear", PRE_RIDGE, False), (PRE_MONOTONE, "monotone_linear", PRE_MONOTONE, False),
        (PRE_TREES, "gbt", PRE_TREES, False)])
    now = _entrants(t, "in_season", "fantasy_points", [
        ("naive_last3_avg", "none", "fantasy_points_last_3", True),
        (IN_RIDGE, "linear", IN_RIDGE, False), (IN_TREES, "gbt", IN_TREES, False)])
    return T.bake_off(pre.unionByName(now))


@register("t11_feature_importance")
def q_importance(t):
    return T.feature_importance(model(t, PRE_TREES).pipeline, FEATURES, t.spark)


@register("t14_monotone_audit", sql=f"WITH n AS ({_N_VALID} ) " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {d} AS direction, (SELECT * FROM n) AS rows, 0 AS violations" for f, d in S.MONOTONE.items()))
def q_audit(t):
    """Every feature with a direction is swept over its range for every holdout row."""
    rows = _training_rows(t, "preseason").where("is_valid").select("player_id", "season", *FEATURES)
    return T.monotone_audits(rows, ["player_id", "season"], S.MONOTONE, 16, model(t, PRE_MONOTONE).score).drop("largest")


# ------------------------------------------------------------------ E1-E4, Q17
def _attr(t):
    rows = _training_rows(t, "preseason").where("is_valid").select("player_id", "season", *FEATURES)
    return E.attribution(rows, model(t, PRE_RIDGE), ["player_id", "season"])


@register("e1_attribution")
def q_attribution(t):
    return _attr(t)


@register("e1_adds_up", sql=f"""
WITH {_DS} SELECT player_id, season, {len(FEATURES)} AS features, true AS adds_up FROM ds WHERE season = (SELECT max(season) FROM ds)""")
def q_adds_up(t):
    """Baseline plus contributions give the projection, which is the stored model's score of the row."""
    told = _attr(t).groupBy("player_id", "season").agg(
        F.count(F.lit(1)).cast("int").alias("features"), (F.max("baseline") + F.sum("contribution")).alias("whole"))
    rows = model(t, PRE_RIDGE).score(_training_rows(t, "preseason").where("is_valid").drop("prediction"))
    return told.join(rows.select("player_id", "season", "prediction"), ["player_id", "season"]).select(
        "player_id", "season", "features", (F.abs(F.col("whole") - F.col("prediction")) < 1e-6).alias("adds_up"))


@register("e2_top_drivers")
def q_top(t):
    return E.top_drivers(_attr(t), ["player_id", "season"], TOP)


@register("e3_driver_text")
def q_text(t):
    return E.driver_text(E.top_drivers(_attr(t), ["player_id", "season"], TOP)) \
        .select("player_id", "season", "rank", "feature", "text")


@register("e4_headline")
def q_headline(t):
    return E.headline(E.top_drivers(_attr(t), ["player_id", "season"], TOP), ["player_id", "season"])


@register("q17_projection_why")
def q_why(t):
    """Draft-board 'why': each board-season player's context (as of the
    season, M10), scored by the ridge model, with top drivers and headline."""
    keys = ["player_id", "season"]
    req = context_table(t).where(F.col("season") == BOARD_SEASON).select("player_id", "season")
    ctx = M.asof_context(req.withColumn("week", F.lit(0)), context_table(t), ("player_id", "season", "week"))
    vec = M.preseason_vector(context_table(t).join(ctx.select("player_id", F.col("ctx_season").alias("season")),
                                                   keys, "left_semi"))
    top = E.top_drivers(E.attribution(vec, model(t, PRE_RIDGE), keys), keys, TOP)
    text = E.driver_text(top).groupBy(*keys).agg(
        F.first("baseline").alias("baseline"), F.first("projection").alias("projection"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("drivers"))
    return text.join(E.headline(top, keys), keys)
