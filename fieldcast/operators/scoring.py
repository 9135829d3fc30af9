"""Scoring, routing and contracts.

Models are applied as column expressions (heuristics, linear models) or as
MLlib transforms, so scoring is part of the same plan as feature building:
no batching, no per-row calls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.functions.columns import (
    decayed, draft_capital_weight, inseason_confidence, inseason_heuristic, preseason_confidence,
    preseason_heuristic, round_half_even,
)
from fieldcast.operators import inseason as ins

FALLBACK_VERSION = "heuristic_fallback_v0"
PRESEASON_FALLBACK_VERSION = "preseason_heuristic_v0"


class FeatureContractError(ValueError):
    pass


# ------------------------------------------------------------------ M1
def validate_contract(df: DataFrame, feature_order: Sequence[str], ranges: Mapping[str, tuple],
                      keys: Sequence[str] = ()) -> DataFrame:
    """M1: the set check is a plan-time error (missing or unexpected feature
    columns); range rules become a per-row `violations` array and a `valid`
    flag, so bad rows are quarantined by a filter instead of failing a batch.
    Nulls pass range rules (optional inputs)."""
    named = set(df.columns) - set(keys)
    absent, strange = sorted(set(feature_order) - named), sorted(named - set(feature_order))
    if absent or strange:
        raise FeatureContractError(f"not the contract's features: absent {absent}, not of the contract {strange}")
    checks = [F.when((F.col(f) < lo) | (F.col(f) > hi), F.lit(f))
              for f, (lo, hi) in ranges.items() if f in feature_order]
    bad = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
    return df.withColumn("violations", bad).withColumn("valid", F.size("violations") == 0)


# ------------------------------------------------------------------ M2 / M3
def preseason_defaults(df: DataFrame, feature_order=S.PRESEASON_FEATURE_ORDER,
                       defaults=S.PRESEASON_DEFAULTS, keep: Sequence[str] = ()) -> DataFrame:
    """M2: null / NaN -> documented default, every feature as double."""
    def one(f):
        v = F.col(f).cast("double")
        return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(float(defaults[f]))).alias(f)
    return df.select(*keep, *[one(f) for f in feature_order])


def draft_decay(df: DataFrame) -> DataFrame:
    """M3: draft round / pick blended toward neutral (4 / 120) as career
    games accumulate; gone after 32 games. Expects M2 output."""
    return df.withColumns({
        "draft_round": decayed("draft_round", S.NEUTRAL_DRAFT_ROUND, "career_games"),
        "draft_pick": decayed("draft_pick", S.NEUTRAL_DRAFT_PICK, "career_games"),
    })


def preseason_vector(context: DataFrame, keys: Sequence[str] = ("player_id", "season")) -> DataFrame:
    """M2 + M3 over context rows; raw depth / snap kept for M7."""
    ctx = context.withColumns({"is_rookie": F.col("is_rookie").cast("int"),
                               "qb_changed": F.col("qb_changed").cast("int"),
                               "_raw_depth": F.col("depth_chart_rank"),
                               "_raw_snap": F.col("prior_snap_share"),
                               "_raw_pick": F.col("draft_pick")})
    return draft_decay(preseason_defaults(ctx, keep=(*keys, "_raw_depth", "_raw_snap", "_raw_pick")))


# ------------------------------------------------------------------ M5-M8
def score_preseason(vec: DataFrame, residual_std: float = S.PRESEASON_FALLBACK_STD) -> DataFrame:
    """M5 + M7: heuristic projection (3 dp at the model boundary, 2 dp stored)
    and the evidence-driven confidence."""
    pred = round_half_even(round_half_even(preseason_heuristic(), 3), 2)
    conf = preseason_confidence("prior_games", "_raw_depth", "_raw_snap", "is_rookie", residual_std)
    return vec.withColumn("prediction", pred).withColumn("confidence", conf)


def score_inseason(feats: DataFrame, residual_std: float = S.INSEASON_FALLBACK_STD) -> DataFrame:
    """M4 + M6 over fs1 vectors."""
    raw = inseason_heuristic()
    return feats.withColumn("prediction", round_half_even(round_half_even(raw, 3), 2)) \
        .withColumn("confidence", inseason_confidence(raw, "games_played", residual_std))


def scored_as_stored(model, df: DataFrame) -> DataFrame:
    """``df`` with the model's prediction as it is stored (3 dp at the model boundary, then 2 dp) and its version."""
    raw = model.score(df, "prediction")
    return raw.withColumn("prediction", round_half_even(round_half_even("prediction", 3), 2)) \
        .withColumn("model_version", F.lit(model.version))


def projection_basis(prefix: str = "") -> Column:
    """M8: what a pre-season number rests on (raw, pre-default inputs)."""
    c = lambda n: F.col(prefix + n)
    games = F.coalesce(c("prior_games").cast("double"), F.lit(0.0))
    pick = c("_raw_pick")
    rookie = F.when(pick.isNotNull() & (pick != 0),
                    F.format_string("rookie - draft capital (pick %d) and projected role", pick.cast("int"))) \
        .otherwise(F.lit("rookie - projected role only, undrafted or draft position unknown"))
    return F.when(F.coalesce(c("is_rookie").cast("double"), F.lit(0.0)) > 0.5, rookie) \
        .when(games >= 12, F.format_string("prior season (%d games) plus role", games.cast("int"))) \
        .when(games > 0, F.format_string("partial prior season (%d games), shrunk toward baseline",
                                         games.cast("int"))) \
        .otherwise(F.lit("no prior production - role and experience only"))


# ------------------------------------------------------------------ M10
def asof_context(requests: DataFrame, context: DataFrame, key: Sequence[str]) -> DataFrame:
    """Backward as-of join - the context of the request's season, else the
    latest earlier one. Equi-join on player, `<=` as a post-filter (fan-out
    bounded by seasons per player), then max_by per request."""
    key = list(key)
    ctx_cols = [c for c in context.columns if c not in ("player_id",)]
    c = context.select(F.col("player_id").alias("_cpid"), F.struct(*ctx_cols).alias("_ctx"),
                       F.col("season").alias("_cs"))
    r = requests.select(*key, F.col("player_id").alias("_pid"), F.col("season").alias("_rs"))
    j = r.join(c, (F.col("_pid") == F.col("_cpid")) & (F.col("_cs") <= F.col("_rs")))
    best = j.groupBy(*key).agg(F.max_by("_ctx", "_cs").alias("_ctx"))
    return best.select(*key, *[F.col(f"_ctx.{x}").alias(f"ctx_{x}") for x in ctx_cols])


# ------------------------------------------------------------------ M9 / M13
def route_model(requests: DataFrame, stats: DataFrame, context: DataFrame,
                key: Sequence[str] = ("player_id", "season", "week"), inseason_model=None, preseason_model=None,
                residual_std: Mapping[str, float] | None = None) -> DataFrame:
    """M9: >= 1 game before the week -> in-season; else pre-season when a
    context row exists (as-of); else in-season on a cold-start vector.

    Both branches are computed for the routed rows only and unioned. Each is
    scored by the heuristic or by the stored model that was asked for, whose
    residual spread (``residual_std`` by version) goes into the confidence.
    """
    key = list(key)
    spread = residual_std or {}
    feats = ins.point_in_time_features(requests, stats, key)
    ctx = asof_context(requests, context, key)
    routed = feats.join(ctx.select(*key, "ctx_season"), key, "left").withColumn(
        "mode", F.when(F.col("games_played") >= 1, F.lit("in_season"))
        .when(F.col("ctx_season").isNotNull(), F.lit("preseason")).otherwise(F.lit("in_season")))
    in_rows = routed.where(F.col("mode") == "in_season")
    if inseason_model is None:
        inseason = score_inseason(in_rows).withColumn("model_version", F.lit(FALLBACK_VERSION))
    else:
        std = spread.get(inseason_model.version, S.INSEASON_MISSING_STD)
        inseason = scored_as_stored(inseason_model, in_rows) \
            .withColumn("confidence", inseason_confidence("prediction", "games_played", std))
    inseason = inseason.select(*key, "mode", "prediction", "confidence", "model_version",
                               F.lit(None).cast("int").alias("context_season"))
    pre_rows = routed.where(F.col("mode") == "preseason").select(*key, "mode").join(ctx, key)
    renamed = pre_rows.select(*key, "mode", *[F.col(f"ctx_{c}").alias(c) for c in context.columns
                                              if c not in ("player_id", "season")],
                              F.col("ctx_season").alias("context_season"))
    vec = preseason_vector(renamed, keys=(*key, "mode", "context_season"))
    if preseason_model is None:
        pre = score_preseason(vec).withColumn("model_version", F.lit(PRESEASON_FALLBACK_VERSION))
    else:
        std = spread.get(preseason_model.version, S.PRESEASON_MISSING_STD)
        pre = scored_as_stored(preseason_model, vec).withColumn("confidence", preseason_confidence(
            "prior_games", "_raw_depth", "_raw_snap", "is_rookie", std))
    pre = pre.select(*key, "mode", "prediction", "confidence", "model_version", "context_season")
    return inseason.unionByName(pre)


def compare_players(scored: DataFrame, group: str = "comparison_id", lo: int = 2, hi: int = 8) -> DataFrame:
    """Rank each comparison (2-8 players) by prediction; groups of any
    other size are refused: their rows have no position, and the reason in `refused`."""
    sizes = scored.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    reason = F.when(F.col("_n") < lo, f"fewer than {lo} players").when(F.col("_n") > hi, f"more than {hi} players")
    sized = scored.join(sizes, group).withColumn("refused", reason).drop("_n")
    w = Window.partitionBy(group).orderBy(F.col("prediction").desc(), "player_id")
    # Only accepted groups, of <= `hi` rows, reach the window.
    ok = sized.where("refused is null").withColumn("position_in_comparison", F.row_number().over(w))
    no = sized.where("refused is not null").withColumn("position_in_comparison", F.lit(None).cast("int"))
    return ok.unionByName(no)


# ------------------------------------------------------------------ M11 / M12
def batch_score_weekly(features: DataFrame, season: int, week: int, model=None) -> DataFrame:
    """The weekly prediction rows as stored - 3 dp at the model boundary
    then 2 dp, opponent = own team or 'UNK' (D4), or that of the schedule where
    the features have one. Scored by the heuristic, or by
    a stored `model` (`models.load_model`)."""
    if model is None:
        told = features.withColumn("prediction", round_half_even(round_half_even(inseason_heuristic(), 3), 2)) \
            .withColumn("model_version", F.lit(FALLBACK_VERSION))
    else:
        told = scored_as_stored(model, features)
    return told.select(
        "player_id", F.lit(season).alias("season"), F.lit(week).alias("week"),
        F.coalesce(F.col("opponent" if "opponent" in features.columns else "team"), F.lit("UNK")).alias("opponent"),
        "prediction", F.lit(None).cast("double").alias("confidence"), "model_version")


def resolve_version(requests: DataFrame, registry: DataFrame, fallback: str = FALLBACK_VERSION,
                    col: str = "model_version", expected_order: Sequence[str] = S.FEATURE_ORDER) -> DataFrame:
    """Requested version -> itself when registered with a compatible
    feature order, the fallback when unknown; a registered version trained on
    another feature order is refused (resolved null, `refused` true)."""
    reg = registry.select(F.col("version").alias("_v"), F.col("feature_order").alias("_order"))
    order = ",".join(expected_order)
    j = requests.join(F.broadcast(reg), requests[col] == reg["_v"], "left")
    compatible = F.col("_order").isNull() | (F.col("_order") == order)
    resolved = F.when(F.col("_v").isNull(), F.lit(fallback)) \
        .when(compatible, F.col(col)).otherwise(F.lit(None).cast("string"))
    return j.withColumn("resolved_version", resolved) \
        .withColumn("refused", F.col("_v").isNotNull() & ~compatible).drop("_v", "_order")


__all__ = ["draft_capital_weight"]
