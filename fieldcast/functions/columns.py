"""Reusable JVM-side column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import schemas as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


NOISE_DIGITS = 9


def round_half_even(c: str | Column, digits: int) -> Column:
    """pandas-style rounding, rint(x * 10^d) / 10^d, applied after snapping x
    to 9 dp so float accumulation noise (sums of tenths in a different order)
    cannot flip an exact decimal tie. Bit-identical to `sql_round` in DuckDB."""
    x = col(c)
    if digits < NOISE_DIGITS:
        x = F.rint(x * 1e9) / 1e9
    scale = float(10 ** digits)
    return F.rint(x * scale) / scale + 0.0      # + 0.0 folds -0.0 into 0.0


def clip(c: str | Column, low=None, high=None) -> Column:
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return out


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den with a zero or null denominator giving null (ANSI-safe)."""
    return col(num) / F.nullif(col(den), F.lit(0))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column half-even; used to make outputs comparable."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(round_half_even(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --------------------------------------------------------------- career terms
def age_multiplier(age: str | Column) -> Column:
    """max(0.55, 1 - 0.010*(age-26.5)^2); unknown (null/NaN) age -> 1."""
    a = col(age).cast("double")
    m = F.greatest(F.lit(S.AGE_FLOOR), 1.0 - S.AGE_DECAY * F.pow(a - S.PEAK_AGE, 2))
    return F.when(a.isNull() | F.isnan(a), F.lit(1.0)).otherwise(m)


def age_factor(age_now: str | Column, seasons_ago: str | Column) -> Column:
    """clip(mult(age_now) / mult(age_now - seasons_ago), 0.6, 1.4), null -> 1."""
    now = age_multiplier(age_now)
    then = age_multiplier(col(age_now) - col(seasons_ago))
    lo, hi = S.AGE_FACTOR_CLIP
    return F.coalesce(clip(now / then, lo, hi), F.lit(1.0))


def recency_weight(seasons_ago: str | Column) -> Column:
    out = F.lit(S.TAIL_WEIGHT)
    for ago in sorted(S.RECENCY_WEIGHTS, reverse=True):
        out = F.when(col(seasons_ago) == ago, F.lit(S.RECENCY_WEIGHTS[ago])).otherwise(out)
    return out


def season_weight(seasons_ago: str | Column, games: str | Column,
                  recency_base: int = 0) -> Column:
    """recency weight x min(games/17, 1). recency_base=1 re-keys 'last season' to 0."""
    ago = col(seasons_ago) - F.lit(recency_base)
    return recency_weight(ago) * F.least(col(games) / float(S.FULL_SEASON_GAMES), F.lit(1.0))


# ------------------------------------------------------------- draft capital
def draft_capital_weight(career_games: str | Column) -> Column:
    g = col(career_games).cast("double")
    w = F.greatest(F.lit(0.0), 1.0 - g / S.DRAFT_EVIDENCE_GAMES)
    return F.when(g.isNull() | F.isnan(g), F.lit(1.0)).otherwise(w)


def decayed(value: str | Column, neutral: float, career_games: str | Column) -> Column:
    w = draft_capital_weight(career_games)
    return w * col(value) + (1.0 - w) * F.lit(neutral)


# ---------------------------------------------------------------- heuristics
def inseason_heuristic(last3="fantasy_points_last_3", last1="fantasy_points_last_1",
                       season="season_avg_points", opp_rank="opponent_rank") -> Column:
    base = 0.45 * col(last3) + 0.3 * col(last1) + 0.25 * col(season)
    matchup = 1.0 + (16.5 - col(opp_rank)) / 165.0
    return F.greatest(base * matchup, F.lit(0.0))


def preseason_heuristic(prefix: str = "") -> Column:
    """Carry-forward for veterans, draft-slot curve for rookies, role and QB factors.

    Expects defaulted and draft-decayed feature columns (M2 + M3 applied).
    """
    c = lambda n: F.col(prefix + n)
    confidence = clip(c("prior_games") / 8.0, 0.0, 1.0)
    carry = 0.6 * c("prior_last4_points_per_game") + 0.4 * c("prior_points_per_game")
    veteran = carry * confidence + S.PRESEASON_PRIOR_MEAN * (1.0 - confidence)
    rookie = 13.0 * F.exp(-clip(c("draft_pick"), 1, 300) / 90.0)
    is_rookie = c("is_rookie") > 0.5
    base = F.when(is_rookie, rookie).otherwise(veteran)
    depth = c("depth_chart_rank")
    depth_f = F.when(depth <= 1, 1.15).when(depth <= 2, 1.0).otherwise(0.65)
    snap_f = 1.0 + 0.25 * (clip(c("prior_snap_share"), 0, 1) - 0.5)
    carry_f = 1.0 + 0.30 * clip(c("prior_carry_share"), 0, 1)
    role = depth_f * snap_f * carry_f
    effective = 1.0 + (role - 1.0) * F.when(is_rookie, F.lit(1.0)).otherwise(1.0 - confidence)
    qb = F.when(c("qb_changed") > 0.5, F.lit(0.93)).otherwise(F.lit(1.0))
    return F.greatest(base * effective * qb, F.lit(0.0))


def inseason_confidence(prediction: str | Column, games: str | Column,
                        residual_std: float | Column = S.INSEASON_MISSING_STD) -> Column:
    std = residual_std if isinstance(residual_std, Column) else F.lit(float(residual_std))
    signal = F.abs(col(prediction)) + std
    spread = F.when(signal > 0, 1.0 - std / signal).otherwise(F.lit(0.0))
    history = F.least(col(games).cast("double") / 4.0, F.lit(1.0))
    return round_half_even(clip(0.65 * spread + 0.35 * history, 0.05, 0.95), 3)


def preseason_confidence(prior_games: str | Column, depth_raw: str | Column,
                         snap_raw: str | Column, is_rookie: str | Column,
                         residual_std: float | Column = S.PRESEASON_MISSING_STD) -> Column:
    """Evidence-driven score; depth/snap presence is tested on raw (pre-default) values."""
    std = residual_std if isinstance(residual_std, Column) else F.lit(float(residual_std))
    history = F.least(F.coalesce(col(prior_games).cast("double"), F.lit(0.0)) / 12.0, F.lit(1.0))
    role = F.when(col(depth_raw).isNotNull(), 0.5).otherwise(0.0) \
        + F.when(col(snap_raw).isNotNull(), 0.5).otherwise(0.0)
    ceiling = F.when(F.coalesce(col(is_rookie).cast("double"), F.lit(0.0)) > 0.5, 0.55) \
        .otherwise(0.85)
    spread = 1.0 - std / (std + 8.0)
    score = 0.45 * history + 0.25 * role + 0.30 * spread
    return round_half_even(F.least(F.greatest(score, F.lit(0.05)), ceiling), 3)


# --------------------------------------------------------------- text values
def fmt0(c: str | Column) -> Column:
    """'%.0f' with half-even rounding, as Python string formatting does."""
    return F.format_string("%.0f", F.rint(col(c)))


def fmt1(c: str | Column) -> Column:
    return F.format_string("%.1f", round_half_even(col(c), 1))
