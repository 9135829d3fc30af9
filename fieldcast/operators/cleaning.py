"""Cleaning operators (C1-C10) for the raw weekly feed and rosters."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.functions.columns import clip, round_half_even


def drop_unjoinable(df: DataFrame, keys=("player_id", "season", "week"),
                    also=("position", "recent_team")) -> DataFrame:
    """Rows without identity, position or team cannot be joined anywhere."""
    return df.dropna(subset=[*keys, *[c for c in also if c in df.columns]])


def _number(c: str):
    """The column as double; null, NaN and what is no number are 0."""
    return F.nanvl(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def clean_counts(df: DataFrame, cols=S.COUNT_COLS) -> DataFrame:
    """Absent -> 0, null and NaN -> 0, negatives -> 0, half-even to int."""
    out = df
    for c in cols:
        if c in out.columns:
            v = F.greatest(_number(c), F.lit(0.0))
            out = out.withColumn(c, F.rint(v).cast("int"))
        else:
            out = out.withColumn(c, F.lit(0))
    return out


def clean_floats(df: DataFrame, cols=S.FLOAT_COLS) -> DataFrame:
    """Null and NaN -> 0.0 as double (absent columns stay absent)."""
    return df.withColumns({c: _number(c) for c in cols if c in df.columns})


def dedupe_fullest(df: DataFrame, keys=("player_id", "season", "week")) -> DataFrame:
    """C4: one row per key, keeping the fullest record (max receiving_yards,
    else max receptions). The key is unique after this, so the window partition
    is the duplicate group: tiny even when one player is hot."""
    sort_col = "receiving_yards" if "receiving_yards" in df.columns else "receptions"
    tie = [F.col(c).desc_nulls_last() for c in ("receptions", "targets", "carries")
           if c in df.columns and c != sort_col]
    tie += [F.col(c).desc_nulls_last() for c in sorted(df.columns)]   # any other difference decides the rest
    w = Window.partitionBy(*keys).orderBy(F.col(sort_col).desc_nulls_last(), *tie)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def fantasy_points(df: DataFrame, scoring: Mapping[str, float] = S.SCORING, digits: int = 2) -> Column:
    """Sum of weight x stat over the scoring map; absent columns skipped,
    nulls count 0; rounded half-even."""
    total: Column = F.lit(0.0)
    for c, w in scoring.items():
        if c in df.columns:
            total = total + F.coalesce(F.col(c), F.lit(0)) * float(w)
    return round_half_even(total, digits)


def derive_totals(df: DataFrame) -> DataFrame:
    """yards = receiving + rushing, touchdowns = receiving + rushing."""
    def get(c, zero):
        return F.col(c) if c in df.columns else F.lit(zero)
    return df.withColumns({
        "yards": get("receiving_yards", 0.0) + get("rushing_yards", 0.0),
        "touchdowns": get("receiving_tds", 0) + get("rushing_tds", 0),
    })


def normalise_opponent(c: str | Column = "opponent_team") -> Column:
    """Null -> 'UNK', upper-case, first 8 characters."""
    col = F.col(c) if isinstance(c, str) else c
    return F.substring(F.upper(F.coalesce(col.cast("string"), F.lit("UNK"))), 1, 8)


def project_clean(df: DataFrame) -> DataFrame:
    """The fixed 14-column clean schema (two renames; is_home constant
    unless the feed supplies it)."""
    is_home = F.col("is_home").cast("boolean") if "is_home" in df.columns else F.lit(True)
    return df.select(
        "player_id", F.col("player_display_name").alias("name"), "position",
        F.col("recent_team").alias("team"),
        F.col("season").cast("int").alias("season"), F.col("week").cast("int").alias("week"),
        "opponent", is_home.alias("is_home"), "targets", "carries", "receptions",
        "yards", "touchdowns", "fantasy_points",
    )


def joinable_weekly(raw: DataFrame) -> DataFrame:
    """Joinable rows with clean numbers, duplicates still among them."""
    return clean_floats(clean_counts(drop_unjoinable(raw)))


def shaped_weekly(unique: DataFrame) -> DataFrame:
    """C5-C8 over rows that are unique by key."""
    df = unique.withColumn("fantasy_points", fantasy_points(unique))
    df = derive_totals(df).withColumn("opponent", normalise_opponent("opponent_team"))
    return project_clean(df)


def clean_weekly(raw: DataFrame, counts: dict | None = None) -> DataFrame:
    """C1-C8 composed: the weekly feed in the relational fact's shape.

    With `counts` (an empty dict) every stage counts its rows while the result
    is computed; after an action `observed_counts(counts)` has them.
    """
    def counted(df: DataFrame, stage: str) -> DataFrame:
        if counts is None:
            return df
        df, counts[stage] = observed(df, stage)
        return df

    joinable = counted(joinable_weekly(counted(raw, "raw")), "drop_unjoinable")
    return counted(shaped_weekly(counted(dedupe_fullest(joinable), "dedupe_fullest")), "clean_weekly")


def clean_rosters(rosters: DataFrame, order_col: str = "season") -> DataFrame:
    """Drop null ids, keep the latest row per player (by `order_col`, the
    explicit version of 'keep last'), rename, coerce numerics, +-inf -> null."""
    df = rosters.where(F.col("player_id").isNotNull())
    if order_col in df.columns:
        rest = [F.col(c).desc_nulls_last() for c in sorted(df.columns)]   # any other difference decides ties
        w = Window.partitionBy("player_id").orderBy(F.col(order_col).desc_nulls_last(), *rest)
        df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    renames = {"player_name": "name", "height": "height_inches", "weight": "weight_lbs"}
    df = df.select(*[F.col(c).alias(renames.get(c, c)) for c in df.columns])
    numeric = ("age", "height_inches", "weight_lbs", "draft_round", "draft_pick", "rookie_season")
    out = {}
    for c in numeric:
        if c in df.columns:
            v = F.col(c).try_cast("double")
            out[c] = F.when(v.isin(float("inf"), float("-inf")), None).otherwise(v)
    return df.withColumns(out)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """C10 (streaming-friendly): attach a row counter that is filled in by
    whatever action runs the frame - no extra pass over the data."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def observed_counts(counts: Mapping[str, object]) -> dict[str, int]:
    """Rows by stage of a `clean_weekly(raw, counts)` that an action has run.

    For the log of a run: a map task that is computed again after an executor
    was lost is counted again. `stage_counts` is exact.
    """
    return {stage: seen.get["rows"] for stage, seen in counts.items()}


def stage_counts(raw: DataFrame, keys=("player_id", "season", "week"), also=("position", "recent_team")) -> DataFrame:
    """(stage, rows_in, rows_out, dropped) of every cleaning stage, exact, in one pass over `raw`.

    What a stage keeps follows from the rows by key (C1 decides by row, C4 leaves
    one a key), so one aggregate by key tells all; it combines map-side.
    """
    needed = [*keys, *[c for c in also if c in raw.columns]]
    whole = reduce(and_, [_present(raw, c) for c in needed])
    by_key = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("ok"))
    total = by_key.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in (
        ("raw", F.sum("n")), ("joinable", F.sum("ok")), ("unique", F.count_if(F.col("ok") > 0)))])
    steps = (("drop_unjoinable", "raw", "joinable"), ("clean_numbers", "joinable", "joinable"),
             ("dedupe_fullest", "joinable", "unique"), ("shape", "unique", "unique"), ("clean_weekly", "raw", "unique"))
    rows = F.array(*[F.struct(F.lit(stage).alias("stage"), F.col(a).alias("rows_in"), F.col(b).alias("rows_out"),
                              (F.col(a) - F.col(b)).alias("dropped")) for stage, a, b in steps])
    return total.select(F.inline(rows))


def _present(df: DataFrame, c: str) -> Column:
    """Neither null nor NaN, as `dropna` has it."""
    there = F.col(c).isNotNull()
    return there & ~F.isnan(c) if df.schema[c].dataType.typeName() in ("double", "float") else there


def row_accounting(stage: str, rows_in: DataFrame, rows_out: DataFrame) -> DataFrame:
    """One row (stage, rows_in, rows_out, dropped); both counts are
    scalar subqueries so the result stays a lazy plan."""
    n_in = rows_in.select(F.count(F.lit(1))).scalar()
    n_out = rows_out.select(F.count(F.lit(1))).scalar()
    spark = rows_in.sparkSession
    return spark.range(1).select(F.lit(stage).alias("stage"), n_in.alias("rows_in"),
                                 n_out.alias("rows_out"), (n_in - n_out).alias("dropped"))
