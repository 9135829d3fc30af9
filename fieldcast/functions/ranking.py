"""Skew-proof ranking and latest-per-key helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per `key`: the row with the greatest struct(order...).

    An aggregate with map-side partial max_by (sorted, as the buffer is a
    struct), so a key holding a third
    of all rows is combined inside each map task rather than sorted in one
    reducer (which is what row_number-over-key would do).
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    agg = df.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row"))
    return agg.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def rank_desc(df: DataFrame, part: Sequence[str], value: str, out: str = "rank",
              buckets: int = 64, relative_error: float = 0.001) -> DataFrame:
    """Exact RANK() (1 + number of strictly larger values) within `part`,
    without putting a whole partition in one task.

    Equal values are counted first, so ties cost one row. The distinct values
    of a partition are cut into ranges at approximate quantiles: a range's rank
    offset is the rows in higher ranges, and the rest is a window inside the
    range. Null partition values form a partition of their own and null values
    rank last, as in RANK().
    """
    part = list(part)
    same = lambda cols: reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols], F.lit(True))
    values = df.groupBy(*part, value).agg(F.count(F.lit(1)).alias("_n"))
    probs = [i / buckets for i in range(1, buckets)]
    splits = values.groupBy(*part).agg(F.percentile_approx(value, probs, int(1 / relative_error)).alias("_splits"))
    # bucket = number of split points strictly below the value (monotone).
    bucket = F.size(F.filter(F.coalesce("_splits", F.array().cast("array<double>")), lambda s: s < F.col(value)))
    ranged = (values.alias("a").join(splits.alias("b"), same(part), "left")
              .select("a.*", "b._splits").withColumn("_b", bucket).drop("_splits"))
    counts = ranged.groupBy(*part, "_b").agg(F.sum("_n").alias("_sum"))
    higher = Window.partitionBy(*part).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.select(*part, "_b", F.coalesce(F.sum("_sum").over(higher), F.lit(0)).alias("_above"))
    before = Window.partitionBy(*part, "_b").orderBy(F.col(value).desc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranks = (inside.alias("a").join(above.alias("b"), same([*part, "_b"]))
             .select(*[F.col(f"a.{c}").alias(f"_k{i}") for i, c in enumerate([*part, value])],
                     (F.col("b._above") + F.col("a._before") + 1).cast("int").alias(out)))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*part, value])])
    return df.join(ranks, on).select(*df.columns, out)
