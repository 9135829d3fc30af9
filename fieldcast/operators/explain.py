"""Attribution and its text.

For a linear model the exact per-row attribution is coef_j * (x_j - mean_j):
the contributions plus the baseline (the prediction at the training means)
sum to the prediction. They are produced as a long table with one explode of
an array of structs - no UDF, no driver loop. Heuristic models are refused,
as the reference refuses non-tree models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.functions.columns import fmt0, fmt1


class ExplainUnsupported(ValueError):
    pass


def attribution(rows: DataFrame, model, keys: Sequence[str]) -> DataFrame:
    """(keys..., baseline, projection, feature, value, contribution)."""
    if getattr(model, "framework", None) not in ("linear", "monotone_linear"):
        raise ExplainUnsupported(f"{getattr(model, 'version', model)} has no exact attribution")
    keys = list(keys)
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                      ((F.col(f).cast("double") - F.lit(float(m))) * F.lit(float(c))).alias("contribution"))
             for f, c, m in zip(model.features, model.coef, model.means)]
    base = float(model.baseline)
    wide = rows.select(*keys, F.lit(base).alias("baseline"), model.predict("projection"),
                       F.explode(F.array(*parts)).alias("_d"))
    return wide.select(*keys, "baseline", "projection", "_d.feature", "_d.value", "_d.contribution")


def top_drivers(long: DataFrame, keys: Sequence[str], n: int = 6) -> DataFrame:
    """The `n` (1..20) largest contributions by magnitude per row key
    (per-key top-k, planned as a WindowGroupLimit before the shuffle)."""
    if not 1 <= n <= 20:
        raise ValueError("top must be within 1..20")
    w = Window.partitionBy(*keys).orderBy(F.abs("contribution").desc(), "feature")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _label(feature: Column) -> Column:
    m = F.create_map(*[x for k, v in S.LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[feature], F.regexp_replace(feature, "_", " "))


def format_value(feature: Column, value: Column) -> Column:
    """Unit classes: flag yes/no, share as whole percent, counts and age as
    whole numbers, the rest with one decimal (all half-even)."""
    return F.when(feature.isin(*S.FLAG_FEATURES), F.when(value > 0.5, "yes").otherwise("no")) \
        .when(feature.isin(*S.SHARE_FEATURES), F.concat(fmt0(value * 100), F.lit("%"))) \
        .when(feature.isin(*S.COUNT_FEATURES, "age"), fmt0(value)) \
        .otherwise(fmt1(value))


def driver_text(drivers: DataFrame) -> DataFrame:
    """Label, formatted value and one sentence per driver."""
    f, v, c = F.col("feature"), F.col("value"), F.col("contribution")
    direction = F.when(c >= 0, "raises").otherwise("lowers")
    return drivers.withColumns({
        "label": _label(f), "formatted": format_value(f, v),
    }).withColumn("text", F.concat(F.col("label"), F.lit(" ("), F.col("formatted"), F.lit(") "), direction,
                                   F.lit(" the projection by "), fmt1(F.abs(c))))


def headline(drivers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Biggest reason up; 'held back by' the biggest reason down."""
    d = driver_text(drivers)
    phrase = F.concat(F.col("label"), F.lit(" "), F.col("formatted"))
    g = d.groupBy(*keys).agg(
        F.max_by(phrase, F.when(F.col("contribution") > 0, F.col("contribution"))).alias("_up"),
        F.min_by(phrase, F.when(F.col("contribution") < 0, F.col("contribution"))).alias("_down"))
    text = F.concat_ws("; ", F.col("_up"), F.concat(F.lit("held back by "), F.col("_down")))
    return g.select(*keys, F.when(F.col("_up").isNull() & F.col("_down").isNull(),
                                  F.lit("no single dominant factor")).otherwise(text).alias("headline"))
