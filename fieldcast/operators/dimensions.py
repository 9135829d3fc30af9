"""Season-versioned dimensions: what was known of an entity in each season.

``versions`` turns observations, each of which counts from a season on, into
rows with a validity range ``[valid_from, valid_to)``; ``as_of`` adds the version
of a row's own season, so a later observation changes no earlier row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(observed: DataFrame, keys: Sequence[str], columns: Sequence[str], period: str = "season",
             order: Sequence[str] = ()) -> DataFrame:
    """(keys, valid_from, valid_to, columns): one row for each change of an entity; the newest is open (null).

    Of the observations that count from the same period the last by ``order``
    stays, ties by the columns themselves. That aggregate combines map-side, so
    the window sees at most one row per entity and period, however often a hot
    entity was observed. Rows without a key or period tell nothing and are left out.
    """
    told = observed.dropna(subset=[*keys, period])
    state = F.struct(*columns)
    last = told.groupBy(*keys, period).agg(F.max_by(state, F.struct(*order, *columns)).alias("_state"))
    w = Window.partitionBy(*keys).orderBy(period)
    before = F.lag("_state").over(w)
    changed = last.withColumn("_changed", before.isNull() | ~before.eqNullSafe(F.col("_state"))).where("_changed")
    return changed.select(*keys, F.col(period).alias("valid_from"), F.lead(period).over(w).alias("valid_to"), "_state.*")


def as_of(frame: DataFrame, dimension: DataFrame, keys: Sequence[str], period: str = "season") -> DataFrame:
    """``frame`` with the columns of each row's version in its own period; null before the first one.

    The join is by key; ranges of a key do not overlap, so a row stays one row.
    """
    added = [c for c in dimension.columns if c not in (*keys, "valid_from", "valid_to")]
    if clash := set(added) & set(frame.columns):
        raise ValueError(f"columns {sorted(clash)} are in the frame already")
    known = dimension.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, [F.col(k) == F.col(f"_of_{k}") for k in keys])
    valid = (F.col(period) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(period) < F.col("valid_to")))
    return frame.join(known, same & valid, "left").select(*frame.columns, *added)


def roster_versions(rosters: DataFrame) -> DataFrame:
    """Versions of (team, position, born) by external_id from rosters of (external_id, season, team, position, age).

    The season of birth stands for the age, which would change every season.
    """
    rows = rosters.withColumn("born", F.col("season") - F.col("age"))
    return versions(rows, ["external_id"], ["team", "position", "born"])
