"""Source operators (S1-S13): reading, schema reconciliation, optional feeds."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast import schemas as S
from fieldcast.functions.columns import clip, round_half_even
from fieldcast.operators.dimensions import versions


log = logging.getLogger(__name__)
#: What Spark calls a source that is not there or has no columns.
ABSENT_CONDITIONS = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA",
                     "UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION")


class SchemaMismatch(KeyError):
    """A feed arrived but lacks required columns (not a transport problem)."""


class MissingSeasonData(FileNotFoundError):
    """Expected season files are absent."""


# ----------------------------------------------------------------- S3 / S4 / S5
def first_present(df: DataFrame, names: Iterable[str]) -> str | None:
    """The first of ``names`` that is a column of ``df``."""
    return next((n for n in names if n in df.columns), None)


def apply_aliases(df: DataFrame, aliases: Mapping[str, Iterable[str]]) -> DataFrame:
    """S3: give each canonical column the first of its aliases that is present, in one projection.

    A canonical column that already exists wins and its aliases stay untouched.
    An alias of several canonical columns goes to the one listed first.
    """
    source = {name: first_present(df, [name, *others]) for name, others in aliases.items()}
    new_name = {old: name for name, old in reversed(source.items()) if old not in (None, name)}
    return df.withColumnsRenamed(new_name)


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "feed") -> DataFrame:
    """Fail before any action when required columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaMismatch(
            f"{what} is missing required column(s) {missing}. Columns present: "
            f"{sorted(df.columns)[:25]}")
    return df


def project_known(df: DataFrame, wanted: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Keep the known columns that exist; return (frame, absent column names)."""
    wanted = list(wanted)
    keep = [c for c in wanted if c in df.columns]
    absent = [c for c in wanted if c not in df.columns]
    return df.select(*keep), absent


def filter_positions(df: DataFrame, positions=S.INGEST_POSITIONS, col: str = "position") -> DataFrame:
    """Keep configured positions (pushed into the parquet scan)."""
    return df.where(F.col(col).isin(*positions))


# ----------------------------------------------------------------- S1 / S2
#: The files of a season, by kind; the month a season starts in.
FILE_KINDS = ("player_stats", "roster")
SEASON_START_MONTH = 9
WEEKLY_REQUIRED = ("player_id", "season", "week", "position")
ROSTER_REQUIRED = ("player_id",)


def season_files(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, season, path) of the season files in a folder, ``<kind>_<year>.parquet``; none if it is not there.

    Spark lists the folder, so it can lie in any store; contents are not read.
    """
    file = f"^(.*/({'|'.join(FILE_KINDS)})_([0-9]{{4}})[.]parquet)(/.*)?$"
    try:
        paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_frame(spark, T.StructType([T.StructField("kind", T.StringType()), T.StructField("season", T.IntegerType()),
                                                T.StructField("path", T.StringType())]))
    return paths.where(F.col("path").rlike(file)).select(
        F.regexp_extract("path", file, 2).alias("kind"), F.regexp_extract("path", file, 3).cast("int").alias("season"),
        F.regexp_extract("path", file, 1).alias("path")).distinct()


def file_status(spark: SparkSession, folder: str, seasons: Iterable[int]) -> DataFrame:
    """(kind, season, present) of every file that the seasons need."""
    wanted = spark.createDataFrame([(k, int(s)) for s in seasons for k in FILE_KINDS], "kind string, season int")
    found = season_files(spark, folder).select("kind", "season", F.lit(True).alias("_found"))
    return wanted.join(found, ["kind", "season"], "left").select(
        "kind", "season", F.coalesce("_found", F.lit(False)).alias("present"))


def complete_source(spark: SparkSession, folders: Mapping[str, str], seasons: Iterable[int]) -> tuple[str, dict]:
    """The first of the folders (by preference) with every file of the seasons: its name, and {kind: {season: path}}.

    Raises ``MissingSeasonData`` with what each folder lacks if none has them
    all. The driver holds one path a season and kind.
    """
    seasons, lacks = sorted(set(map(int, seasons))), {}
    for name, folder in folders.items():
        paths: dict[str, dict[int, str]] = {k: {} for k in FILE_KINDS}
        for r in season_files(spark, folder).where(F.col("season").isin(seasons)).collect():
            paths[r["kind"]][r["season"]] = r["path"]
        absent = [f"{k}_{s}.parquet" for s in seasons for k in FILE_KINDS if s not in paths[k]]
        if not absent:
            return name, paths
        lacks[name] = absent
    raise MissingSeasonData("; ".join(f"{n} lacks {len(a)} file(s): {', '.join(a)}" for n, a in lacks.items())
                            or "no source folder given")


def load_source(spark: SparkSession, folders: Mapping[str, str], seasons: Iterable[int],
                ) -> tuple[DataFrame, DataFrame, str]:
    """The weekly rows and rosters of the seasons from the first complete folder, and its name."""
    name, paths = complete_source(spark, folders, seasons)
    weekly = read_seasons(spark, paths["player_stats"], S.WEEKLY_ALIASES, WEEKLY_REQUIRED)
    rosters = read_seasons(spark, paths["roster"], S.ROSTER_ALIASES, ROSTER_REQUIRED)
    return weekly, rosters, name


def stack_seasons(frames: Mapping[int, DataFrame], aliases: Mapping[str, Iterable[str]],
                  required: Iterable[str] = ()) -> DataFrame:
    """Alias each season's frame to canonical names, then union by name.

    Columns absent from some seasons become null (allowMissingColumns).
    """
    parts = [require_columns(apply_aliases(df, aliases), required, f"season {s}")
             for s, df in sorted(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_seasons(spark: SparkSession, paths: Mapping[int, str],
                 aliases: Mapping[str, Iterable[str]], required: Iterable[str] = ()) -> DataFrame:
    """S1 over files: one parquet per season, schemas reconciled, stacked lazily."""
    return stack_seasons({s: spark.read.parquet(p) for s, p in paths.items()}, aliases, required)


def source_status(expected: DataFrame, found: DataFrame, key: str = "season") -> DataFrame:
    """(key, present) for every expected key; `found` are keys seen in storage."""
    seen = found.select(F.col(key).alias("_k")).distinct().withColumn("_present", F.lit(True))
    return expected.join(seen, expected[key] == seen["_k"], "left").select(
        expected[key], F.coalesce(F.col("_present"), F.lit(False)).alias("present"))


def assert_complete(status: DataFrame, key: str = "season") -> None:
    """S2 fail-fast: raise listing every missing key (a small driver-side list)."""
    missing = [r[0] for r in status.where(~F.col("present")).select(key).orderBy(key).collect()]
    if missing:
        raise MissingSeasonData(f"{len(missing)} season file(s) missing: {missing}")


# ----------------------------------------------------------------- S7
def derive_age(df: DataFrame, season_col: str = "season", default_season: int | None = None) -> DataFrame:
    """Age at 1 September of the season from birth_date, 1 dp; bad date -> null.

    No-op when age already exists or birth_date is absent.
    """
    if "age" in df.columns or "birth_date" not in df.columns:
        return df
    season = F.col(season_col) if season_col in df.columns else F.lit(default_season)
    start = F.make_date(season.cast("int"), F.lit(9), F.lit(1))
    born = F.try_to_date(F.col("birth_date"), "yyyy-MM-dd")
    return df.withColumn("age", round_half_even(F.datediff(start, born) / 365.25, 1))


# ----------------------------------------------------------------- S8 / S9
DRAFT_SCHEMA = T.StructType([
    T.StructField("external_id", T.StringType()),
    T.StructField("draft_round", T.IntegerType()),
    T.StructField("draft_pick", T.IntegerType()),
])


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """Deterministic 'first row per key' (dropDuplicates with a tie-break order)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def read_draft_picks(picks: DataFrame, season: int | None = None) -> DataFrame:
    """gsis_id/round/pick -> external_id/draft_round/draft_pick, one per key."""
    if "gsis_id" not in picks.columns or not {"round", "pick"} <= set(picks.columns):
        return empty_frame(picks.sparkSession, DRAFT_SCHEMA)
    df = picks
    if season is not None and "season" in df.columns:
        df = df.where(F.col("season").try_cast("int") == season)
    df = df.select(
        F.col("gsis_id").alias("external_id"),
        F.col("round").try_cast("int").alias("draft_round"),
        F.col("pick").try_cast("int").alias("draft_pick"),
    ).where(F.col("external_id").isNotNull())
    return first_per_key(df, "external_id", [F.col("draft_pick").asc_nulls_last(),
                                             F.col("draft_round").asc_nulls_last()])


# Where each bio column comes from, best source first.
BIO_SOURCES = {
    "external_id": ("gsis_id",),
    "pfr_id": ("pfr_id",),
    "draft_round": ("draft_round",),
    "draft_pick": ("draft_pick",),
    "rookie_season": ("rookie_season",),
    "years_of_experience": ("years_of_experience",),
}
IDENTITY_SOURCES = {
    "name": ("display_name", "full_name"),
    "position": ("position",),
    "team": ("latest_team", "team_abbr"),
}


def read_bios(bios: DataFrame, full: bool = False) -> DataFrame:
    """Bio + crosswalk, one row per player; first available source column per target name.

    Rows without an id are left out. Of rows that repeat an id, the first stays in
    the order of all columns, nulls last, so any run picks the same one.
    """
    sources = BIO_SOURCES | (IDENTITY_SOURCES if full else {})
    columns = [F.col(old).alias(new) for new, old in ((n, first_present(bios, c)) for n, c in sources.items()) if old]
    if first_present(bios, sources["external_id"]) is None:
        return empty_frame(bios.sparkSession, T.StructType([T.StructField("external_id", T.StringType())]))
    rows = bios.select(*columns).where("external_id is not null")
    return first_per_key(rows, "external_id", [F.col(c).asc_nulls_last() for c in rows.columns])


# ----------------------------------------------------------------- S10 / S11
def snap_share(snaps: DataFrame, crosswalk: DataFrame, season: int | None = None) -> DataFrame:
    """Mean offense_pct per pfr id, keyed to external_id via the crosswalk.

    If the largest mean exceeds 1.5 the feed is in percent and every value is
    divided by 100. The maximum is a scalar subquery (one extra aggregate), not
    a cross join or an un-partitioned window.
    """
    if not {"pfr_player_id", "offense_pct"} <= set(snaps.columns) or "pfr_id" not in crosswalk.columns:
        return empty_frame(snaps.sparkSession, T.StructType([
            T.StructField("external_id", T.StringType()),
            T.StructField("prior_snap_share", T.DoubleType())]))
    s = snaps if season is None or "season" not in snaps.columns else snaps.where(F.col("season") == season)
    means = s.groupBy(F.col("pfr_player_id").alias("pfr_id")).agg(
        F.avg("offense_pct").alias("share"))
    joined = means.join(crosswalk.select("external_id", "pfr_id"), "pfr_id")
    top = joined.select(F.max("share")).scalar()
    return joined.select("external_id", F.when(top > 1.5, F.col("share") / 100.0)
                         .otherwise(F.col("share")).alias("prior_snap_share"))


def known_season(at: Column) -> Column:
    """The first season that starts (1 September) after a moment: what is known then counts for it."""
    return F.year(F.add_months(at.try_cast("date"), 12 - SEASON_START_MONTH + 1))


def charted_ranks(depth: DataFrame) -> DataFrame | None:
    """(external_id, season, precedence, rank) of a depth feed in either schema; None for any other.

    New schema (dt, pos_rank): a chart counts from the next season to start, and
    the later one takes precedence. Old schema (depth_team; season and week
    where present): a chart counts for its season, and the earlier week, nearest
    to the pre-season, takes precedence. Ranks that are no number are left out.
    """
    columns = set(depth.columns)
    if {"gsis_id", "pos_rank", "dt"} <= columns:
        rank, season, precedence = F.col("pos_rank"), known_season(F.col("dt")), F.col("dt").try_cast("timestamp")
    elif {"gsis_id", "depth_team"} <= columns:
        rank = F.col("depth_team")
        season = F.col("season").try_cast("int") if "season" in columns else F.lit(None).cast("int")
        precedence = -F.col("week").try_cast("int") if "week" in columns else F.lit(0)
    else:
        return None
    return depth.select(F.col("gsis_id").alias("external_id"), season.alias("season"), precedence.alias("precedence"),
                        rank.try_cast("double").alias("rank")).where("rank is not null and not isnan(rank)")


def _clipped(rank: str) -> Column:
    return clip(F.col(rank), 1, 10).cast("int").alias("depth_chart_rank")


def depth_rank(depth: DataFrame, season: int | None = None) -> DataFrame:
    """Depth-chart rank per player, both known schemas, clipped 1..10.

    The chart with precedence wins, ties by the larger rank. With ``season`` only
    charts of that season (old schema) or known before it starts (new schema) count.
    """
    ranks = charted_ranks(depth)
    if ranks is None:
        return empty_frame(depth.sparkSession, T.StructType([
            T.StructField("external_id", T.StringType()), T.StructField("depth_chart_rank", T.IntegerType())]))
    if season is not None:
        ranks = ranks.where(F.col("season") <= season if "pos_rank" in depth.columns else F.col("season") == season)
    best = ranks.groupBy("external_id").agg(F.max_by("rank", F.struct("precedence", "rank")).alias("r"))
    return best.select("external_id", _clipped("r"))


def depth_versions(depth: DataFrame) -> DataFrame:
    """S11 by season: (external_id, valid_from, valid_to, depth_chart_rank), the rank known at the start of each season.

    A rank holds until a chart changes it. An unknown schema gives no rows.
    """
    ranks = charted_ranks(depth)
    if ranks is None:
        return empty_frame(depth.sparkSession, T.StructType([
            T.StructField("external_id", T.StringType()), T.StructField("valid_from", T.IntegerType()),
            T.StructField("valid_to", T.IntegerType()), T.StructField("depth_chart_rank", T.IntegerType())]))
    ranks = ranks.select("external_id", "season", "precedence", _clipped("rank"))
    return versions(ranks, ["external_id"], ["depth_chart_rank"], order=["precedence"])


# ----------------------------------------------------------------- S12 / S13
def optional_feed(load: Callable[[], DataFrame], schema: T.StructType,
                  spark: SparkSession) -> DataFrame:
    """An absent feed, or one without the schema's columns, degrades to an empty
    frame of the declared schema, so downstream left joins yield nulls/defaults.

    Each such case is logged. Any other failure (denied access, corrupt files) is raised.
    """
    try:
        return require_columns(load(), schema.fieldNames()).select(
            *[F.col(f.name).cast(f.dataType) for f in schema.fields])
    except (FileNotFoundError, SchemaMismatch) as e:
        reason = e
    except AnalysisException as e:
        if e.getCondition() not in ABSENT_CONDITIONS:
            raise
        reason = e
    log.warning("optional feed left out: %s", reason)
    return empty_frame(spark, schema)


def sql_params(spark: SparkSession, sql: str, args: Mapping[str, object], **frames: DataFrame) -> DataFrame:
    """Parameterised SQL (named ``:param`` markers, DataFrames as ``{name}``)."""
    return spark.sql(sql, args=dict(args), **frames)
