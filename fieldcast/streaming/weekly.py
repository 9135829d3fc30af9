"""The weekly load as an incremental Structured Streaming job.

New weekly parquet files land in a folder. Each micro-batch is cleaned (C1-C3)
and merged into a season-partitioned table of the fullest records (C4 across
deliveries: a thinner duplicate that comes late loses to the stored one). The
records of the batch's keys are then shaped (C5-C8), mapped to surrogate ids
(unknown players dropped) and upserted into the season-partitioned stats table
(W2). Only the seasons that a batch touches are rewritten.

`weekly_run` is the whole weekly job on the same deliveries: players are
upserted too (W1), the next week's features are built and scored (F4, M4, M11),
and the predictions are appended to a log keyed by batch (W3).

Progress lives in the checkpoint, so a restarted job resumes after the last
committed batch, and a replayed batch is harmless: every step gives the same
tables however often it is applied, and a batch is in the log once.

``trigger(availableNow=True)`` processes what is there and stops, which is
the scheduler's weekly run; a long-running trigger works unchanged.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldcast.functions.ranking import latest_per_key
from fieldcast.operators import cleaning as C
from fieldcast.operators import inseason as ins
from fieldcast.operators import preseason as P
from fieldcast.operators import scoring as M
from fieldcast.operators import tables as W
from fieldcast.session import cut_lineage

STATS_KEY = ("player_id", "season", "week")
STATS_SCHEMA = T.StructType([
    T.StructField("player_id", T.LongType()), T.StructField("season", T.IntegerType()),
    T.StructField("week", T.IntegerType()), T.StructField("opponent", T.StringType()),
    T.StructField("is_home", T.BooleanType()), T.StructField("targets", T.IntegerType()),
    T.StructField("carries", T.IntegerType()), T.StructField("receptions", T.IntegerType()),
    T.StructField("yards", T.DoubleType()), T.StructField("touchdowns", T.IntegerType()),
    T.StructField("fantasy_points", T.DoubleType()),
])


#: Records as they are merged: the feed's columns after C1-C3.
RECORD_SCHEMA = T.StructType([
    T.StructField("player_id", T.StringType()), T.StructField("player_display_name", T.StringType()),
    T.StructField("position", T.StringType()), T.StructField("recent_team", T.StringType()),
    T.StructField("season", T.IntegerType()), T.StructField("week", T.IntegerType()),
    T.StructField("opponent_team", T.StringType()), T.StructField("targets", T.IntegerType()),
    T.StructField("carries", T.IntegerType()), T.StructField("receptions", T.IntegerType()),
    T.StructField("receiving_yards", T.DoubleType()), T.StructField("receiving_tds", T.IntegerType()),
    T.StructField("rushing_yards", T.DoubleType()), T.StructField("rushing_tds", T.IntegerType()),
])
PLAYER_SCHEMA = T.StructType([
    T.StructField("player_id", T.LongType()), T.StructField("external_id", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("team", T.StringType()),
    T.StructField("position", T.StringType()),
    T.StructField("seen_season", T.IntegerType()), T.StructField("seen_week", T.IntegerType()),
])
LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("player_id", T.LongType()),
    T.StructField("season", T.IntegerType()), T.StructField("week", T.IntegerType()),
    T.StructField("opponent", T.StringType()), T.StructField("prediction", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("model_version", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("batch_id", T.LongType()),
])


def merged_records(spark: SparkSession, batch: DataFrame, records_path: str, staging: str) -> DataFrame:
    """C1-C4 of a delivery against the stored records; the clean rows (C5-C8) of its keys, as they stand now."""
    rows = C.joinable_weekly(batch)
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA.fields])
    W.merge_fullest(spark, records_path, rows, RECORD_SCHEMA, staging_root=os.path.join(staging, "records"))
    stored = W.read_table(spark, records_path, RECORD_SCHEMA)
    return C.shaped_weekly(stored.join(rows.select(*STATS_KEY).distinct(), list(STATS_KEY), "left_semi"))


def weekly_upsert_batch(spark: SparkSession, players: DataFrame, stats_path: str, staging_root: str):
    """The foreachBatch body of W10: merge records -> clean -> map ids -> partition-scoped upsert."""

    def run(batch: DataFrame, batch_id: int) -> None:
        staging = os.path.join(staging_root, f"batch-{batch_id}")
        weekly = merged_records(spark, batch, f"{stats_path}_records", staging)
        W.upsert_table(spark, stats_path, W.stats_updates(weekly, players), STATS_KEY, "season", STATS_SCHEMA,
                       staging_root=os.path.join(staging, "stats"))

    return run


def weekly_run_batch(spark: SparkSession, root: str, staging_root: str, created_at: str | None = None):
    """The foreachBatch body of the whole weekly job; its tables lie under `root`.

    Time stamps are those of the batch (`created_at`, else the clock). A batch
    without a new game of a season to project appends nothing.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        staging = os.path.join(staging_root, f"batch-{batch_id}")
        players_path, stats_path, log_path = (f"{root}/{n}" for n in ("players", "player_stats", "predictions"))
        # the players and the games both come from the merged rows
        weekly, kept = W.stored_once(spark, merged_records(spark, batch, f"{root}/records", staging), staging, "weekly")
        _upsert_players(spark, players_path, weekly)
        players = W.published(spark, players_path, PLAYER_SCHEMA)
        W.upsert_table(spark, stats_path, W.stats_updates(weekly, players), STATS_KEY, "season", STATS_SCHEMA,
                       staging_root=os.path.join(staging, "stats"))
        W.drop_files(spark, kept)
        stats = W.read_table(spark, stats_path, STATS_SCHEMA)
        if stats.isEmpty():
            return
        now = P.next_period(stats).first()
        season, week = now["season"], now["next_week"]
        scored = M.batch_score_weekly(ins.upcoming_features(players, stats, season, week), season, week)
        log = W.read_table(spark, log_path, LOG_SCHEMA).where(F.col("batch_id") != batch_id)   # not a replay's own rows
        start = log.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
        stamp = F.to_timestamp(F.lit(created_at)) if created_at else F.current_timestamp()
        new = W.assign_ids(scored, "player_id", start, out="id").withColumn("created_at", stamp)
        W.append_once(spark, log_path, new, batch_id, LOG_SCHEMA)

    return run


def _upsert_players(spark: SparkSession, path: str, weekly: DataFrame) -> None:
    """W1 in storage: the latest identity of each player of the delivery, unless a later one is known; new ones get ids."""
    base = W.published(spark, path, PLAYER_SCHEMA)
    latest = cut_lineage(latest_per_key(   # a row a player
        weekly.select(F.col("player_id").alias("external_id"), "season", "week", "name", "team", "position"),
        ["external_id"], ["season", "week"]))
    ups = W.newer_identities(base, latest).select(
        "external_id", "name", "team", "position", F.col("season").alias("seen_season"), F.col("week").alias("seen_week"))
    W.publish(spark, path, W.fill_ids(W.merge_upsert(base, ups, ["external_id"]), base).select(*PLAYER_SCHEMA.fieldNames()))


def _started(spark: SparkSession, source_dir: str, feed_schema: T.StructType, body, checkpoint: str,
             max_files_per_trigger: int, available_now: bool) -> StreamingQuery:
    stream = spark.readStream.schema(feed_schema).option("maxFilesPerTrigger", max_files_per_trigger) \
        .parquet(source_dir)
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", os.path.join(checkpoint, "offsets"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def incremental_weekly(spark: SparkSession, source_dir: str, feed_schema: T.StructType, players: DataFrame,
                       stats_path: str, checkpoint: str, max_files_per_trigger: int = 1,
                       available_now: bool = True) -> StreamingQuery:
    """Start the stream over `source_dir` (returns the running query)."""
    body = weekly_upsert_batch(spark, players, stats_path, os.path.join(checkpoint, "staging"))
    return _started(spark, source_dir, feed_schema, body, checkpoint, max_files_per_trigger, available_now)


def weekly_run(spark: SparkSession, source_dir: str, feed_schema: T.StructType, root: str, checkpoint: str,
               max_files_per_trigger: int = 1, available_now: bool = True,
               created_at: str | None = None) -> StreamingQuery:
    """The whole weekly job over `source_dir`; tables records, players, player_stats and predictions under `root`."""
    body = weekly_run_batch(spark, root, os.path.join(checkpoint, "staging"), created_at)
    return _started(spark, source_dir, feed_schema, body, checkpoint, max_files_per_trigger, available_now)
