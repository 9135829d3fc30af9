"""Registered table-maintenance queries (W1-W10), computed over the whole input tables.

W1 and W3-W7 store the table, run the operation twice, as a job that is repeated
after a failure does, and return what is read back from storage.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast import schemas as S
from fieldcast.operators import cleaning as C
from fieldcast.operators import inseason as ins
from fieldcast.operators import preseason as P
from fieldcast.operators import scoring as M
from fieldcast.operators import tables as W
from fieldcast.plans.q_cleaning import _CLEAN, ROSTERS_CLEAN
from fieldcast.plans.q_preseason import CONTEXT_DOUBLES, CONTEXT_SQL, FEEDS, _ps, _targets, _volumes, context_table
from fieldcast.plans.q_inseason import SEASON, WEEK, _UPCOMING_SQL, upcoming_sql
from fieldcast.plans.q_scoring import IN_HEURISTIC, PRE_CONFIDENCE, PRE_HEURISTIC, _vec_sql
from fieldcast.plans.registry import register, sql_round
from fieldcast.session import cut_lineage, staging_path
from fieldcast.sources import readers as R
from fieldcast.streaming.weekly import LOG_SCHEMA, incremental_weekly, weekly_run, weekly_run_batch

BOARD_SEASON, BOARD_VERSION = 2002, "F"
BATCH_TS = "2003-01-01 00:00:00"
PURGE_PREFIX = "00-000001"

PLAYER_COLS = ("player_id", "external_id", "name", "team", "position", "age", "draft_round", "draft_pick",
               "rookie_season", "height_inches", "weight_lbs")


def _ti(x):
    """Python/Spark int() of a double truncates; DuckDB's cast rounds."""
    return f"CAST(trunc({x}) AS INTEGER)"


def _stored_table(t, name: str, table, partition_by: str = "season") -> tuple[str, T.StructType]:
    """A copy of `table` in storage, by partitions: its path and schema."""
    path = staging_path(t.spark, name)
    table.write.partitionBy(partition_by).parquet(path)
    return path, table.schema


def _published_twice(t, name: str, base, change):
    """`base` as a published table, changed twice, read back."""
    path = staging_path(t.spark, name)
    W.publish(t.spark, path, base)
    schema = base.schema
    for _ in range(2):
        new = change(W.published(t.spark, path, schema))
        W.publish(t.spark, path, new)
        schema = new.schema
    return W.published(t.spark, path, schema)


# ------------------------------------------------------------------ W1
@register("w1_upsert_players", sql=f"""
WITH cw AS ({_CLEAN}), cr AS ({ROSTERS_CLEAN}),
ident AS (SELECT player_id, name, team, position FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, week DESC) AS rn FROM cw) x WHERE rn = 1),
ups AS (SELECT i.player_id AS external_id, i.name, i.team, i.position, {_ti('r.age')} AS age,
          {_ti('r.height_inches')} AS height_inches, {_ti('r.weight_lbs')} AS weight_lbs,
          {_ti('r.draft_round')} AS draft_round, {_ti('r.draft_pick')} AS draft_pick,
          {_ti('r.rookie_season')} AS rookie_season
        FROM ident i LEFT JOIN cr r ON r.player_id = i.player_id)
SELECT b.player_id, b.external_id,
  CASE WHEN u.external_id IS NOT NULL THEN u.name ELSE b.name END AS name,
  CASE WHEN u.external_id IS NOT NULL THEN u.team ELSE b.team END AS team,
  CASE WHEN u.external_id IS NOT NULL THEN u.position ELSE b.position END AS position,
  coalesce(u.age, b.age) AS age, coalesce(u.draft_round, b.draft_round) AS draft_round,
  coalesce(u.draft_pick, b.draft_pick) AS draft_pick, coalesce(u.rookie_season, b.rookie_season) AS rookie_season,
  u.height_inches, u.weight_lbs
FROM players b LEFT JOIN ups u ON u.external_id = b.external_id""")
def q_upsert_players(t):
    weekly = C.clean_weekly(t.dirty_weekly)
    return _published_twice(t, "players", t.players, lambda base: W.upsert_players(
        base, weekly, C.clean_rosters(t.rosters)).select(*PLAYER_COLS))


# ------------------------------------------------------------------ W2
STATS_COLS = "player_id, season, week, opponent, is_home, targets, carries, receptions, yards, touchdowns, fantasy_points"


@register("w2_upsert_stats", doubles=("yards", "fantasy_points"), sql=f"""
WITH cw AS ({_CLEAN}),
ups AS (SELECT p.player_id, c.season, c.week, c.opponent, c.is_home, c.targets, c.carries, c.receptions,
               c.yards, c.touchdowns, c.fantasy_points
        FROM cw c JOIN players p ON p.external_id = c.player_id)
SELECT {STATS_COLS} FROM ups
UNION ALL
SELECT {STATS_COLS} FROM player_stats b
WHERE NOT EXISTS (SELECT 1 FROM ups u WHERE u.player_id = b.player_id AND u.season = b.season AND u.week = b.week)""")
def q_upsert_stats(t):
    return W.upsert_stats(t.player_stats, C.clean_weekly(t.dirty_weekly), t.players)


# ------------------------------------------------------------------ W3
_LOG_COLS = "id, player_id, season, week, opponent, prediction, confidence, model_version, created_at"


@register("w3_append_predictions", doubles=("prediction", "confidence"), sql=f"""
WITH scored AS (SELECT player_id, team, {sql_round(sql_round(IN_HEURISTIC, 3), 2)} AS prediction FROM ({_UPCOMING_SQL}) u)
SELECT {_LOG_COLS} FROM predictions
UNION ALL
SELECT CAST((SELECT max(id) FROM predictions) + row_number() OVER (ORDER BY player_id) AS BIGINT), player_id,
  CAST({SEASON} AS INTEGER), CAST({WEEK} AS INTEGER), coalesce(team, 'UNK'), prediction, CAST(NULL AS DOUBLE),
  '{M.FALLBACK_VERSION}', CAST('{BATCH_TS}' AS TIMESTAMP)
FROM scored""")
def q_append_predictions(t):
    feats = ins.upcoming_features(t.players, t.player_stats, SEASON, WEEK)
    scored = M.batch_score_weekly(feats, SEASON, WEEK)
    path, schema = _stored_table(t, "prediction-log", t.predictions.withColumn("batch_id", F.lit(0).cast("long")), "batch_id")
    for _ in range(2):   # the second run is a replay: it takes the place of the first
        log = W.read_table(t.spark, path, schema).where("batch_id <> 1")
        new = W.assign_ids(scored, "player_id", log.select(F.max("id")).scalar(), out="id")
        W.append_once(t.spark, path, new.withColumn("created_at", F.to_timestamp(F.lit(BATCH_TS))), 1, schema)
    return W.read_table(t.spark, path, schema).select(*_LOG_COLS.split(", "))


# ------------------------------------------------------------------ W4
@register("w4_replace_season_projection", doubles=("prediction", "confidence"), sql=f"""
WITH ctx AS (SELECT * FROM ({CONTEXT_SQL}) c WHERE season = {BOARD_SEASON}
  AND player_id IN (SELECT player_id FROM players WHERE position IN ('WR', 'RB', 'TE'))),
vec AS ({_vec_sql('ctx')}),
board AS (SELECT player_id, {sql_round(sql_round(PRE_HEURISTIC, 3), 2)} AS prediction, {PRE_CONFIDENCE} AS confidence FROM vec),
mx AS (SELECT max(id) AS m FROM predictions)
SELECT {_LOG_COLS} FROM predictions
WHERE NOT (season = {BOARD_SEASON} AND week = 0 AND model_version = '{BOARD_VERSION}')
UNION ALL
SELECT CAST((SELECT m FROM mx) + row_number() OVER (ORDER BY player_id) AS BIGINT) AS id, player_id,
  CAST({BOARD_SEASON} AS INTEGER) AS season, CAST(0 AS INTEGER) AS week, coalesce(team, 'UNK') AS opponent, prediction,
  confidence, '{BOARD_VERSION}' AS model_version, CAST('{BATCH_TS}' AS TIMESTAMP) AS created_at
FROM board JOIN players USING (player_id)""")
def q_replace_projection(t):
    # Passing earns no points here, so quarterbacks are not projected.
    projected = t.players.where(F.col("position").isin(*S.FLEX_POSITIONS)).select("player_id")
    ctx = context_table(t).where(F.col("season") == BOARD_SEASON).join(projected, "player_id", "left_semi")
    scored = M.score_preseason(M.preseason_vector(ctx)).select("player_id", "prediction", "confidence") \
        .join(t.players.select("player_id", "team"), "player_id")
    start = t.predictions.select(F.max("id")).scalar()
    board = W.assign_ids(scored, "player_id", start, out="id").select(
        "id", "player_id", F.lit(BOARD_SEASON).cast("int").alias("season"), F.lit(0).cast("int").alias("week"),
        F.coalesce("team", F.lit("UNK")).alias("opponent"), "prediction", "confidence",
        F.lit(BOARD_VERSION).alias("model_version"), F.to_timestamp(F.lit(BATCH_TS)).alias("created_at"))
    path, schema = _stored_table(t, "season-board", t.predictions)
    match = {"season": BOARD_SEASON, "week": 0, "model_version": BOARD_VERSION}
    for _ in range(2):
        W.replace_in_table(t.spark, path, board, match, schema)
    return W.read_table(t.spark, path, schema).select(*_LOG_COLS.split(", "))


# ------------------------------------------------------------------ W5
_EMPTY_FEEDS = """snaps AS (SELECT CAST(NULL AS VARCHAR) AS external_id, CAST(NULL AS INTEGER) AS season,
                 CAST(NULL AS DOUBLE) AS prior_snap_share WHERE false),
depth AS (SELECT CAST(NULL AS VARCHAR) AS external_id, CAST(NULL AS INTEGER) AS season,
                 CAST(NULL AS INTEGER) AS depth_chart_rank WHERE false),
nobios AS (SELECT CAST(NULL AS VARCHAR) AS gsis_id, CAST(NULL AS INTEGER) AS draft_round,
                  CAST(NULL AS INTEGER) AS draft_pick, CAST(NULL AS INTEGER) AS rookie_season,
                  CAST(NULL AS INTEGER) AS years_of_experience WHERE false)"""
_FEEDLESS_SQL = CONTEXT_SQL.replace(FEEDS, _EMPTY_FEEDS).replace(
    "LEFT JOIN bios b ON b.gsis_id = e.external_id", "LEFT JOIN nobios b ON b.gsis_id = e.external_id")
_CTX_COLS = ", ".join(P.CONTEXT_COLUMNS)


def _policy_select() -> str:
    parts = []
    for c in P.CONTEXT_COLUMNS:
        if c in ("player_id", "season"):
            parts.append(f"coalesce(n.{c}, o.{c}) AS {c}")
        elif c in W.CONTEXT_COALESCE:
            parts.append(f"coalesce(n.{c}, o.{c}) AS {c}")
        else:
            parts.append(f"CASE WHEN n.player_id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}")
    return ",\n  ".join(parts)


@register("w5_upsert_context", doubles=CONTEXT_DOUBLES, sql=f"""
WITH o AS ({CONTEXT_SQL}), n AS ({_FEEDLESS_SQL})
SELECT {_policy_select()}
FROM o FULL OUTER JOIN n ON n.player_id = o.player_id AND n.season = o.season""")
def q_upsert_context(t):
    """A rebuild whose optional feeds failed: feed columns must survive."""
    feedless = cut_lineage(P.build_context(t.player_stats, t.players, _targets(t), volumes=_volumes(t), ps=_ps(t)))
    path, schema = _stored_table(t, "context", context_table(t).select(*P.CONTEXT_COLUMNS))
    policy = {c: W.COALESCE for c in W.CONTEXT_COALESCE}
    for _ in range(2):
        W.upsert_table(t.spark, path, feedless, ("player_id", "season"), "season", schema, policy)
    return W.read_table(t.spark, path, schema).select(*P.CONTEXT_COLUMNS)


# ------------------------------------------------------------------ W6
@register("w6_prune_stale", doubles=CONTEXT_DOUBLES, sql=f"""
WITH c AS ({CONTEXT_SQL}),
b AS (SELECT DISTINCT ps.player_id, ps.season + 1 AS season
      FROM player_stats ps JOIN players p ON p.player_id = ps.player_id WHERE ps.week <= 18)
SELECT {_CTX_COLS} FROM c
WHERE c.season NOT IN (SELECT season FROM b)
   OR EXISTS (SELECT 1 FROM b WHERE b.player_id = c.player_id AND b.season = c.season)""")
def q_prune_stale(t):
    """The build is the prior-production frame (players with a prior
    regular season); context rows of built seasons outside it are stale."""
    build = cut_lineage(P.prior_production(_ps(t), t.players, _targets(t)).select("player_id", "season"))
    path, schema = _stored_table(t, "context", context_table(t).select(*P.CONTEXT_COLUMNS))
    for _ in range(2):
        W.prune_table(t.spark, path, build, schema)
    return W.read_table(t.spark, path, schema).select(*P.CONTEXT_COLUMNS)


# ------------------------------------------------------------------ W7
@register("w7_register_rookies", sql=f"""
WITH base AS (SELECT * FROM players p WHERE EXISTS (SELECT 1 FROM player_stats s WHERE s.player_id = p.player_id)),
inc AS (
  SELECT b.gsis_id AS external_id, coalesce(b.display_name, b.gsis_id) AS name, b.latest_team AS team,
    substr(upper(coalesce(b.position, 'WR')), 1, 4) AS position,
    coalesce(CAST(b.draft_round AS INTEGER), d.round) AS draft_round,
    coalesce(CAST(b.draft_pick AS INTEGER), d.pick) AS draft_pick
  FROM bios b LEFT JOIN (SELECT gsis_id, round, pick FROM draft_picks WHERE season = {BOARD_SEASON}) d
    ON d.gsis_id = b.gsis_id
  WHERE b.rookie_season = {BOARD_SEASON} AND upper(b.position) IN ('WR', 'RB', 'TE', 'QB'))
SELECT b.player_id, b.external_id, b.name, coalesce(i.team, b.team) AS team,
  CASE WHEN i.external_id IS NOT NULL THEN i.position ELSE b.position END AS position, b.age,
  coalesce(i.draft_round, b.draft_round) AS draft_round, coalesce(i.draft_pick, b.draft_pick) AS draft_pick,
  CASE WHEN i.external_id IS NOT NULL THEN {BOARD_SEASON} ELSE b.rookie_season END AS rookie_season,
  CAST(NULL AS INTEGER) AS height_inches, CAST(NULL AS INTEGER) AS weight_lbs
FROM base b LEFT JOIN inc i ON i.external_id = b.external_id
UNION ALL
SELECT CAST((SELECT max(player_id) FROM base) + row_number() OVER (ORDER BY i.external_id) AS BIGINT),
  i.external_id, i.name, i.team, i.position, 22, i.draft_round, i.draft_pick, {BOARD_SEASON},
  CAST(NULL AS INTEGER), CAST(NULL AS INTEGER)
FROM inc i WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.external_id = i.external_id)""")
def q_register_rookies(t):
    base = t.players.join(t.player_stats.select("player_id").distinct(), "player_id", "left_semi")
    bios = R.read_bios(t.bios, full=True)
    picks = R.read_draft_picks(t.draft_picks, season=BOARD_SEASON)
    return _published_twice(t, "rookies", base, lambda known: W.register_rookies(
        known, bios, picks, BOARD_SEASON, S.INGEST_POSITIONS).select(*PLAYER_COLS)
        .withColumn("player_id", F.col("player_id").cast("long")))


# ------------------------------------------------------------------ W8 / W9
@register("w8_purge_prefix", sql=f"""
WITH doomed AS (SELECT player_id FROM players WHERE starts_with(external_id, '{PURGE_PREFIX}'))
SELECT 'players' AS table_name, count(*) AS row_count FROM players WHERE NOT starts_with(external_id, '{PURGE_PREFIX}')
UNION ALL SELECT 'player_stats', count(*) FROM player_stats WHERE player_id NOT IN (SELECT player_id FROM doomed)
UNION ALL SELECT 'predictions', count(*) FROM predictions WHERE player_id NOT IN (SELECT player_id FROM doomed)
UNION ALL SELECT 'player_context', count(*) FROM ({CONTEXT_SQL}) c
  WHERE player_id NOT IN (SELECT player_id FROM doomed)""")
def q_purge(t):
    out = W.purge_prefix(t.players, {"player_stats": t.player_stats, "predictions": t.predictions,
                                     "player_context": context_table(t)}, PURGE_PREFIX)
    frames = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in out.items()]
    res = frames[0]
    for f in frames[1:]:
        res = res.unionByName(f)
    return res


@register("w9_census", sql=f"""
SELECT count(*) FILTER (WHERE NOT starts_with(external_id, '{PURGE_PREFIX}')) AS real_players,
       count(*) FILTER (WHERE starts_with(external_id, '{PURGE_PREFIX}')) AS prefixed_players
FROM players""")
def q_census(t):
    return W.census(t.players, PURGE_PREFIX)


# ------------------------------------------------------------------ W10
@register("w10_incremental_weekly", doubles=("yards", "fantasy_points"), sql=f"""
WITH cw AS ({_CLEAN})
SELECT p.player_id, c.season, c.week, c.opponent, c.is_home, c.targets, c.carries, c.receptions,
       c.yards, c.touchdowns, c.fantasy_points
FROM cw c JOIN players p ON p.external_id = c.player_id""")
def q_incremental_weekly(t):
    """The dirty weekly feed lands in three files by a hash of the rows, so that
    duplicates of a key come in different batches; the stream merges them file
    by file into an empty stats table, which is returned."""
    root = staging_path(t.spark, "weekly-stream")
    src, stats, ckpt = (os.path.join(root, d) for d in ("landing", "player_stats", "checkpoint"))
    feed = t.dirty_weekly
    feed.repartition(3, *feed.columns).write.parquet(src)
    q = incremental_weekly(t.spark, src, feed.schema, t.players, stats, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    return t.spark.read.parquet(stats).select(
        "player_id", F.col("season").cast("int").alias("season"), "week", "opponent", "is_home", "targets",
        "carries", "receptions", "yards", "touchdowns", "fantasy_points")


# ------------------------------------------------------------------ the weekly job
#: Two deliveries: games until the first week, without some of the duplicates, and the rest until the second.
FIRST, SECOND = 200106, 200111
_LATE = "(week % 4 = 0 AND receptions % 2 = 1)"


def _delivered(n: int) -> str:
    """Clean games, roster and features as they are after delivery n."""
    last = FIRST if n == 1 else SECOND
    rows = f"season * 100 + week <= {last}" + (f" AND NOT {_LATE}" if n == 1 else "")
    return f"""feed{n} AS (SELECT * FROM dirty_weekly WHERE {rows}),
clean{n} AS ({_CLEAN.replace("FROM dirty_weekly", f"FROM feed{n}")}),
who{n} AS (SELECT player_id AS external_id, arg_max(name, season * 100 + week) AS name, arg_max(team, season * 100 + week) AS team,
  arg_max(position, season * 100 + week) AS position FROM clean{n} GROUP BY player_id)"""


def _log_sql(n: int) -> str:
    week = (FIRST if n == 1 else SECOND) % 100 + 1
    return f"""scored{n} AS (SELECT player_id, team, {sql_round(sql_round(IN_HEURISTIC, 3), 2)} AS prediction
  FROM ({upcoming_sql(f"stats{n}", f"roster{n}", SEASON, week)}) u),
log{n} AS (SELECT row_number() OVER (ORDER BY player_id) AS k, player_id, {week} AS week, team, prediction, {n - 1} AS batch_id FROM scored{n})"""


@register("w10_weekly_run", doubles=("prediction", "confidence"), sql=f"""
WITH {_delivered(1)},
{_delivered(2)},
ids AS (SELECT external_id, row_number() OVER (ORDER BY w.external_id IS NULL, external_id) AS player_id
  FROM who2 LEFT JOIN (SELECT external_id FROM who1) w USING (external_id)),
{", ".join(f"roster{n} AS (SELECT * FROM who{n} JOIN ids USING (external_id))" for n in (1, 2))},
{", ".join(f"stats{n} AS (SELECT c.* REPLACE (i.player_id AS player_id) FROM clean{n} c JOIN ids i ON i.external_id = c.player_id)" for n in (1, 2))},
{_log_sql(1)},
{_log_sql(2)}
SELECT CAST(k + (CASE WHEN batch_id = 1 THEN (SELECT count(*) FROM log1) ELSE 0 END) AS BIGINT) AS id, CAST(player_id AS BIGINT) AS player_id,
  {SEASON} AS season, week, coalesce(team, 'UNK') AS opponent, prediction, CAST(NULL AS DOUBLE) AS confidence,
  '{M.FALLBACK_VERSION}' AS model_version, CAST('{BATCH_TS}' AS TIMESTAMP) AS created_at, CAST(batch_id AS BIGINT) AS batch_id
FROM (SELECT * FROM log1 UNION ALL SELECT * FROM log2) x""")
def q_weekly_run(t):
    """Ingest, clean, upserts, features, score and append over two deliveries, the second of which is replayed:
    the log holds each batch once. Some duplicates of old weeks come late, thinner and fuller ones."""
    root = staging_path(t.spark, "weekly-run")
    src, ckpt = (os.path.join(root, d) for d in ("landing", "checkpoint"))
    at = F.col("season") * 100 + F.col("week")
    first = (at <= FIRST) & ~F.expr(_LATE)
    feed = t.dirty_weekly
    deliveries = feed.where(first), feed.where((at <= SECOND) & ~first)
    for n, rows in enumerate(deliveries):
        rows.write.parquet(os.path.join(src, f"d{n}"))
        weekly_run(t.spark, src + "/*", feed.schema, root, ckpt, max_files_per_trigger=1 << 20, created_at=BATCH_TS).awaitTermination()
    weekly_run_batch(t.spark, root, os.path.join(ckpt, "replay"), BATCH_TS)(
        t.spark.read.schema(feed.schema).parquet(os.path.join(src, "d1")), 1)
    return W.read_table(t.spark, f"{root}/predictions", LOG_SCHEMA)
