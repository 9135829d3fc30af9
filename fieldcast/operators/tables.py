"""Table maintenance (W1-W9): policy upserts, slice replace, prune, purge.

Plain parquet has no MERGE, so an upsert is a full outer join of the base
with the updates on the key, resolving every column by a policy:

* ``overwrite`` - the update's value whenever the key is in the updates;
* ``coalesce``  - the update's value unless it is null (facts once known are
  never nulled out);
* ``keep``      - the base value when the key already exists (insert-only).

`upsert_table` applies this to a stored, partitioned table: only the
partitions the updates touch are read, merged, staged under the shared
checkpoint folder and swapped in with dynamic partition overwrite, so other
partitions are never rewritten and a table is never overwritten while it is
being read. Merging is idempotent (merge(merge(b, u), u) == merge(b, u)), so a
job that dies half way is repaired by running it again.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast import schemas as S
from fieldcast.functions.ranking import latest_per_key
from fieldcast.operators.cleaning import dedupe_fullest
from fieldcast.session import cut_lineage, staging_path

OVERWRITE, COALESCE, KEEP = "overwrite", "coalesce", "keep"

# Per-column conflict policies of the three upserts (column lists in schemas).
PLAYER_POLICY = {**{c: OVERWRITE for c in S.PLAYER_OVERWRITE_COLUMNS},
                 **{c: COALESCE for c in S.PLAYER_COALESCE_COLUMNS}}
CONTEXT_COALESCE = S.CONTEXT_COALESCE_COLUMNS
# Rookie registration leaves name, age and size of a known player alone.
ROOKIE_POLICY = {**{c: COALESCE for c in S.ROOKIE_COALESCE_COLUMNS},
                 **{c: OVERWRITE for c in S.ROOKIE_OVERWRITE_COLUMNS},
                 **{c: KEEP for c in ("name", "age", "height_inches", "weight_lbs")}}
ROOKIE_DEFAULT_AGE = S.ROOKIE_DEFAULT_AGE
ROOKIE_DEFAULT_POSITION = S.ROOKIE_DEFAULT_POSITION


# ------------------------------------------------------------------ core
def merge_upsert(base: DataFrame, updates: DataFrame, key: Sequence[str],
                 policy: Mapping[str, str] | None = None, default: str = OVERWRITE) -> DataFrame:
    """Upsert `updates` into `base` on `key` with a per-column policy.

    Columns only in the base are carried; columns only in the updates are
    added (null for base-only rows). Update values are cast to the base type.
    """
    key = list(key)
    policy = dict(policy or {})
    btypes = {f.name: f.dataType for f in base.schema.fields}
    bcols = [c for c in base.columns if c not in key]
    ucols = [c for c in updates.columns if c not in key]
    b = base.select(*key, *[F.col(c).alias(f"_b_{c}") for c in bcols], F.lit(True).alias("_in_b"))
    keyed = F.lit(True)
    for k in key:
        keyed = keyed & F.col(k).isNotNull()
    u = updates.where(keyed) \
        .select(*key, *[F.col(c).alias(f"_u_{c}") for c in ucols], F.lit(True).alias("_in_u"))
    j = b.join(u, key, "full")
    in_b, in_u = F.coalesce("_in_b", F.lit(False)), F.coalesce("_in_u", F.lit(False))

    def resolve(c: str) -> Column:
        if c not in ucols:
            return F.col(f"_b_{c}")
        uc = F.col(f"_u_{c}")
        if c not in bcols:
            return uc
        uc = uc.cast(btypes[c])
        bc = F.col(f"_b_{c}")
        rule = policy.get(c, default)
        if rule == OVERWRITE:
            return F.when(in_u, uc).otherwise(bc)
        if rule == COALESCE:
            return F.coalesce(uc, bc)
        if rule == KEEP:
            return F.when(in_b, bc).otherwise(uc)
        raise ValueError(f"unknown policy {rule!r} for column {c}")

    out = bcols + [c for c in ucols if c not in bcols]
    return j.select(*key, *[resolve(c).alias(c) for c in out])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty frame of `schema` when it does not exist yet."""
    fs, where = _file_system(spark, path)
    if fs.exists(where) and any(not s.getPath().getName().startswith((".", "_")) for s in fs.listStatus(where)):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _file_system(spark: SparkSession, path: str):
    """The store that holds `path`, whatever its URI, and the path there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def rewrite_partitions(spark: SparkSession, path: str, schema: T.StructType, partition_by: str,
                       touched: DataFrame, change: Callable[[DataFrame], DataFrame],
                       staging_root: str | None = None) -> None:
    """Replace the `touched` partitions (a frame of their values) of the table at `path` by ``change(old rows)``.

    The new rows are staged under the shared checkpoint folder before the table
    is written, so it is never overwritten while it is being read. Partitions
    that end up without rows are removed; all others stay as they are. Only
    partition values (seasons, batches) reach the driver. `change` must be
    idempotent: a job that dies half way is repaired by running it again.
    """
    values = {r[0] for r in touched.select(F.col(partition_by).cast(schema[partition_by].dataType)).distinct().collect()}
    slice_ = read_table(spark, path, schema).where(F.col(partition_by).isin([v for v in values if v is not None]))   # pruned
    staged = staging_path(spark, "rewrite") if staging_root is None else os.path.join(staging_root, "rewrite")
    change(slice_).select(*schema.fieldNames()).write.mode("overwrite").parquet(staged)
    new = spark.read.schema(schema).parquet(staged)
    left = {r[0] for r in new.select(partition_by).distinct().collect()}
    gone = values - left
    # a partition's rows meet in few tasks, and a large one's are split over several
    new.hint("rebalance", partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(partition_by).parquet(path)
    for value in gone:
        drop_files(spark, f"{path}/{partition_by}={value}")
    drop_files(spark, staged)


def stored_once(spark: SparkSession, rows: DataFrame, staging_root: str | None, name: str) -> tuple[DataFrame, str]:
    """`rows` written to a staging folder and read back, for steps that read them several times: the frame and its folder."""
    where = staging_path(spark, name) if staging_root is None else os.path.join(staging_root, name)
    rows.write.mode("overwrite").parquet(where)
    return spark.read.schema(rows.schema).parquet(where), where


def drop_files(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, key: Sequence[str],
                 partition_by: str, schema: T.StructType, policy: Mapping[str, str] | None = None,
                 staging_root: str | None = None) -> None:
    """Upsert into the parquet table at `path`, rewriting only touched partitions.

    Updates that repeat a key are refused: which of them wins would be left to chance.
    Updates are computed once and staged, since the check, the touched partitions and the merge all read them.
    """
    wanted = [F.col(c).cast(schema[c].dataType).alias(c) for c in updates.columns if c in schema.fieldNames()]
    updates, staged = stored_once(spark, updates.select(*wanted), staging_root, "updates")
    if not updates.groupBy(*key).count().where("count > 1").isEmpty():
        drop_files(spark, staged)
        raise ValueError(f"updates repeat a key of {list(key)}")
    rewrite_partitions(spark, path, schema, partition_by, updates,
                       lambda old: merge_upsert(old, updates, key, policy), staging_root)
    drop_files(spark, staged)


def merge_fullest(spark: SparkSession, path: str, rows: DataFrame, schema: T.StructType,
                  key: Sequence[str] = ("player_id", "season", "week"), partition_by: str = "season",
                  staging_root: str | None = None) -> None:
    """C4 across deliveries: of a stored record and late ones of its key the fullest stays.

    Whole records are compared by the same order as inside one feed
    (`dedupe_fullest`), so it does not matter in which file, or in which order,
    duplicates arrive, and a replay changes nothing.
    """
    rows = rows.select(*schema.fieldNames())
    rewrite_partitions(spark, path, schema, partition_by, rows,
                       lambda old: dedupe_fullest(old.unionByName(rows), key), staging_root)


def replace_in_table(spark: SparkSession, path: str, new: DataFrame, match: Mapping[str, object],
                     schema: T.StructType, partition_by: str = "season") -> None:
    """W4 in storage: rows that match go, `new` comes, in the partitions that either touches."""
    touched = new.select(partition_by)
    if partition_by in match:
        touched = touched.unionByName(spark.range(1).select(F.lit(match[partition_by]).alias(partition_by)))
    else:
        touched = touched.unionByName(read_table(spark, path, schema).select(partition_by))
    rewrite_partitions(spark, path, schema, partition_by, touched, lambda old: replace_slice(old, new, match))


def prune_table(spark: SparkSession, path: str, build: DataFrame, schema: T.StructType,
                key: Sequence[str] = ("player_id",), season_col: str = "season") -> None:
    """W6 in storage: stale rows of the seasons of `build` go, other seasons are not read."""
    rewrite_partitions(spark, path, schema, season_col, build, lambda old: prune_stale(old, build, key, season_col))


def append_once(spark: SparkSession, path: str, rows: DataFrame, batch_id: int, schema: T.StructType,
                batch_col: str = "batch_id") -> None:
    """Append `rows` as batch `batch_id` of the log at `path`; the same batch again takes its own place.

    The batch is a partition: a replay overwrites it and no other, so each batch
    is in the log exactly once however often its job ran.
    """
    new = rows.withColumn(batch_col, F.lit(batch_id).cast(schema[batch_col].dataType))
    rewrite_partitions(spark, path, schema, batch_col, spark.range(1).select(F.lit(batch_id).alias(batch_col)),
                       lambda old: new)


def publish(spark: SparkSession, path: str, table: DataFrame) -> None:
    """Write an unpartitioned table as the next version under `path`.

    Readers take the newest version that is complete (`published`), so a job that
    dies while writing leaves the one before in place; older ones than that go.
    """
    done = _versions(spark, path)
    table.write.mode("overwrite").parquet(f"{path}/v{max(done, default=0) + 1:09d}")
    for old in sorted(done)[:-1]:
        fs, where = _file_system(spark, f"{path}/v{old:09d}")
        fs.delete(where, True)


def published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest complete version of the table under `path`; empty if there is none."""
    done = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{max(done):09d}") if done else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(where)]
    return [int(name[1:]) for name in found
            if name.startswith("v") and fs.exists(_file_system(spark, f"{path}/{name}/_SUCCESS")[1])]


def replace_slice(base: DataFrame, new: DataFrame, match: Mapping[str, object]) -> DataFrame:
    """W4 shape: delete the rows matching `match` (column -> value), insert `new`."""
    cond = F.lit(True)
    for c, v in match.items():
        cond = cond & (F.col(c) == F.lit(v))
    kept = base.where(~F.coalesce(cond, F.lit(False)))
    return kept.unionByName(new.select(*base.columns))


def assign_ids(rows: DataFrame, order_col: str, start: Column | int, out: str = "id") -> DataFrame:
    """Dense ids start+1, start+2, ... in `order_col` order, without a
    single-task global window: rows are range-partitioned and stored with the
    number of their range, per-range counts (one row per range) give each range
    its offset, and ids are numbered inside each range. The number is data by
    then, so both branches below mean the same ranges however they are planned."""
    ranged = cut_lineage(rows.repartitionByRange(order_col).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0))).drop("_n")
    w = Window.partitionBy("_pid").orderBy(order_col)
    start_c = start if isinstance(start, Column) else F.lit(start)
    return ranged.join(F.broadcast(offsets), "_pid") \
        .withColumn(out, (start_c + F.col("_off") + F.row_number().over(w)).cast("long")) \
        .drop("_pid", "_off")


# ------------------------------------------------------------------ W1
def player_identities(weekly: DataFrame, rosters: DataFrame) -> DataFrame:
    """W1 updates: latest (season, week) identity per player from the clean
    weekly feed, left-joined to the cleaned roster meta; keyed by external_id."""
    ident = latest_per_key(weekly.select("player_id", "season", "week", "name", "team", "position"),
                           ["player_id"], ["season", "week"])
    meta_cols = [c for c in ("age", "height_inches", "weight_lbs", "draft_round", "draft_pick",
                             "rookie_season") if c in rosters.columns]
    meta = rosters.select("player_id", *[F.col(c).cast("int").alias(c) for c in meta_cols])
    return ident.join(meta, "player_id", "left") \
        .select(F.col("player_id").alias("external_id"), "name", "team", "position", *meta_cols)


def newer_identities(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (with season and week) that are not older than what `base` has seen of the player."""
    seen = base.select("external_id", F.struct("seen_season", "seen_week").alias("_seen"))
    late = F.struct(F.col("season").cast("int"), F.col("week").cast("int")) < F.col("_seen")
    return updates.join(seen, "external_id", "left").where(~F.coalesce(late, F.lit(False))).drop("_seen")


def upsert_players(base: DataFrame, weekly: DataFrame, rosters: DataFrame) -> DataFrame:
    """Merge identities into the players dimension (PLAYER_POLICY);
    new players get the next ids."""
    ups = player_identities(weekly, rosters)
    merged = merge_upsert(base, ups, ["external_id"], PLAYER_POLICY)
    return fill_ids(merged, base)


def fill_ids(merged: DataFrame, base: DataFrame) -> DataFrame:
    start = base.select(F.coalesce(F.max("player_id"), F.lit(0))).scalar()
    old = merged.where(F.col("player_id").isNotNull())
    new = assign_ids(merged.where(F.col("player_id").isNull()).drop("player_id"), "external_id", start,
                     out="player_id")
    return old.unionByName(new.select(*old.columns))


# ------------------------------------------------------------------ W2
def stats_updates(weekly: DataFrame, players: DataFrame) -> DataFrame:
    """W2 updates: clean weekly rows mapped to the surrogate id; rows of
    unknown players are dropped by the inner join."""
    ids = players.select(F.col("external_id").alias("_ext"), F.col("player_id").alias("_pid"))
    j = weekly.join(ids, weekly["player_id"] == ids["_ext"])
    return j.select(F.col("_pid").alias("player_id"), "season", "week", "opponent", "is_home", "targets",
                    "carries", "receptions", "yards", "touchdowns", "fantasy_points")


def upsert_stats(base: DataFrame, weekly: DataFrame, players: DataFrame) -> DataFrame:
    """Every measure overwritten on (player_id, season, week)."""
    return merge_upsert(base, stats_updates(weekly, players), ["player_id", "season", "week"])


# ------------------------------------------------------------------ W3 / W4
def append_predictions(base: DataFrame, scored: DataFrame, created_at: str) -> DataFrame:
    """The log with `scored` appended, stamped with `created_at`."""
    new = scored.withColumn("created_at", F.to_timestamp(F.lit(created_at)))
    return base.unionByName(new.select(*base.columns))


def replace_season_projection(base: DataFrame, board: DataFrame, season: int, version: str) -> DataFrame:
    """Delete (season, week 0, version) rows, insert the new board."""
    return replace_slice(base, board, {"season": season, "week": 0, "model_version": version})


# ------------------------------------------------------------------ W5 / W6
def upsert_context(base: DataFrame, new: DataFrame) -> DataFrame:
    """Context upsert on (player_id, season); six columns coalesce."""
    return merge_upsert(base, new, ["player_id", "season"], {c: COALESCE for c in CONTEXT_COALESCE})


def prune_stale(table: DataFrame, build: DataFrame, key: Sequence[str] = ("player_id",),
                season_col: str = "season") -> DataFrame:
    """For every season present in `build`, drop the table rows whose key
    the build no longer has; other seasons are untouched."""
    key = list(key)
    seasons = build.select(season_col).distinct().withColumn("_built", F.lit(True))
    keep = build.select(*key, season_col).distinct().withColumn("_kept", F.lit(True))
    t = table.join(F.broadcast(seasons), season_col, "left").join(keep, [*key, season_col], "left")
    return t.where(F.col("_built").isNull() | F.col("_kept").isNotNull()).drop("_built", "_kept")


# ------------------------------------------------------------------ W7
def incoming_rookies(bios: DataFrame, picks: DataFrame, season: int, positions: Sequence[str]) -> DataFrame:
    """W7 updates: bios of the `season` class at wanted positions, draft slot
    filled from the picks release where the bio lacks it."""
    b = bios.where(F.col("rookie_season").try_cast("int") == season)
    if "position" in b.columns:
        b = b.where(F.upper("position").isin([p.upper() for p in positions]))
    p = picks.select("external_id", F.col("draft_round").alias("_dr"), F.col("draft_pick").alias("_dp"))
    j = b.join(p, "external_id", "left")
    pos = F.col("position") if "position" in b.columns else F.lit(None)
    return j.select(
        "external_id",
        F.coalesce(F.col("name") if "name" in b.columns else F.lit(None), F.col("external_id")).alias("name"),
        (F.col("team") if "team" in b.columns else F.lit(None).cast("string")).alias("team"),
        F.substring(F.upper(F.coalesce(pos, F.lit(ROOKIE_DEFAULT_POSITION))), 1, 4).alias("position"),
        F.lit(ROOKIE_DEFAULT_AGE).alias("age"),
        F.lit(None).cast("int").alias("height_inches"), F.lit(None).cast("int").alias("weight_lbs"),
        F.coalesce(F.col("draft_round").try_cast("int"), "_dr").alias("draft_round"),
        F.coalesce(F.col("draft_pick").try_cast("int"), "_dp").alias("draft_pick"),
        F.lit(season).cast("int").alias("rookie_season"),
    )


def register_rookies(base: DataFrame, bios: DataFrame, picks: DataFrame, season: int,
                     positions: Sequence[str]) -> DataFrame:
    """Upsert the incoming class with ROOKIE_POLICY (new rows inserted
    with the defaults, existing rows keep name/age/size)."""
    merged = merge_upsert(base, incoming_rookies(bios, picks, season, positions), ["external_id"],
                          ROOKIE_POLICY)
    return fill_ids(merged, base)


# ------------------------------------------------------------------ W8 / W9
def purge_prefix(players: DataFrame, children: Mapping[str, DataFrame], prefix: str,
                 id_col: str = "player_id", ext_col: str = "external_id") -> dict[str, DataFrame]:
    """Drop players whose external id starts with `prefix` and every
    child row that references them (left_anti against the purged key set)."""
    gone = F.coalesce(F.col(ext_col).startswith(prefix), F.lit(False))   # no external id: not of the prefix
    doomed = players.where(gone).select(id_col)
    out = {"players": players.where(~gone)}
    for name, child in children.items():
        out[name] = child.join(doomed, id_col, "left_anti")
    return out


def census(players: DataFrame, prefix: str, ext_col: str = "external_id") -> DataFrame:
    """(real, prefixed) player counts in one aggregate."""
    pre = F.coalesce(F.col(ext_col).startswith(prefix), F.lit(False))
    return players.agg(F.count_if(~pre).alias("real_players"), F.count_if(pre).alias("prefixed_players"))
