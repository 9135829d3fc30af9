"""Policy upserts, idempotent partition-scoped table upsert, purge, census."""

import os
import tempfile

from pyspark.sql import functions as F

from fieldcast.operators import tables as W
from fieldcast.streaming.weekly import STATS_SCHEMA


def test_merge_policies(spark):
    base = spark.createDataFrame([("a", "Al", 25, 3), ("b", "Bo", 30, None)],
                                 "external_id string, name string, age int, draft_round int")
    ups = spark.createDataFrame([("a", "Alan", None, None), ("c", "Cy", 22, 1)],
                                "external_id string, name string, age int, draft_round int")
    out = {r["external_id"]: r for r in W.merge_upsert(base, ups, ["external_id"],
                                                       {"age": W.COALESCE, "draft_round": W.COALESCE}).collect()}
    assert out["a"]["name"] == "Alan" and out["a"]["age"] == 25 and out["a"]["draft_round"] == 3
    assert out["b"]["name"] == "Bo" and out["c"]["age"] == 22


def test_keep_policy_is_insert_only(spark):
    base = spark.createDataFrame([("a", 25.0)], "external_id string, age double")
    ups = spark.createDataFrame([("a", 22.0), ("n", 22.0)], "external_id string, age double")
    out = dict(W.merge_upsert(base, ups, ["external_id"], {"age": W.KEEP}).collect())
    assert out == {"a": 25.0, "n": 22.0}


def _stats_rows(spark, rows):
    return spark.createDataFrame(rows, STATS_SCHEMA)


def test_upsert_table_idempotent_and_scoped(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fc-test-"), "stats")
    r = lambda p, s, w, pts: (p, s, w, "NE", True, 1, 0, 1, 10.0, 0, pts)
    W.upsert_table(spark, path, _stats_rows(spark, [r(1, 2023, 1, 5.0), r(1, 2024, 1, 6.0)]),
                   ("player_id", "season", "week"), "season", STATS_SCHEMA)
    ups = _stats_rows(spark, [r(1, 2024, 1, 9.0), r(2, 2024, 2, 4.0)])
    for _ in range(2):   # a replayed batch changes nothing
        W.upsert_table(spark, path, ups, ("player_id", "season", "week"), "season", STATS_SCHEMA)
        got = sorted((x["player_id"], x["season"], x["week"], x["fantasy_points"])
                     for x in spark.read.parquet(path).collect())
        assert got == [(1, 2023, 1, 5.0), (1, 2024, 1, 9.0), (2, 2024, 2, 4.0)]


def test_replace_slice(spark):
    base = spark.createDataFrame([(1, 2025, 0, "v1", 1.0), (1, 2025, 0, "v2", 2.0), (1, 2025, 3, "v1", 3.0)],
                                 "player_id int, season int, week int, model_version string, prediction double")
    new = spark.createDataFrame([(1, 2025, 0, "v1", 7.0)], base.schema)
    out = sorted(r["prediction"] for r in W.replace_season_projection(base, new, 2025, "v1").collect())
    assert out == [2.0, 3.0, 7.0]


def test_prune_stale_only_built_seasons(spark):
    table = spark.createDataFrame([(1, 2024), (2, 2024), (1, 2025), (3, 2025)], "player_id int, season int")
    build = spark.createDataFrame([(1, 2025)], "player_id int, season int")
    assert sorted(tuple(r) for r in W.prune_stale(table, build).collect()) == [(1, 2024), (1, 2025), (2, 2024)]


def test_purge_and_census(spark):
    players = spark.createDataFrame([(1, "00-001"), (2, "DEMO-1"), (3, "DEMO-2")], "player_id int, external_id string")
    child = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (3, 4.0)], "player_id int, x double")
    c = W.census(players, "DEMO-").first()
    assert (c["real_players"], c["prefixed_players"]) == (1, 2)
    out = W.purge_prefix(players, {"stats": child}, "DEMO-")
    assert [r["player_id"] for r in out["players"].collect()] == [1]
    assert [r["player_id"] for r in out["stats"].collect()] == [1]


def test_assign_ids_dense(spark):
    df = spark.range(0, 1000).select(F.format_string("k%04d", F.col("id")).alias("k")).repartition(7)
    out = W.assign_ids(df, "k", 100, out="id")
    ids = sorted(r["id"] for r in out.collect())
    assert ids == list(range(101, 1101))
    first = out.where(F.col("k") == "k0000").first()["id"]
    assert first == 101


def test_register_rookies_defaults(spark):
    base = spark.createDataFrame([(5, "00-1", "Vet", "KC", "WR", 28, 2, 50, 2020)],
                                 "player_id long, external_id string, name string, team string, position string, "
                                 "age int, draft_round int, draft_pick int, rookie_season int")
    bios = spark.createDataFrame([("00-9", "Rook", "rb", "NE", None, None, 2025), ("00-8", "Old", "WR", "NE", 1, 9, 2019)],
                                 "external_id string, name string, position string, team string, draft_round int, "
                                 "draft_pick int, rookie_season int")
    picks = spark.createDataFrame([("00-9", 1, 6)], "external_id string, draft_round int, draft_pick int")
    out = {r["external_id"]: r for r in W.register_rookies(base, bios, picks, 2025, ["WR", "RB"]).collect()}
    assert set(out) == {"00-1", "00-9"}
    r = out["00-9"]
    assert (r["player_id"], r["position"], r["age"], r["draft_pick"], r["rookie_season"]) == (6, "RB", 22, 6, 2025)


def test_assign_ids_wide_rows(spark):
    df = spark.range(200_000, numPartitions=7).selectExpr("id as k", "repeat(cast(id as string), 20) as a",
                                                          "repeat(cast(id * 7 as string), 20) as b")
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            out = W.assign_ids(df, "k", 0).selectExpr("count(*) n", "count(distinct id) d", "min(id) lo", "max(id) hi").first()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert tuple(out) == (200_000, 200_000, 1, 200_000)


def test_upsert_table_by_uri_and_repeated_keys(spark):
    import pytest

    path = "file:" + os.path.join(tempfile.mkdtemp(prefix="fc-test-"), "stats")
    r = lambda p, s, w, pts: (p, s, w, "NE", True, 1, 0, 1, 10.0, 0, pts)
    key = ("player_id", "season", "week")
    W.upsert_table(spark, path, _stats_rows(spark, [r(1, 2024, 1, 5.0), r(2, 2024, 1, 6.0)]), key, "season", STATS_SCHEMA)
    W.upsert_table(spark, path, _stats_rows(spark, [r(3, 2024, 1, 7.0)]), key, "season", STATS_SCHEMA)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        W.upsert_table(spark, path, _stats_rows(spark, [r(4, 2024, 1, 7.0), r(4, 2024, 1, 8.0)]), key, "season", STATS_SCHEMA)


def test_null_external_ids_are_kept(spark):
    players = spark.createDataFrame([(1, "DEMO-1"), (2, None), (3, "00-3")], "player_id int, external_id string")
    out = W.purge_prefix(players, {}, "DEMO-")["players"]
    assert sorted(x["player_id"] for x in out.collect()) == [2, 3]
    assert tuple(W.census(players, "DEMO-").first()) == (2, 1)


def test_rank_keeps_nulls_and_ties(spark):
    from fieldcast.functions.ranking import rank_desc

    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("a", 1.0), ("a", None), (None, 5.0)], "p string, v double")
    got = rank_desc(df, ["p"], "v")
    assert sorted((x["p"] or "", x["v"] or 0, x["rank"]) for x in got.collect()) == [
        ("", 5.0, 1), ("a", 0, 4), ("a", 1.0, 3), ("a", 2.0, 1), ("a", 2.0, 1)]


def test_every_line_reaches_the_fact(spark, tables):
    lines = tables.table("lineitem").join(tables.players, F.col("l_suppkey") == F.col("player_id")).count()
    assert tables.player_stats.agg(F.sum("targets")).first()[0] == lines


LOG = "player_id int, season int, week int, model_version string, prediction double"


def test_stored_replace_prune_and_empty_partitions(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fc-stored-"), "log")
    base = spark.createDataFrame([(1, 2025, 0, "v1", 1.0), (1, 2025, 0, "v2", 2.0), (1, 2024, 0, "v1", 3.0)], LOG)
    base.write.partitionBy("season").parquet(path)
    new = spark.createDataFrame([(2, 2025, 0, "v1", 7.0)], LOG)
    stored = lambda: sorted(r["prediction"] for r in W.read_table(spark, path, base.schema).collect())
    for _ in range(2):
        W.replace_in_table(spark, path, new, {"season": 2025, "week": 0, "model_version": "v1"}, base.schema)
        assert stored() == [2.0, 3.0, 7.0]
    W.replace_in_table(spark, path, new.limit(0), {"season": 2024, "week": 0, "model_version": "v1"}, base.schema)
    assert stored() == [2.0, 7.0] and not os.path.exists(f"{path}/season=2024")     # nothing is left of the season
    W.replace_in_table(spark, path, new.limit(0), {"model_version": "v2"}, base.schema)
    assert stored() == [7.0]
    W.prune_table(spark, path, spark.createDataFrame([(9, 2025)], "player_id int, season int"), base.schema)
    assert stored() == []


def test_append_once(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fc-once-"), "log")
    rows = spark.createDataFrame([(1, 2025, 1, "v", 1.0)], LOG)
    schema = rows.withColumn("batch_id", F.lit(0).cast("long")).schema
    for batch in (0, 1, 1, 0):
        W.append_once(spark, path, rows, batch, schema)
    assert sorted(r["batch_id"] for r in W.read_table(spark, path, schema).collect()) == [0, 1]
    W.append_once(spark, path, rows.limit(0), 1, schema)       # a replay that has nothing now
    assert [r["batch_id"] for r in W.read_table(spark, path, schema).collect()] == [0]


def test_published_versions_survive_a_broken_write(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fc-pub-"), "dim")
    one = spark.createDataFrame([(1,)], "x int")
    assert W.published(spark, path, one.schema).count() == 0
    for n in range(4):
        W.publish(spark, path, one.withColumn("x", F.lit(n)))
    os.makedirs(f"{path}/v000000005")                          # began, never ended
    assert [r["x"] for r in W.published(spark, path, one.schema).collect()] == [3]
    W.publish(spark, path, W.published(spark, path, one.schema).withColumn("x", F.col("x") + 7))
    assert [r["x"] for r in W.published(spark, path, one.schema).collect()] == [10]


def test_rosters_with_ties_are_decided(spark):
    from fieldcast.operators.cleaning import clean_rosters
    rows = [("a", 2024, "KC", 30.0), ("a", 2024, "NE", 31.0), ("a", 2023, "ZZ", 29.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "player_id string, season int, team string, age double").repartition(2)
        assert [(r["team"], r["age"]) for r in clean_rosters(df).collect()] == [("NE", 31.0)]


def test_updates_are_computed_once_and_slices_need_no_join(spark):
    path = tempfile.mkdtemp(prefix="fc-once-") + "/t"
    base = spark.createDataFrame([(1, 2000, 1), (2, 2001, 2)], "player_id long, season int, x int")
    base.write.partitionBy("season").parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def passing(v):
        seen.add(1)
        return v

    updates = spark.createDataFrame([(1, 2000, 5), (3, 2000, 6)], "player_id long, season int, x int") \
        .withColumn("player_id", F.udf(passing, "long")("player_id"))
    W.upsert_table(spark, path, updates, ("player_id", "season"), "season", base.schema)
    assert sorted(map(tuple, W.read_table(spark, path, base.schema).select(*base.columns).collect())) == [(1, 2000, 5), (2, 2001, 2), (3, 2000, 6)]
    assert seen.value == 2
    plans = []
    W.rewrite_partitions(spark, path, base.schema, "season", spark.createDataFrame([(2000,), (None,)], "season int"),
                         lambda old: plans.append(old._jdf.queryExecution().optimizedPlan().toString()) or old)
    assert "Join" not in plans[0]
    assert W.read_table(spark, path, base.schema).count() == 3
