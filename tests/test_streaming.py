"""The weekly stream upserts landed files; a re-run adds nothing."""

import os
import tempfile

from pyspark.sql import functions as F

from fieldcast.operators import cleaning as C
from fieldcast.streaming.weekly import incremental_weekly

FEED = ("player_id string, player_display_name string, position string, recent_team string, season int, week int, "
        "opponent_team string, targets int, carries int, receptions int, receiving_yards double, receiving_tds int, "
        "rushing_yards double, rushing_tds int")


def test_incremental_weekly_replay_safe(spark):
    root = tempfile.mkdtemp(prefix="fc-stream-")
    src, stats, ckpt = (os.path.join(root, d) for d in ("landing", "stats", "ckpt"))
    players = spark.createDataFrame([(1, "00-1"), (2, "00-2")], "player_id long, external_id string")
    wk1 = spark.createDataFrame([("00-1", "Al", "WR", "KC", 2024, 1, "NE", 8, 0, 6, 60.0, 1, 0.0, 0),
                                 ("00-1", "Al", "WR", "KC", 2024, 1, "NE", 8, 0, 5, 50.0, 1, 0.0, 0),
                                 ("00-9", "Xx", "WR", "KC", 2024, 1, "NE", 8, 0, 5, 50.0, 1, 0.0, 0)], FEED)
    wk2 = spark.createDataFrame([("00-2", "Bo", "RB", "NE", 2024, 2, None, 3, 12, 2, 20.0, 0, 55.0, 1)], FEED)
    wk1.coalesce(1).write.parquet(os.path.join(src, "w1"))
    incremental_weekly(spark, src + "/*", wk1.schema, players, stats, ckpt).awaitTermination()
    wk2.coalesce(1).write.parquet(os.path.join(src, "w2"))
    incremental_weekly(spark, src + "/*", wk1.schema, players, stats, ckpt).awaitTermination()
    got = spark.read.parquet(stats)
    want = C.clean_weekly(wk1.unionByName(wk2))
    assert got.count() == 2                          # unknown player dropped, duplicate collapsed
    assert got.where(F.col("player_id") == 1).first()["yards"] == 60.0
    assert got.where(F.col("player_id") == 2).first()["opponent"] == "UNK"
    assert want.count() == 3
    # the checkpoint remembers both files: a third run changes nothing
    incremental_weekly(spark, src + "/*", wk1.schema, players, stats, ckpt).awaitTermination()
    assert spark.read.parquet(stats).count() == 2


def _week(spark, *rows):
    return spark.createDataFrame([(p, "Al", "WR", team, s, w, "NE", 8, 0, rec, yards, 0, 0.0, 0) for p, team, s, w, rec, yards in rows], FEED)


def test_thinner_duplicate_in_a_later_file_loses(spark):
    root = tempfile.mkdtemp(prefix="fc-fullest-")
    src, stats, ckpt = (os.path.join(root, d) for d in ("landing", "stats", "ckpt"))
    players = spark.createDataFrame([(1, "00-1"), (2, "00-2")], "player_id long, external_id string")
    deliveries = [_week(spark, ("00-1", "KC", 2024, 1, 6, 60.0), ("00-2", "KC", 2024, 1, 1, 10.0)),
                  _week(spark, ("00-1", "KC", 2024, 1, 5, 50.0), ("00-2", "KC", 2024, 1, 9, 90.0)),   # thinner, fuller
                  _week(spark, ("00-1", "KC", 2024, 1, 9, None), ("00-1", "KC", 2023, 4, 2, 20.0))]
    for n, rows in enumerate(deliveries):
        rows.coalesce(1).write.parquet(os.path.join(src, f"w{n}"))
        incremental_weekly(spark, src + "/*", rows.schema, players, stats, ckpt).awaitTermination()
    got = {(r["player_id"], r["season"]): (r["yards"], r["receptions"]) for r in spark.read.parquet(stats).collect()}
    assert got == {(1, 2024): (60.0, 6), (2, 2024): (90.0, 9), (1, 2023): (20.0, 2)}
    whole = deliveries[0].unionByName(deliveries[1]).unionByName(deliveries[2])
    assert sorted((r["yards"], r["receptions"]) for r in C.clean_weekly(whole).collect()) == sorted(got.values())


def test_weekly_run_appends_each_batch_once(spark):
    from fieldcast.streaming.weekly import LOG_SCHEMA, PLAYER_SCHEMA, weekly_run, weekly_run_batch
    from fieldcast.operators import tables as W

    root = tempfile.mkdtemp(prefix="fc-run-")
    src, ckpt = os.path.join(root, "landing"), os.path.join(root, "ckpt")
    first = _week(spark, ("00-2", "KC", 2024, 1, 6, 60.0), ("00-1", "NE", 2024, 1, 1, 10.0), ("00-7", "NE", 2023, 9, 1, 10.0))
    second = _week(spark, ("00-2", "SF", 2024, 2, 5, 50.0), ("00-9", "KC", 2024, 2, 9, 90.0), ("00-1", "OLD", 2023, 8, 9, 90.0))
    body = weekly_run_batch(spark, root, os.path.join(ckpt, "again"))

    def log():
        return sorted((r["id"], r["player_id"], r["season"], r["week"], r["opponent"], r["batch_id"])
                      for r in W.read_table(spark, f"{root}/predictions", LOG_SCHEMA).collect())

    for n, rows in enumerate((first, second)):
        rows.write.parquet(os.path.join(src, f"d{n}"))
        weekly_run(spark, src + "/*", first.schema, root, ckpt, max_files_per_trigger=99).awaitTermination()
        once = log()
        body(rows, n)                                   # a replay of the batch
        assert [x[1:] for x in log()] == [x[1:] for x in once] and [x[0] for x in log()] == [x[0] for x in once]
    assert log() == [(1, 1, 2024, 2, "NE", 0), (2, 2, 2024, 2, "KC", 0),
                     (3, 1, 2024, 3, "NE", 1), (4, 2, 2024, 3, "SF", 1), (5, 4, 2024, 3, "KC", 1)]
    players = {r["external_id"]: (r["player_id"], r["team"], r["seen_season"]) for r in W.published(spark, f"{root}/players", PLAYER_SCHEMA).collect()}
    assert players == {"00-1": (1, "NE", 2024), "00-2": (2, "SF", 2024), "00-7": (3, "NE", 2023), "00-9": (4, "KC", 2024)}


def test_merged_rows_are_computed_once(spark, monkeypatch):
    from fieldcast.streaming import weekly as K

    plans, upsert = [], K.W.upsert_table

    def watched(s, path, updates, *args, **kwargs):
        plans.append(updates._jdf.queryExecution().optimizedPlan().toString())
        return upsert(s, path, updates, *args, **kwargs)

    monkeypatch.setattr(K.W, "upsert_table", watched)
    root = tempfile.mkdtemp(prefix="fc-once-")
    feed = spark.createDataFrame([("00-1", "Al", "WR", "KC", 2024, 1, "NE", 8, 0, 6, 60.0, 1, 0.0, 0)], FEED)
    K.weekly_run_batch(spark, root, os.path.join(root, "staging"), "2024-09-10 00:00:00")(feed, 0)
    assert "LeftSemi" not in plans[0]     # what is upserted is read, not merged again
    assert spark.read.parquet(f"{root}/player_stats").count() == spark.read.parquet(f"{root}/predictions").count() == 1
    assert not os.path.exists(os.path.join(root, "staging", "batch-0", "weekly"))
