"""Q1-Q17: replacement levels, value over replacement, skew-proof ranks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldcast.functions.ranking import latest_per_key, rank_desc
from fieldcast.operators import boards as B


def test_replacement_levels(spark):
    pool = [("WR", float(100 - i)) for i in range(40)] + [("TE", float(10 - i)) for i in range(5)] \
        + [("QB", 9.0), ("QB", 8.0)]
    df = spark.createDataFrame(pool, "position string, prediction double")
    lv = {r["position"]: r["replacement_level"] for r in B.replacement_levels(df).collect()}
    assert lv["WR"] == 65.0          # 36th best
    assert lv["TE"] == 6.0           # shallow pool (5 < 14, >= 3): last value
    assert lv["QB"] == 0.0           # fewer than 3
    assert "RB" not in lv            # no projections: no level


def test_value_over_replacement_null_vs_zero(spark):
    board = spark.createDataFrame([(1, "WR", 10.0), (2, "K", 5.0)], "player_id int, position string, prediction double")
    levels = spark.createDataFrame([("WR", 10.0, 36)], "position string, replacement_level double, starters int")
    out = {r["player_id"]: r["value_over_replacement"] for r in B.value_over_replacement(board, levels).collect()}
    assert out[1] == 0.0 and out[2] is None


def test_te_beats_wr_on_value(spark):
    pool = [("WR", 20.0 - i * 0.2) for i in range(40)] + [("TE", 16.0 - i * 0.6) for i in range(20)]
    df = spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(pool)],
                               "player_id int, position string, prediction double")
    vor = B.value_over_replacement(df, B.replacement_levels(df))
    top = vor.orderBy(F.col("value_over_replacement").desc()).first()
    assert top["position"] == "TE"


def test_rank_desc_equals_rank(spark):
    random.seed(7)
    data = [(random.choice("ABC"), float(random.randint(0, 50))) for _ in range(500)]
    df = spark.createDataFrame(data, "position string, prediction double").withColumn("id", F.monotonically_increasing_id())
    mine = rank_desc(df, ["position"], "prediction", out="r", buckets=8)
    ref = df.withColumn("r2", F.rank().over(Window.partitionBy("position").orderBy(F.col("prediction").desc())))
    j = mine.join(ref.select("id", "r2"), "id")
    assert j.where(F.col("r") != F.col("r2")).count() == 0 and j.count() == 500


def test_latest_per_key_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5, "2024-01-01", 1.0), (1, 6, "2024-01-01", 2.0), (2, 1, "2023-01-01", 3.0)],
                               "player_id int, id int, created_at string, prediction double")
    out = {r["player_id"]: r["prediction"] for r in latest_per_key(df, ["player_id"], ["created_at", "id"]).collect()}
    assert out == {1: 2.0, 2: 3.0}


def test_position_filter():
    assert B.position_filter("flex") == ("WR", "RB", "TE")
    assert B.position_filter("qb") == ("QB",)


def test_search_meets_every_condition(spark):
    rows = [(1, "Ann%", "KC", "WR"), (2, "Bob", "KC", "WR"), (3, "anna", "NE", "WR"), (4, None, "KC", "QB")]
    df = spark.createDataFrame(rows, "player_id int, name string, team string, position string")
    found = lambda **k: [(r["player_id"], r["total"]) for r in B.search_players(df, **k).collect()]
    assert found(position="wr", team="kc") == [(1, 2), (2, 2)]
    assert found(name="ANN") == [(1, 2), (3, 2)] and found(name="a_n") == [(1, 2), (3, 2)]
    assert found(limit=1, offset=1) == [(1, 4)] and found(team="zz") == []
