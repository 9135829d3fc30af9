"""C1-C10 on small in-line frames (properties of the reference's pipeline tests)."""

from pyspark.sql import Row

from fieldcast.operators import cleaning as C

RAW_COLS = ("player_id player_display_name position recent_team season week opponent_team targets carries "
            "receptions receiving_yards receiving_tds rushing_yards rushing_tds").split()


def _raw(spark, data):
    schema = ("player_id string, player_display_name string, position string, recent_team string, season int, "
              "week int, opponent_team string, targets int, carries int, receptions int, receiving_yards double, "
              "receiving_tds int, rushing_yards double, rushing_tds int")
    return spark.createDataFrame(data, schema)


def test_fuller_duplicate_wins_and_unjoinable_dropped(spark):
    raw = _raw(spark, [
        ("A", "Al", "WR", "KC", 2024, 1, "buf", 8, 0, 6, 70.0, 1, 0.0, 0),
        ("A", "Al", "WR", "KC", 2024, 1, "buf", 8, 0, 6, 90.0, 1, 0.0, 0),   # fuller duplicate
        ("B", "Bo", "RB", None, 2024, 1, "NE", 3, 10, 2, 12.0, 0, 40.0, 1),   # no team: dropped
        ("C", "Cy", "TE", "SF", 2024, 1, None, None, -2, 3, None, None, 5.0, 0),
    ])
    out = {r["player_id"]: r for r in C.clean_weekly(raw).collect()}
    assert set(out) == {"A", "C"}
    assert out["A"]["yards"] == 90.0
    assert out["C"]["targets"] == 0 and out["C"]["carries"] == 0      # null and negative -> 0
    assert out["C"]["opponent"] == "UNK"
    assert out["A"]["opponent"] == "BUF"


def test_fantasy_points_ppr(spark):
    raw = _raw(spark, [("A", "Al", "WR", "KC", 2024, 1, "BUF", 9, 0, 7, 84.0, 1, 0.0, 0)])
    r = C.clean_weekly(raw).first()
    assert r["fantasy_points"] == 21.4


def test_stable_output_schema(spark):
    raw = _raw(spark, [("A", "Al", "WR", "KC", 2024, 1, "BUF", 9, 3, 7, 84.0, 1, 0.0, 0)])
    out = C.clean_weekly(raw)
    assert out.columns == ["player_id", "name", "position", "team", "season", "week", "opponent", "is_home",
                           "targets", "carries", "receptions", "yards", "touchdowns", "fantasy_points"]
    assert out.first()["carries"] == 3


def test_missing_count_column_becomes_zero(spark):
    raw = _raw(spark, [("A", "Al", "WR", "KC", 2024, 1, "BUF", 9, 3, 7, 84.0, 1, 0.0, 0)]).drop("carries")
    assert C.clean_weekly(raw).first()["carries"] == 0


def test_last_roster_row_wins(spark):
    rosters = spark.createDataFrame([
        Row(player_id="A", player_name="Al", position="WR", team="KC", season=2023, age=24.0, height=70, weight=190),
        Row(player_id="A", player_name="Al", position="WR", team="NYJ", season=2024, age=25.0, height=70, weight=195),
        Row(player_id=None, player_name="X", position="WR", team="KC", season=2024, age=25.0, height=70, weight=195),
    ])
    out = C.clean_rosters(rosters).collect()
    assert len(out) == 1 and out[0]["team"] == "NYJ" and out[0]["weight_lbs"] == 195.0


def test_row_accounting(spark):
    raw = _raw(spark, [("A", "Al", "WR", None, 2024, 1, "BUF", 9, 3, 7, 84.0, 1, 0.0, 0),
                       ("B", "Bo", "WR", "KC", 2024, 1, "BUF", 9, 3, 7, 84.0, 1, 0.0, 0)])
    r = C.row_accounting("clean", raw, C.clean_weekly(raw)).first()
    assert (r["rows_in"], r["rows_out"], r["dropped"]) == (2, 1, 1)


def test_every_stage_is_counted_in_one_pass(spark, tables):
    raw, counts = tables.dirty_weekly, {}
    clean = C.clean_weekly(raw, counts).count()
    told = {r["stage"]: (r["rows_in"], r["rows_out"], r["dropped"]) for r in C.stage_counts(raw).collect()}
    seen = C.observed_counts(counts)
    assert told["clean_weekly"] == (seen["raw"], clean, seen["raw"] - clean) and seen["clean_weekly"] == clean
    assert told["drop_unjoinable"] == (seen["raw"], seen["drop_unjoinable"], seen["raw"] - seen["drop_unjoinable"])
    assert told["dedupe_fullest"][1] == seen["dedupe_fullest"] == clean
    # The pass goes over the two halves of the fixture's union once each.
    plan = C.stage_counts(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == raw._jdf.queryExecution().executedPlan().toString().count("Scan parquet")
    assert {r["rows_in"] for r in C.stage_counts(raw.limit(0)).collect()} == {0}
