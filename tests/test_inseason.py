"""Point-in-time features see only earlier games; windows are leak-free."""

import pytest
from pyspark.sql import functions as F

from fieldcast.operators import inseason as ins
from fieldcast.operators import scoring as M

STATS = ("player_id int, season int, week int, opponent string, is_home boolean, targets int, carries int, "
         "receptions int, yards double, touchdowns int, fantasy_points double")


def _stats(spark):
    rows = [(1, 2024, w, "NE", True, 8, 0, 6, 60.0 + w, 0, 10.0 * w) for w in range(1, 5)]
    rows += [(2, 2024, w, "KC", False, 4, 5, 2, 30.0, 1, 12.0) for w in range(1, 5)]
    return spark.createDataFrame(rows, STATS)


def test_week3_sees_only_weeks_1_and_2(spark):
    req = spark.createDataFrame([(1, 2024, 3, "NE", True)], "player_id int, season int, week int, opponent string, "
                                "is_home boolean")
    r = ins.point_in_time_features(req, _stats(spark)).first()
    assert r["games_played"] == 2
    assert r["fantasy_points_last_3"] == 15.0 and r["fantasy_points_last_1"] == 20.0


def test_full_window_and_cold_start(spark):
    req = spark.createDataFrame([(1, 2024, 5, "NE", True), (3, 2024, 1, "NE", False)],
                                "player_id int, season int, week int, opponent string, is_home boolean")
    out = {r["player_id"]: r for r in ins.point_in_time_features(req, _stats(spark)).collect()}
    assert out[1]["fantasy_points_last_3"] == 30.0 and out[1]["games_played"] == 4
    cold = out[3]
    assert cold["games_played"] == 0 and cold["fantasy_points_last_3"] == 0.0 and cold["season_avg_points"] == 0.0


def test_training_windows_exclude_current_week(spark):
    players = spark.createDataFrame([(1, "WR"), (2, "RB")], "player_id int, position string")
    w = ins.training_windows(_stats(spark), players).where((F.col("player_id") == 1) & (F.col("week") == 4)).first()
    assert w["fantasy_points_last_3"] == 20.0 and w["fantasy_points_last_1"] == 30.0 and w["games_played"] == 3
    assert w["target"] == 40.0


def test_repeated_requests_keep_their_rows(spark):
    req = spark.createDataFrame([(1, 2024, 5, "NE", True), (1, 2024, 5, "KC", False), (1, 2024, 5, "NE", True),
                                 (1, 2024, 3, None, True)],
                                "player_id int, season int, week int, opponent string, is_home boolean")
    out = ins.point_in_time_features(req, _stats(spark)).collect()
    week5 = [r for r in out if r["week"] == 5]
    assert len(out) == 4 and len(week5) == 3
    assert {(r["games_played"], r["fantasy_points_last_3"], r["season_avg_points"]) for r in week5} == {(4, 30.0, 25.0)}
    assert sorted((r["opponent_rank"], r["is_home"]) for r in week5) == [(1, 1), (1, 1), (2, 0)]
    early = next(r for r in out if r["week"] == 3)
    assert early["games_played"] == 2 and early["opponent_rank"] == 16
    assert ins.opponent_rank_lookup(req, _stats(spark)).count() == 4


def test_asked_week_without_a_game(spark):
    stats = _stats(spark).where("week <> 3")
    req = spark.createDataFrame([(1, 2024, w, "NE", True) for w in (1, 3, 4, 9)],
                                "player_id int, season int, week int, opponent string, is_home boolean")
    out = {r["week"]: r for r in ins.point_in_time_features(req, stats).collect()}
    assert [out[w]["games_played"] for w in (1, 3, 4, 9)] == [0, 2, 2, 3]
    assert [out[w]["fantasy_points_last_1"] for w in (1, 3, 4, 9)] == [0.0, 20.0, 20.0, 40.0]
    assert out[9]["fantasy_points_last_3"] == 23.333


def test_schedule_gives_opponent_and_home(spark):
    players = spark.createDataFrame([(1, "A", "WR", "NE"), (2, "B", "RB", "KC"), (3, "C", "WR", "GB")],
                                    "player_id int, name string, position string, team string")
    stats = _stats(spark).unionByName(spark.createDataFrame(
        [(3, 2024, 1, "KC", True, 1, 0, 1, 5.0, 0, 1.0)], STATS))
    games = spark.createDataFrame([(2024, 5, "KC", "NE"), (2024, 4, "GB", "NE")], "season int, week int, home_team string, away_team string")
    out = ins.upcoming_features(players, stats, 2024, 5, opponent_source="schedule", schedule=games)
    got = {r["player_id"]: (r["opponent"], r["is_home"], r["opponent_rank"]) for r in out.collect()}
    assert got == {1: ("KC", 0, 2), 2: ("NE", 1, 1)}      # GB has no game that week
    told = M.batch_score_weekly(out, 2024, 5)
    assert {r["player_id"]: r["opponent"] for r in told.collect()} == {1: "KC", 2: "NE"}
    for wrong in ({"opponent_source": "schedule"}, {"schedule": games}, {"opponent_source": "neither"}):
        with pytest.raises(ValueError):
            ins.upcoming_features(players, stats, 2024, 5, **wrong)


def test_rank_to_date_matches_brute_force(spark):
    rows = [(2020 + i % 2, 1 + (5 * i) % 7, f"T{(i * i) % 4}", float((37 * i) % 23)) for i in range(60)]
    frame = spark.createDataFrame(rows, "season int, week int, opponent string, target double")
    seen = {(r["season"], r["week"], r["opponent"]): r["opponent_rank"]
            for r in ins.season_defence_rank(frame, to_date=True).collect()}
    for season, week, opponent, _ in rows:
        past = {}
        for s, w, o, v in rows:
            if s == season and w < week:
                past.setdefault(o, []).append(v)
        order = sorted(past, key=lambda o: (-round(sum(past[o]) / len(past[o]), 9), o))
        assert seen[season, week, opponent] == (order.index(opponent) + 1 if opponent in past else 16)
