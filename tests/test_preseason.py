"""Weights, career rescue, teammate shares, target seasons, next period."""

from pyspark.sql import functions as F

from fieldcast.functions.columns import age_multiplier, season_weight
from fieldcast.operators import preseason as P


def _one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_age_multiplier_peaks(spark):
    assert _one(spark, age_multiplier(F.lit(26.5))) == 1.0
    assert _one(spark, age_multiplier(F.lit(24.0))) < 1.0
    assert _one(spark, age_multiplier(F.lit(45.0))) == 0.55
    assert _one(spark, age_multiplier(F.lit(None).cast("double"))) == 1.0


def test_half_season_halves_weight_and_recency_order(spark):
    full = _one(spark, season_weight(F.lit(0), F.lit(17)))
    half = _one(spark, season_weight(F.lit(0), F.lit(8.5)))
    assert abs(half - full / 2) < 1e-12
    ws = [_one(spark, season_weight(F.lit(a), F.lit(17))) for a in range(5)]
    assert ws == sorted(ws, reverse=True) and ws[3] == ws[4] == 0.06


def test_career_rescue(spark):
    # (seasons_ago, games, ppg): a down year is pulled up by the career record.
    hist = [(0, 17, 11.9), (1, 17, 18.6), (2, 10, 20.4), (3, 17, 21.5), (4, 17, 19.5)]
    df = spark.createDataFrame([(1, 2025, a, g, p) for a, g, p in hist],
                               "player_id int, season int, seasons_ago int, games int, ppg double")
    df = df.withColumns({"weight": season_weight("seasons_ago", "games"), "age_factor": F.lit(1.0),
                         "targets_per_game": F.lit(5.0), "carries_per_game": F.lit(0.0),
                         "targets": F.lit(80), "points": F.col("ppg") * F.col("games")})
    r = P.career_aggregate(df).first()
    assert 15 < r["career_weighted_ppg"] < 18.6
    assert r["career_seasons"] == 5 and r["career_best_ppg"] == 21.5


def test_top_teammate_share_without_pairs(spark):
    df = spark.createDataFrame([(1, "A", 0.5), (2, "A", 0.3), (3, "A", 0.1), (4, "B", 0.2), (5, "C", 0.4),
                                (6, "C", 0.4)], "player_id int, team string, share double")
    out = {r["player_id"]: r["top"] for r in P.max_of_others(df, ["team"], "share", "top").collect()}
    assert out == {1: 0.3, 2: 0.5, 3: 0.5, 4: 0.0, 5: 0.4, 6: 0.4}


def test_build_all_seasons(spark):
    stats = spark.createDataFrame([(1, s, 1) for s in (2023, 2024, 2025)], "player_id int, season int, week int")
    assert P.target_season_list(stats) == [2024, 2025, 2026]


def test_next_week_clamps(spark):
    full = spark.createDataFrame([(1, 2024, w) for w in range(1, 23)], "player_id int, season int, week int")
    part = spark.createDataFrame([(1, 2024, w) for w in range(1, 8)], "player_id int, season int, week int")
    assert P.next_period(full).first()["next_week"] == 18
    r = P.next_period(part).first()
    assert r["next_week"] == 8 and r["next_season"] == 2025


def test_context_does_not_look_ahead(tables):
    """Adding season S rows must not change S's context, other than eligibility."""
    from fieldcast.plans.q_preseason import _targets
    stats = tables.player_stats
    last = stats.select(F.max("season")).first()[0]
    cols = ["player_id", "season", "prior_games", "prior_points_per_game", "career_weighted_ppg"]
    volumes = P.team_volumes(stats, tables.game_teams)
    full = P.build_context(stats, tables.players, [last], volumes=volumes).select(*cols)
    past = stats.where(F.col("season") < last)
    cut = P.build_context(past, tables.players, [last], volumes=P.team_volumes(past, tables.game_teams)).select(*cols)
    both = full.join(cut, ["player_id", "season"])
    assert both.count() > 0
    assert full.join(cut, cols, "left_anti").join(cut.select("player_id"), "player_id", "left_semi").count() == 0
    assert _targets(tables)[-1] == last + 1


GAMES = [  # player, season, week, team, targets, carries: 1 is traded from A to B in mid-season and back to A a year later
    (1, 2023, 1, "A", 10, 0), (1, 2023, 2, "A", 10, 0), (1, 2023, 3, "B", 5, 2), (2, 2023, 1, "A", 20, 0),
    (3, 2023, 1, "B", 5, 8), (3, 2023, 19, "B", 99, 99), (4, 2023, 1, None, 7, 7), (1, 2024, 1, "A", 4, 0), (5, 2023, 2, "A", 10, 5)]


def _trades(spark):
    rows = spark.createDataFrame(GAMES, "player_id int, season int, week int, team string, targets int, carries int")
    stats = rows.drop("team").withColumns({"yards": F.lit(1.0), "fantasy_points": F.lit(1.0)})
    now = {1: "B", 2: "A", 3: "B", 4: "A", 5: "C"}
    players = spark.createDataFrame([(i, f"x{i}", "WR", t, 25) for i, t in now.items()],
                                    "player_id int, external_id string, position string, team string, age int")
    return stats, rows.select("player_id", "season", "week", "team"), players


def test_team_stints(spark):
    _, teams, _ = _trades(spark)
    got = {(r["player_id"], r["stint"]): tuple(r)[2:] for r in P.team_stints(teams).collect()}
    assert got == {(1, 1): ("A", 2023, 1, 2023, 2, 2), (1, 2): ("B", 2023, 3, 2023, 3, 1), (1, 3): ("A", 2024, 1, 2024, 1, 1),
                   (2, 1): ("A", 2023, 1, 2023, 1, 1), (3, 1): ("B", 2023, 1, 2023, 19, 2), (5, 1): ("A", 2023, 2, 2023, 2, 1)}


def test_traded_player_counts_once_per_game(spark):
    stats, teams, players = _trades(spark)
    volumes = P.team_volumes(stats, teams.unionByName(teams))     # repeated rows are one game
    assert volumes.where("season = 2023").agg(F.sum("targets")).first()[0] == 67
    shares = P.roster_shares(P.player_seasons(stats), players, [2024], volumes=volumes)
    got = {(r["player_id"], r["prod_team"]): (r["target_share"], r["carry_share"], r["still_here"]) for r in shares.collect()}
    assert got == {(1, "A"): (0.4, 0.0, False), (1, "B"): (0.5, 0.2, True), (2, "A"): (0.4, 0.0, True),
                   (3, "B"): (0.5, 0.8, True), (4, None): (0.0, 0.0, False), (5, "A"): (0.2, 1.0, False)}
    gone = {r["team"]: tuple(r)[2:] for r in P.departed_share(shares).collect()}
    assert {k: tuple(round(x, 9) for x in v) for k, v in gone.items()} == {"A": (0.6, 1.0)}
    top = {r["player_id"]: r["teammate_top_target_share"] for r in P.top_teammate_share(shares).collect()}
    assert top == {1: 0.5, 2: 0.0, 3: 0.5}


def test_team_of_the_game_needs_its_table(spark):
    import pytest
    stats, _, players = _trades(spark)
    ps = P.player_seasons(stats)
    with pytest.raises(ValueError):
        P.roster_shares(ps, players, [2024])
    with pytest.raises(ValueError):
        P.roster_shares(ps, players, [2024], team_of_record="last")
    now = P.roster_shares(ps, players, [2024], team_of_record="current")
    assert now.where("still_here").count() == now.count() == 5 and P.departed_share(now).isEmpty()


def test_volumes_need_no_join_and_unknown_games_have_no_team(spark):
    stats = spark.createDataFrame([(1, 2000, 1, 5, 1), (1, 2000, 2, 3, 0), (1, 2000, 2, 2, 0), (None, 2000, 1, 4, 4), (2, None, 1, 1, 1)],
                                  "player_id long, season int, week int, targets int, carries int")
    teams = spark.createDataFrame([(1, 2000, 1, "A"), (1, 2000, 2, "B"), (None, 2000, 1, "C"), (2, None, 1, "C"), (3, 2000, 1, "D")],
                                  "player_id long, season int, week int, team string")
    volumes = P.team_volumes(stats, teams)
    assert {tuple(r) for r in volumes.collect()} == {
        (1, 2000, "A", 1, 5, 1), (1, 2000, "B", 2, 5, 0), (None, 2000, None, 1, 4, 4), (2, None, None, 1, 1, 1)}
    assert "Join" not in volumes._jdf.queryExecution().optimizedPlan().toString()


def test_max_of_others_keeps_ties_and_nulls_and_no_large_shuffle(spark):
    df = spark.createDataFrame([("A", 1, .5), ("A", 2, .5), ("A", 3, .2), ("B", 4, .1), ("C", 5, None), ("C", 6, .3), (None, 7, .9)],
                               "team string, id long, share double")
    out = P.max_of_others(df, ["team"], "share", "top")
    assert {r["id"]: r["top"] for r in out.collect()} == {1: .5, 2: .5, 3: .5, 4: 0.0, 5: 0.0, 6: 0.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "WindowGroupLimit" in plan


def test_context_sorts_few_frames_in_one_plan(spark, tables):
    """Each sort of a task holds memory of its own, and a frame that is read twice is computed twice unless it is stored."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as with large tables
    try:
        targets = P.target_season_list(tables.player_stats)
        volumes = P.team_volumes(tables.player_stats, tables.game_teams)
        built = P.build_context(tables.player_stats, tables.players, targets, volumes=volumes, ps=P.player_seasons(tables.player_stats))
        n = built._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert n <= 40, n          # it was 1107 when the frames were planned again for each reader
