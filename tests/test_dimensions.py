"""Season-versioned dimensions: validity ranges, as-of joins, nothing from later seasons."""

import pytest
from pyspark.sql import functions as F

from fieldcast.operators import dimensions as D
from fieldcast.operators import preseason as P

TEAMS = "id string, season int, at int, team string"


def _versions(spark, rows):
    return D.versions(spark.createDataFrame(rows, TEAMS), ["id"], ["team"], order=["at"])


def test_unchanged_observations_are_one_version(spark):
    rows = [("a", 2000, 1, "KC"), ("a", 2000, 2, "NE"), ("a", 2001, 1, "NE"), ("a", 2003, 1, None), ("a", 2004, 1, None),
            ("a", 2005, 1, "NE"), (None, 2000, 1, "KC"), ("b", None, 1, "KC")]
    for some in (rows, rows[::-1], rows + rows):
        out = [tuple(r) for r in _versions(spark, some).orderBy("valid_from").collect()]
        assert out == [("a", 2000, 2003, "NE"), ("a", 2003, 2005, None), ("a", 2005, None, "NE")]
    assert _versions(spark, []).count() == 0


def test_as_of_matches_brute_force(spark):
    rows = [(f"p{(7 * i) % 5}", 1990 + (i * i) % 9, i, f"T{(3 * i) % 4}") for i in range(40)]
    asked = [(f"p{k}", s) for k in range(6) for s in range(1988, 2001)]
    out = D.as_of(spark.createDataFrame(asked, "id string, season int"), _versions(spark, rows), ["id"])
    got = {(r["id"], r["season"]): r["team"] for r in out.collect()}
    for key, season in asked:
        known = [(s, at, t) for i, s, at, t in rows if i == key and s <= season]
        assert got[key, season] == (max(known)[2] if known else None)
    assert out.count() == len(asked)


def test_as_of_refuses_columns_that_are_there(spark):
    frame = spark.createDataFrame([("a", 2000, "KC")], "id string, season int, team string")
    with pytest.raises(ValueError, match="team"):
        D.as_of(frame, _versions(spark, []), ["id"])


def test_a_later_chart_or_roster_changes_no_earlier_season(spark, tables):
    from fieldcast.plans.q_preseason import _targets
    from fieldcast.sources import readers as R
    targets, last = _targets(tables), tables.player_stats.agg(F.max("season")).first()[0]
    volumes = P.team_volumes(tables.player_stats, tables.game_teams)

    def context(depth, rosters):
        built = P.build_context(tables.player_stats, tables.players, targets, depth=R.depth_versions(depth), volumes=volumes,
                                rosters=D.roster_versions(rosters))
        rows = built.where(F.col("season") < last).select("player_id", "season", "team", "age", "depth_chart_rank").collect()
        return sorted(map(tuple, rows))

    later_charts = tables.depth_charts.unionByName(tables.depth_charts.select(
        "gsis_id", F.make_timestamp(F.lit(last), F.lit(8), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("dt"),
        F.lit(9).alias("pos_rank")))
    later_rosters = tables.season_rosters.where(F.col("season") < last).unionByName(
        tables.players.select("external_id", F.lit(last).alias("season"), F.lit("T9").alias("team"), "position", "age"))
    before = context(tables.depth_charts, tables.season_rosters)
    assert before and before == context(later_charts, later_rosters)


def test_eligible_players_have_the_team_and_age_of_the_season(spark):
    players = spark.createDataFrame([(1, "a", "NE", "WR", 30, 1, 1, 1999), (2, "b", "KC", "TE", 25, 1, 1, 2002)],
                                    "player_id int, external_id string, team string, position string, age int, "
                                    "draft_round int, draft_pick int, rookie_season int")
    seasons = spark.createDataFrame([(1, 2000), (1, 2001)], "player_id int, season int")
    rosters = spark.createDataFrame([("a", 2000, "KC", "WR", 22), ("a", 2002, "NE", "WR", 24)],
                                    "external_id string, season int, team string, position string, age int")
    out = P.eligible_players(seasons, players, [2000, 2001, 2002], D.roster_versions(rosters))
    got = sorted((r["external_id"], r["season"], r["team"], r["age"]) for r in out.collect())
    assert got == [("a", 2000, "KC", 22), ("a", 2001, "KC", 23), ("a", 2002, "NE", 24), ("b", 2002, "KC", 25)]
