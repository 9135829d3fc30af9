"""Alias reconciliation, schema checks, derived age, optional feeds."""

import pytest
from pyspark.sql import types as T

from fieldcast import schemas as S
from fieldcast.sources import readers as R


def test_aliases_map_new_names(spark):
    df = spark.createDataFrame([("00-1", "Al", "KC", 5, 61.0)], "gsis_id string, player_name string, team string, "
                               "rec int, rec_yds double")
    out = R.apply_aliases(df, S.WEEKLY_ALIASES)
    assert {"player_id", "receptions", "receiving_yards"} <= set(out.columns)


def test_canonical_column_wins(spark):
    df = spark.createDataFrame([("A", "B")], "player_id string, gsis_id string")
    out = R.apply_aliases(df, {"player_id": ["gsis_id"]})
    assert out.first()["player_id"] == "A" and "gsis_id" in out.columns


def test_schema_mismatch_names_columns(spark):
    df = spark.createDataFrame([(1,)], "season int")
    with pytest.raises(R.SchemaMismatch) as e:
        R.require_columns(df, ["season", "week"])
    assert "week" in str(e.value) and "season" in str(e.value)


def test_derive_age(spark):
    df = spark.createDataFrame([(2024, "1999-07-01"), (2024, "1994-12-15"), (2024, "garbage")],
                               "season int, birth_date string")
    ages = [r["age"] for r in R.derive_age(df).collect()]
    assert ages[0] == 25.2 and ages[1] == 29.7 and ages[2] is None


def test_derive_age_noop_cases(spark):
    df = spark.createDataFrame([(2024, 30.0)], "season int, age double")
    assert R.derive_age(df).first()["age"] == 30.0
    df2 = spark.createDataFrame([(2024,)], "season int")
    assert "age" not in R.derive_age(df2).columns


def test_draft_picks_wrong_shape_is_empty(spark):
    df = spark.createDataFrame([("x",)], "name string")
    assert R.read_draft_picks(df).count() == 0


def test_project_known_reports_absent(spark):
    df = spark.createDataFrame([(1, 2)], "season int, week int")
    out, absent = R.project_known(df, ["season", "week", "targets"])
    assert out.columns == ["season", "week"] and absent == ["targets"]


def test_first_present_alias_is_taken(spark):
    df = spark.createDataFrame([("x", "y", 1)], "full_name string, player_name string, extra int")
    out = R.apply_aliases(df, {"name": ["player_name", "full_name"], "absent": ["nowhere"]})
    assert out.columns == ["full_name", "name", "extra"] and out.first()["name"] == "y"


def test_bios_one_row_per_id_whatever_the_order(spark):
    rows = [("00-1", None, "Al", "KC"), ("00-1", 2, "Bo", "NE"), ("00-1", 2, "Al", "NE"), (None, 1, "No", "KC"),
            (None, 3, "No", "KC")]
    schema = "gsis_id string, draft_round int, full_name string, team_abbr string"
    for some in (rows, rows[::-1]):
        out = R.read_bios(spark.createDataFrame(some, schema), full=True)
        assert [tuple(r) for r in out.collect()] == [("00-1", 2, "Al", "NE")]
        assert out.columns == ["external_id", "draft_round", "name", "team"]


def test_bios_without_ids_are_empty(spark):
    assert R.read_bios(spark.createDataFrame([("x",)], "name string")).count() == 0


def test_optional_feed_degrades_only_when_absent(spark, tmp_path):
    schema = T.StructType([T.StructField("external_id", T.StringType()), T.StructField("r", T.IntegerType())])

    def absent():
        return spark.read.parquet(str(tmp_path / "nowhere"))

    def denied():
        raise PermissionError("no access")

    assert R.optional_feed(absent, schema, spark).count() == 0
    assert R.optional_feed(lambda: spark.createDataFrame([(1,)], "other int"), schema, spark).schema == schema
    assert R.optional_feed(lambda: spark.createDataFrame([("a", 2)], schema), schema, spark).first()["r"] == 2
    with pytest.raises(PermissionError):
        R.optional_feed(denied, schema, spark)


def test_incomplete_seasons_are_named(spark):
    seasons = spark.createDataFrame([(2001,), (2002,), (2003,)], "season int")
    status = R.source_status(seasons, seasons.where("season <> 2002"))
    with pytest.raises(R.MissingSeasonData, match="2002"):
        R.assert_complete(status)
    R.assert_complete(R.source_status(seasons, seasons))


def _season_file(spark, folder, kind, season, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{kind}_{season}.parquet")


def test_the_first_complete_folder_is_read(spark, tmp_path):
    weekly = "gsis_id string, season int, week int, position string, rec int"
    for folder, seasons in (("here", (2001,)), ("there", (2001, 2002))):
        for s in seasons:
            _season_file(spark, tmp_path / folder, "player_stats", s, [(folder, s, 1, "WR", 3)], weekly)
            _season_file(spark, tmp_path / folder, "roster", s, [(folder, s)], "gsis_id string, season int")
    folders = {n: str(tmp_path / n) for n in ("nowhere", "here", "there")}
    found = {(r["kind"], r["season"]) for r in R.season_files(spark, folders["there"]).collect()}
    assert found == {(k, s) for k in R.FILE_KINDS for s in (2001, 2002)}
    assert R.season_files(spark, folders["nowhere"]).count() == 0
    games, rosters, name = R.load_source(spark, folders, [2001, 2002])
    assert name == "there" and {r["player_id"] for r in games.collect()} == {"there"} and rosters.count() == 2
    assert R.load_source(spark, folders, [2001])[2] == "here"
    status = R.file_status(spark, folders["here"], [2001, 2002])
    assert {r["season"] for r in status.where("not present").collect()} == {2002} and status.count() == 4
    with pytest.raises(R.MissingSeasonData, match="there lacks 2 file.*player_stats_2003.parquet, roster_2003.parquet"):
        R.load_source(spark, folders, [2002, 2003])


def test_depth_ranks_of_a_season(spark):
    old = spark.createDataFrame([("a", 2001, 3, "2"), ("a", 2001, 1, None), ("a", 2001, 2, "14"), ("a", 2002, 1, "1"),
                                 ("b", 2001, 1, "x")], "gsis_id string, season int, week int, depth_team string")
    assert [tuple(r) for r in R.depth_rank(old, season=2001).collect()] == [("a", 10)]
    new = spark.createDataFrame([("a", "2001-08-31", 2), ("a", "2001-09-01", 3), ("a", "2002-05-01", None)],
                                "gsis_id string, dt string, pos_rank int")
    assert R.depth_rank(new, season=2001).first()["depth_chart_rank"] == 2
    assert R.depth_rank(new, season=2002).first()["depth_chart_rank"] == 3
    assert [tuple(r) for r in R.depth_versions(new).orderBy("valid_from").collect()] == [("a", 2001, 2002, 2), ("a", 2002, None, 3)]
    assert R.depth_versions(spark.createDataFrame([("a", 1)], "gsis_id string, other int")).count() == 0


def test_read_seasons_reconciles_files(spark, tmp_path):
    spark.createDataFrame([("a", 3)], "gsis_id string, rec int").write.parquet(str(tmp_path / "2001"))
    spark.createDataFrame([("b", 4, 9.0)], "player_id string, receptions int, yards double") \
        .write.parquet(str(tmp_path / "2002"))
    paths = {y: str(tmp_path / str(y)) for y in (2001, 2002)}
    out = R.read_seasons(spark, paths, S.WEEKLY_ALIASES, required=["player_id", "receptions"])
    assert {(r["player_id"], r["receptions"], r["yards"]) for r in out.collect()} == {("a", 3, None), ("b", 4, 9.0)}
