"""Registered source queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast import schemas as S
from fieldcast.plans.registry import register, sql_round
from fieldcast.sources import readers as R
from fieldcast.sources.fixtures import NO_CARRIES_SEASONS


def listed_seasons(t) -> list[int]:
    """Every season that some folder has a file of."""
    found = [R.season_files(t.spark, f).select("season") for f in t.season_folders.values()]
    return sorted(r["season"] for r in found[0].union(found[1]).distinct().collect())


_FEED_COLS = ("player_id, player_display_name, position, recent_team, season, week, opponent_team, "
              "targets, receptions, receiving_yards, receiving_tds, rushing_yards, rushing_tds")


@register("s1_read_seasons", doubles=("receiving_yards", "rushing_yards"), sql=f"""
SELECT {_FEED_COLS}, CASE WHEN season < (SELECT min(season) FROM player_stats) + {NO_CARRIES_SEASONS} THEN NULL
  ELSE carries END AS carries
FROM weekly_feed
""")
def q_read_seasons(t):
    """The weekly rows of the season files: of the two folders the first that has every season."""
    return R.load_source(t.spark, t.season_folders, listed_seasons(t))[0]


@register("s1_read_rosters", doubles=("age",), sql="SELECT * FROM rosters")
def q_read_rosters(t):
    return R.load_source(t.spark, t.season_folders, listed_seasons(t))[1]


@register("s2_source_status", sql="""
WITH ends AS (SELECT min(season) AS a, max(season) AS z FROM player_stats)
SELECT source, kind, CAST(s AS INTEGER) AS season, s <= z AND (source = 'archive' OR s = z)
    AND s IN (SELECT season FROM player_stats) AS present
FROM ends, range(0, 200) r(i), (VALUES ('local'), ('archive')) f(source), (VALUES ('player_stats'), ('roster')) k(kind),
  LATERAL (SELECT a + i AS s) x
WHERE s <= z + 1
""")
def q_source_status(t):
    """Which files each folder has for the seasons listed, and for the next one, which none has yet."""
    seasons = listed_seasons(t)
    told = [R.file_status(t.spark, path, [*seasons, seasons[-1] + 1]).withColumn("source", F.lit(name))
            for name, path in t.season_folders.items()]
    return told[0].unionByName(told[1])


@register("s3_apply_aliases", doubles=("age",), sql="""
SELECT player_id, player_name, position, team, season, age, height, weight, draft_round,
       draft_pick, rookie_season, lower(team) AS club_code
FROM rosters
""")
def q_apply_aliases(t):
    renamed = t.rosters.select(
        F.col("player_id").alias("gsis_id"), F.col("player_name").alias("full_name"), "position",
        "team", F.lower("team").alias("club_code"), "season", "age",
        F.col("height").alias("height_inches"), F.col("weight").alias("weight_lbs"), "draft_round",
        F.col("draft_pick").alias("draft_number"), F.col("rookie_season").alias("rookie_year"))
    return R.apply_aliases(renamed, S.ROSTER_ALIASES)


@register("s4_require_columns", sql="SELECT player_id, season, week, position FROM weekly_feed")
def q_require_columns(t):
    return R.require_columns(t.weekly_feed, ("player_id", "season", "week", "position"),
                             "weekly stats").select("player_id", "season", "week", "position")


@register("s5_project_known", doubles=("receiving_yards", "rushing_yards"), sql=f"""
SELECT {_FEED_COLS}, carries FROM weekly_feed
""")
def q_project_known(t):
    df, _absent = R.project_known(t.weekly_feed, S.WEEKLY_COLUMNS)
    return df


@register("s6_filter_positions", doubles=("receiving_yards", "rushing_yards"), sql=f"""
SELECT {_FEED_COLS}, carries FROM weekly_feed WHERE position IN ('WR', 'RB', 'TE')
""")
def q_filter_positions(t):
    return R.filter_positions(t.weekly_feed, S.FLEX_POSITIONS)


@register("s7_derive_age", doubles=("age",), sql=f"""
SELECT player_id, season, birth_date,
  {sql_round("date_diff('day', TRY_CAST(birth_date AS DATE), make_date(season, 9, 1)) / 365.25", 1)} AS age
FROM births
""")
def q_derive_age(t):
    return R.derive_age(t.births)


@register("s8_read_draft_picks", sql="""
SELECT gsis_id AS external_id, CAST(round AS INTEGER) AS draft_round, CAST(pick AS INTEGER) AS draft_pick
FROM draft_picks WHERE season = 2002 AND gsis_id IS NOT NULL
""")
def q_read_draft_picks(t):
    return R.read_draft_picks(t.draft_picks, season=2002)


@register("s9_read_bios", sql="""
SELECT gsis_id AS external_id, pfr_id, draft_round, draft_pick, rookie_season, years_of_experience,
       display_name AS name, position, latest_team AS team
FROM bios WHERE gsis_id IS NOT NULL
""")
def q_read_bios(t):
    return R.read_bios(t.bios, full=True)


_SNAP_SQL = """
WITH m AS (SELECT pfr_player_id AS pfr_id, avg(offense_pct) AS share FROM snap_counts
           WHERE season = 2001 GROUP BY pfr_player_id),
j AS (SELECT b.gsis_id AS external_id, m.share FROM m JOIN bios b ON b.pfr_id = m.pfr_id)
SELECT external_id, CASE WHEN (SELECT max(share) FROM j) > 1.5 THEN share / 100.0 ELSE share END
       AS prior_snap_share
FROM j
"""


@register("s10_snap_share", doubles=("prior_snap_share",), sql=_SNAP_SQL)
def q_snap_share(t):
    return R.snap_share(t.snap_counts, R.read_bios(t.bios), season=2001)


_DEPTH_SQL = """
SELECT gsis_id AS external_id, CAST(least(greatest(arg_max(pos_rank, dt), 1), 10) AS INTEGER) AS depth_chart_rank
FROM depth_charts WHERE pos_rank IS NOT NULL GROUP BY gsis_id
"""


@register("s11_depth_rank", sql=_DEPTH_SQL)
def q_depth_rank(t):
    return R.depth_rank(t.depth_charts)


@register("s11_depth_rank_old_schema", sql="""
WITH newest AS (SELECT max(season) AS season FROM weekly_charts)
SELECT gsis_id AS external_id,
  CAST(least(greatest(arg_max(CAST(depth_team AS INTEGER), 100 * (100 - week) + CAST(depth_team AS INTEGER)), 1), 10) AS INTEGER)
    AS depth_chart_rank
FROM weekly_charts JOIN newest USING (season) WHERE depth_team IS NOT NULL GROUP BY gsis_id
""")
def q_depth_rank_old_schema(t):
    newest = t.weekly_charts.agg(F.max("season")).first()[0]
    return R.depth_rank(t.weekly_charts, season=newest)


@register("s11_depth_versions", sql="""
WITH known AS (
  SELECT gsis_id AS external_id, CAST(year(dt) + CASE WHEN month(dt) >= 9 THEN 1 ELSE 0 END AS INTEGER) AS season,
    CAST(least(greatest(arg_max(pos_rank, dt), 1), 10) AS INTEGER) AS depth_chart_rank
  FROM depth_charts WHERE pos_rank IS NOT NULL GROUP BY ALL),
moved AS (SELECT *, depth_chart_rank IS DISTINCT FROM lag(depth_chart_rank) OVER (PARTITION BY external_id ORDER BY season) AS new
  FROM known)
SELECT external_id, season AS valid_from, lead(season) OVER (PARTITION BY external_id ORDER BY season) AS valid_to, depth_chart_rank
FROM moved WHERE new
""")
def q_depth_versions(t):
    return R.depth_versions(t.depth_charts)


@register("s12_optional_feed", sql=f"""
SELECT p.player_id, p.external_id, d.depth_chart_rank
FROM players p LEFT JOIN ({_DEPTH_SQL}) d ON d.external_id = p.external_id
""")
def q_optional_feed(t):
    schema = T.StructType([T.StructField("external_id", T.StringType()),
                           T.StructField("depth_chart_rank", T.IntegerType())])
    feed = R.optional_feed(lambda: R.depth_rank(t.depth_charts), schema, t.spark)
    return t.players.select("player_id", "external_id").join(feed, "external_id", "left")


@register("s13_sql_params", doubles=("ppg",), sql="""
SELECT player_id, count(*) AS games, avg(fantasy_points) AS ppg
FROM player_stats WHERE season = 2001 AND week <= 18 GROUP BY player_id
""")
def q_sql_params(t):
    return R.sql_params(
        t.spark,
        "SELECT player_id, count(*) AS games, avg(fantasy_points) AS ppg FROM {stats} "
        "WHERE season = :season AND week <= :max_week GROUP BY player_id",
        {"season": 2001, "max_week": S.REGULAR_SEASON_WEEKS}, stats=t.player_stats)
