"""Registered leaderboard / read queries (Q1-Q16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.operators import boards as B
from fieldcast.operators import preseason as P
from fieldcast.plans.q_preseason import CONTEXT_SQL, context_table
from fieldcast.plans.registry import register, sql_round
from fieldcast.sources import readers as R

BOARD_SEASON, WEEKLY_WEEK, WEEKLY_VERSION, SEASON_VERSION = 2002, 1, "O", "F"


def _fmt1(x):
    return f"printf('%.1f', {sql_round(x, 1)})"


def board_context(t, season=BOARD_SEASON):
    return context_table(t).where(F.col("season") == season)


PLAYER_COLS = "player_id, external_id, name, team, position, age, draft_round, draft_pick, rookie_season"

LATEST = f"""latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY created_at DESC, id DESC) AS rn
    FROM predictions WHERE season = {BOARD_SEASON} AND week = 0 AND model_version = '{SEASON_VERSION}') x
  WHERE rn = 1),
pool AS (SELECT l.*, p.name, p.team, p.position FROM latest l JOIN players p ON p.player_id = l.player_id
         WHERE p.position IN ('WR', 'RB', 'TE')),
cnt AS (SELECT position, count(*) AS n, min(prediction) AS mn FROM pool GROUP BY position),
nth AS (SELECT position, prediction, row_number() OVER (PARTITION BY position ORDER BY prediction DESC) AS rn
        FROM pool),
levels AS (
  SELECT c.position,
    {sql_round('''CASE WHEN c.n >= s.starters THEN (SELECT prediction FROM nth WHERE nth.position = c.position
                                               AND nth.rn = s.starters)
         WHEN c.n >= 3 THEN c.mn ELSE 0.0 END''', 2)} AS replacement_level,
    s.starters
  FROM cnt c JOIN (SELECT position, CASE position WHEN 'WR' THEN 36 WHEN 'RB' THEN 30 WHEN 'TE' THEN 14
                   ELSE 24 END AS starters FROM cnt) s ON s.position = c.position)"""


@register("q1_search_players", sql=f"""
SELECT {PLAYER_COLS}, (SELECT count(*) FROM players WHERE position = 'WR' AND name ILIKE '%1%') AS total
FROM players WHERE position = 'WR' AND name ILIKE '%1%' ORDER BY name, player_id LIMIT 20 OFFSET 5""")
def q_search(t):
    return B.search_players(t.players, position="wr", name="1", limit=20, offset=5)


@register("q2_player_lookup", sql=f"""
SELECT r.player_id, p.external_id, p.name, p.team, p.position, p.age, p.draft_round, p.draft_pick,
       p.rookie_season, p.player_id IS NOT NULL AS found
FROM (SELECT DISTINCT player_id FROM predictions) r LEFT JOIN players p ON p.player_id = r.player_id""")
def q_lookup(t):
    return B.player_lookup(t.predictions, t.players)


@register("q3_game_log", doubles=("yards", "fantasy_points"), sql="""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY season DESC, week DESC)
                          AS INTEGER) AS recency FROM player_stats) x WHERE recency <= 5""")
def q_game_log(t):
    return B.game_log(t.player_stats, limit=5)


@register("q4_game_log_summary", doubles=("fantasy_points", "total_points", "max_points", "bar_pct"), sql="""
WITH g AS (SELECT * FROM player_stats WHERE season = 2001 AND week <= 18),
per AS (SELECT player_id, sum(fantasy_points) AS total_points, count(*) AS games,
          greatest(1.0, max(fantasy_points)) AS max_points FROM g GROUP BY player_id)
SELECT g.player_id, g.season, g.week, g.fantasy_points, per.total_points, per.games, per.max_points,
       greatest(2.0, g.fantasy_points / per.max_points * 100) AS bar_pct
FROM g JOIN per ON per.player_id = g.player_id""")
def q_game_log_summary(t):
    return B.game_log_summary(t.player_stats, 2001)


@register("q5_season_has_games", sql="""
SELECT s AS season, s IN (SELECT season FROM player_stats) AS has_games
FROM range((SELECT min(season) FROM player_stats), (SELECT max(season) FROM player_stats) + 3) r(s)""")
def q_has_games(t):
    asked = t.player_stats.select(F.explode(F.sequence(F.min("season").cast("long"), F.max("season").cast("long") + 2)).alias("season"))
    return B.season_has_games(asked, t.player_stats)


@register("q6_season_leaders", doubles=("total_points", "points_per_game", "yards"), sql="""
WITH agg AS (
  SELECT p.player_id, p.name, p.team, p.position, count(*) AS games, sum(s.fantasy_points) AS total_points,
    avg(s.fantasy_points) AS points_per_game, CAST(sum(s.targets) AS BIGINT) AS targets,
    CAST(sum(s.receptions) AS BIGINT) AS receptions, sum(s.yards) AS yards,
    CAST(sum(s.touchdowns) AS BIGINT) AS touchdowns
  FROM player_stats s JOIN players p ON p.player_id = s.player_id
  WHERE s.season = 2001 AND s.week <= 18 AND p.position IN ('WR', 'RB', 'TE')
  GROUP BY p.player_id, p.name, p.team, p.position)
SELECT *, CAST(10 + row_number() OVER (ORDER BY total_points DESC, player_id) AS INTEGER) AS rank,
       (SELECT count(*) FROM agg) AS total
FROM (SELECT * FROM agg ORDER BY total_points DESC, player_id LIMIT 20 OFFSET 10) page""")
def q_leaders(t):
    return B.season_leaders(t.player_stats, t.players, 2001, "FLEX", limit=20, offset=10)


@register("q7_position_filter", sql=f"SELECT {PLAYER_COLS} FROM players WHERE position IN ('WR', 'RB', 'TE')")
def q_position_filter(t):
    return t.players.where(F.col("position").isin(*B.position_filter("flex")))


@register("q8_weekly_board", doubles=("projected_points", "confidence"), sql=f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY created_at DESC, id DESC) AS rn
                 FROM predictions WHERE season = {BOARD_SEASON} AND week = {WEEKLY_WEEK}
                   AND model_version = '{WEEKLY_VERSION}') x WHERE rn = 1),
top AS (SELECT l.player_id, p.name, p.team, p.position, l.prediction, l.confidence FROM latest l
        JOIN players p ON p.player_id = l.player_id WHERE p.position = 'WR'
        ORDER BY l.prediction DESC, l.player_id LIMIT 25)
SELECT CAST(row_number() OVER (ORDER BY prediction DESC, player_id) AS INTEGER) AS rank, player_id, name, team,
       position, {sql_round('prediction', 2)} AS projected_points, confidence FROM top""")
def q_weekly_board(t):
    return B.weekly_board(t.predictions, t.players, BOARD_SEASON, WEEKLY_WEEK, WEEKLY_VERSION,
                          position="WR", limit=25)


BASIS_SQL = f"""CASE WHEN c.is_rookie IS NULL THEN NULL
  WHEN c.is_rookie THEN CASE WHEN c.draft_pick IS NOT NULL AND c.draft_pick <> 0
                             THEN printf('rookie, no NFL record - drafted #%d', c.draft_pick)
                             ELSE 'rookie, no NFL record - undrafted' END
  ELSE (CASE WHEN coalesce(c.career_seasons, 0) <= 1 THEN printf('1 season, %d games', coalesce(c.prior_games, 0))
             ELSE printf('%d seasons, %s career pts/gm', c.career_seasons, {_fmt1('coalesce(c.career_weighted_ppg, 0.0)')}) END)
    || (CASE WHEN coalesce(c.career_weighted_ppg, 0.0) > 0 AND coalesce(c.prior_games, 0) >= 4 THEN
          CASE WHEN coalesce(c.prior_points_per_game, 0.0) - coalesce(c.career_weighted_ppg, 0.0) <= -3.0
                 THEN printf('; last year %s was well below it', {_fmt1('coalesce(c.prior_points_per_game, 0.0)')})
               WHEN coalesce(c.prior_points_per_game, 0.0) - coalesce(c.career_weighted_ppg, 0.0) >= 3.0
                 THEN printf('; last year %s was a step up', {_fmt1('coalesce(c.prior_points_per_game, 0.0)')})
               ELSE printf('; last year %s, in line', {_fmt1('coalesce(c.prior_points_per_game, 0.0)')}) END
        ELSE '' END)
    || (CASE WHEN coalesce(c.prior_games, 0) > 0 AND coalesce(c.prior_games, 0) < 10
             THEN printf(' (only %d games)', c.prior_games) ELSE '' END) END"""


NOTE_SQL = f"""SELECT CASE WHEN count(*) = 0 THEN 'No replacement baseline available.'
  ELSE 'Value is points per game above a replacement starter at the same position: '
       || array_to_string(list_sort(list(printf('%s %s (#%d)', position, {_fmt1('replacement_level')}, starters))), ', ')
       || '. Assumes a 12-team league.' END AS replacement_note
FROM levels"""


def _board_sql(key: str, limit: int, offset: int) -> str:
    return f"""
WITH {LATEST},
ctx AS (SELECT * FROM ({CONTEXT_SQL}) cc WHERE season = {BOARD_SEASON}),
b AS (
  SELECT p.*, lv.replacement_level, {sql_round('p.prediction - lv.replacement_level', 2)} AS value_over_replacement,
    CAST(rank() OVER (PARTITION BY p.position ORDER BY p.prediction DESC) AS INTEGER) AS position_rank,
    c.is_rookie, c.draft_pick AS ctx_pick, {BASIS_SQL} AS basis
  FROM pool p LEFT JOIN levels lv ON lv.position = p.position
  LEFT JOIN ctx c ON c.player_id = p.player_id),
page AS (SELECT * FROM b ORDER BY {key} DESC, player_id LIMIT {limit} OFFSET {offset})
SELECT CAST({offset} + row_number() OVER (ORDER BY {key} DESC, player_id) AS INTEGER) AS rank,
  player_id, name, team, position, {sql_round('prediction', 2)} AS projected_points_per_game,
  {sql_round('prediction * 17', 1)} AS projected_season_points, coalesce(is_rookie, false) AS is_rookie,
  basis, value_over_replacement, position_rank, replacement_level, confidence, ({NOTE_SQL}) AS replacement_note,
  EXISTS (SELECT 1 FROM player_stats WHERE season = {BOARD_SEASON}) AS season_started, (SELECT count(*) FROM b) AS total
FROM page"""


BOARD_DOUBLES = ("projected_points_per_game", "projected_season_points", "value_over_replacement", "replacement_level",
                 "confidence")


@register("q9_season_board", doubles=BOARD_DOUBLES, sql=_board_sql("coalesce(value_over_replacement, -999.0)", 20, 0))
def q_season_board(t):
    return B.season_board(t.predictions, t.players, board_context(t), BOARD_SEASON, SEASON_VERSION, stats=t.player_stats)


@register("q9_season_board_by_points", doubles=BOARD_DOUBLES, sql=_board_sql("prediction", 10, 10))
def q_season_board_by_points(t):
    return B.season_board(t.predictions, t.players, board_context(t), BOARD_SEASON, SEASON_VERSION, sort="points",
                          page=2, per_page=10, stats=t.player_stats)


def _flex_pool(t):
    latest = B.latest_predictions(t.predictions, BOARD_SEASON, S.SEASON_PROJECTION_WEEK, SEASON_VERSION)
    p = t.players.where(F.col("position").isin(*S.FLEX_POSITIONS)).select("player_id", "name", "team", "position")
    return latest.join(p, "player_id")


@register("q10_replacement_level", doubles=("replacement_level",),
          sql=f"WITH {LATEST} SELECT position, replacement_level, starters FROM levels")
def q_levels(t):
    return B.replacement_levels(_flex_pool(t))


@register("q11_value_over_replacement", doubles=("prediction", "replacement_level", "value_over_replacement"),
          sql=f"""WITH {LATEST}
SELECT p.player_id, p.position, p.prediction, lv.replacement_level,
       {sql_round('p.prediction - lv.replacement_level', 2)} AS value_over_replacement
FROM pool p LEFT JOIN levels lv ON lv.position = p.position""")
def q_vor(t):
    pool = _flex_pool(t)
    return B.value_over_replacement(pool, B.replacement_levels(pool)).select(
        "player_id", "position", "prediction", "replacement_level", "value_over_replacement")


@register("q12_replacement_note", sql=f"WITH {LATEST}\n{NOTE_SQL}")
def q_note(t):
    return B.replacement_note(B.replacement_levels(_flex_pool(t)))


@register("q13_position_rank", doubles=("prediction",), sql=f"""WITH {LATEST}
SELECT player_id, position, prediction,
       CAST(rank() OVER (PARTITION BY position ORDER BY prediction DESC) AS INTEGER) AS position_rank
FROM pool""")
def q_position_rank(t):
    return B.position_rank(_flex_pool(t)).select("player_id", "position", "prediction", "position_rank")


@register("q14_board_basis", sql=f"""
SELECT c.player_id, c.season, {BASIS_SQL} AS basis FROM ({CONTEXT_SQL}) c WHERE c.season = {BOARD_SEASON}""")
def q_basis(t):
    return board_context(t).select("player_id", "season", B.board_basis().alias("basis"))


@register("q15_prediction_history", doubles=("prediction",), sql="""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY created_at DESC, id DESC)
                          AS INTEGER) AS recency FROM predictions) x WHERE recency <= 20""")
def q_history(t):
    return B.prediction_history(t.predictions, limit=20)


@register("q16_data_extent", sql="""
SELECT season, season = (SELECT max(season) FROM player_stats) AS is_latest,
  CASE WHEN season = (SELECT max(season) FROM player_stats)
       THEN (SELECT max(week) FROM player_stats WHERE season = (SELECT max(season) FROM player_stats)) END
    AS latest_week
FROM (SELECT DISTINCT season FROM player_stats) d""")
def q_extent(t):
    return B.data_extent(t.player_stats)
