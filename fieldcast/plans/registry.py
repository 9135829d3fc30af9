"""Registry of named queries (Spark callables) and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldcast.functions.columns import round_doubles
from fieldcast.sources.fixtures import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# DuckDB versions of the fixture views (see FIXTURES.md). Oracle queries are
# written against these names; DuckDB only evaluates the CTEs a query uses.
FIXTURE_CTES = """
players AS (
  SELECT s_suppkey AS player_id, concat('00-', lpad(CAST(s_suppkey AS VARCHAR), 7, '0')) AS external_id,
    s_name AS name, concat('T', CAST(s_nationkey % 8 AS VARCHAR)) AS team,
    CASE WHEN s_suppkey % 10 < 4 THEN 'WR' WHEN s_suppkey % 10 < 7 THEN 'RB'
         WHEN s_suppkey % 10 < 9 THEN 'TE' ELSE 'QB' END AS position,
    CAST(21 + s_suppkey % 13 AS INTEGER) AS age,
    CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(1 + s_suppkey % 7 AS INTEGER) END AS draft_round,
    CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(1 + (s_suppkey * 37) % 260 AS INTEGER) END AS draft_pick,
    CAST(1995 + s_suppkey % 8 AS INTEGER) AS rookie_season
  FROM supplier),
lines AS (
  SELECT l_suppkey AS player_id, CAST(year(l_shipdate) AS INTEGER) AS season,
    CAST(floor((dayofyear(l_shipdate) - 1) / 17) + 1 AS INTEGER) AS week,
    l_linestatus, l_returnflag, l_quantity
  FROM lineitem),
player_stats AS (
  SELECT x.player_id, x.season, x.week,
    CASE WHEN (CAST(substr(p.team, 2, 1) AS INTEGER) + x.week * 3) % 8 = CAST(substr(p.team, 2, 1) AS INTEGER)
         THEN concat('T', CAST((CAST(substr(p.team, 2, 1) AS INTEGER) + 1) % 8 AS VARCHAR))
         ELSE concat('T', CAST((CAST(substr(p.team, 2, 1) AS INTEGER) + x.week * 3) % 8 AS VARCHAR)) END AS opponent,
    x.week % 2 = 0 AS is_home, x.targets, x.carries, x.receptions, x.yards, x.touchdowns,
    (x.receptions * 10 + x.yards + x.touchdowns * 60) / 10.0 AS fantasy_points
  FROM (SELECT player_id, season, week, CAST(count(*) AS INTEGER) AS targets,
          CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS INTEGER) AS carries,
          CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS INTEGER) AS receptions,
          CAST(sum(l_quantity) AS DOUBLE) AS yards,
          CAST(count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 45) AS INTEGER) AS touchdowns
        FROM lines GROUP BY player_id, season, week) x
  JOIN players p ON p.player_id = x.player_id),
predictions AS (
  SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS player_id, CAST(2002 AS INTEGER) AS season,
    CAST(o_orderkey % 3 AS INTEGER) AS week, concat('T', CAST(o_orderkey % 8 AS VARCHAR)) AS opponent,
    o_totalprice / 20000.0 AS prediction, CAST((5 + o_orderkey % 90) / 100.0 AS DOUBLE) AS confidence,
    o_orderstatus AS model_version, o_orderdate AS created_at
  FROM orders),
depth_charts AS (
  SELECT concat('00-', lpad(CAST(user_id AS VARCHAR), 7, '0')) AS gsis_id,
    ts - to_years(CAST(year(ts) - (1995 + event_id % 8) AS INTEGER)) AS dt,
    CASE WHEN event_type = 'error' THEN NULL ELSE CAST(1 + event_id % 12 AS INTEGER) END AS pos_rank
  FROM events),
weekly_charts AS (
  SELECT concat('00-', lpad(CAST(user_id AS VARCHAR), 7, '0')) AS gsis_id, CAST(1995 + event_id % 8 AS INTEGER) AS season,
    CAST(1 + event_id % 22 AS INTEGER) AS week,
    CASE WHEN event_type = 'error' THEN NULL ELSE CAST(1 + event_id % 12 AS VARCHAR) END AS depth_team
  FROM events),
snap_counts AS (
  SELECT concat('pfr', CAST(l_suppkey AS VARCHAR)) AS pfr_player_id, CAST(year(l_shipdate) AS INTEGER) AS season,
    l_discount * 1000 AS offense_pct
  FROM lineitem),
raw_weekly AS (
  SELECT l_orderkey AS player_key, l_linenumber AS week, l_quantity AS receiving_yards, l_suppkey, l_extendedprice
  FROM lineitem),
bios AS (
  SELECT external_id AS gsis_id, concat('pfr', CAST(player_id AS VARCHAR)) AS pfr_id, name AS display_name,
    position, team AS latest_team, draft_round, draft_pick, rookie_season,
    CAST(2002 - rookie_season AS INTEGER) AS years_of_experience
  FROM players),
draft_picks AS (
  SELECT external_id AS gsis_id, draft_round AS round, draft_pick AS pick, rookie_season AS season
  FROM players WHERE draft_pick IS NOT NULL),
rosters AS (
  SELECT p.external_id AS player_id, p.name AS player_name, p.position, p.team, s.season,
    CAST(p.age - (2002 - s.season) AS DOUBLE) AS age, CAST(66 + p.player_id % 12 AS INTEGER) AS height,
    CAST(180 + s.season % 7 * 5 AS INTEGER) AS weight, p.draft_round, p.draft_pick, p.rookie_season
  FROM (SELECT DISTINCT player_id, season FROM player_stats) s JOIN players p ON p.player_id = s.player_id),
game_teams AS (
  SELECT s.player_id, s.season, s.week, concat('T', CAST((CAST(substr(p.team, 2, 1) AS INTEGER)
    + CASE WHEN s.player_id % 7 = 0 AND s.season * 100 + s.week < 199705 THEN 3
           WHEN s.player_id % 5 = 0 AND s.season * 100 + s.week < 200010 THEN 1 ELSE 0 END) % 8 AS VARCHAR)) AS team
  FROM player_stats s JOIN players p ON p.player_id = s.player_id),
schedule AS (
  SELECT season, week, concat('T', CAST(k AS VARCHAR)) AS home_team, concat('T', CAST(xor(k, 1 + week % 7) AS VARCHAR)) AS away_team
  FROM (SELECT DISTINCT season, CAST(week AS BIGINT) AS week FROM player_stats) w, range(8) r(k)
  WHERE CASE WHEN week % 2 = 0 THEN k < xor(k, 1 + week % 7) ELSE k > xor(k, 1 + week % 7) END
    AND (week % 4 <> 0 OR least(k, xor(k, 1 + week % 7)) > 0)),
season_rosters AS (
  SELECT p.external_id, g.season, g.team, p.position, CAST(p.age - (2002 - g.season) AS INTEGER) AS age
  FROM (SELECT player_id, season, arg_min(team, week) AS team FROM game_teams GROUP BY player_id, season) g
  JOIN players p ON p.player_id = g.player_id),
weekly_feed AS (
  SELECT p.external_id AS player_id, p.name AS player_display_name, p.position, g.team AS recent_team,
    s.season, s.week, s.opponent AS opponent_team, s.targets, s.carries, s.receptions,
    s.yards * 0.75 AS receiving_yards, CAST(s.touchdowns % 2 AS INTEGER) AS receiving_tds,
    s.yards * 0.25 AS rushing_yards, CAST(s.touchdowns - s.touchdowns % 2 AS INTEGER) AS rushing_tds
  FROM player_stats s JOIN players p ON p.player_id = s.player_id
  JOIN game_teams g ON g.player_id = s.player_id AND g.season = s.season AND g.week = s.week),
dirty_weekly AS (
  SELECT player_id, player_display_name, position,
    CASE WHEN week = 21 THEN NULL ELSE recent_team END AS recent_team, season, week,
    CASE WHEN week % 5 = 0 THEN NULL ELSE lower(opponent_team) END AS opponent_team,
    CASE WHEN (week + season) % 7 = 0 THEN NULL ELSE targets END AS targets,
    CASE WHEN (week + season) % 11 = 0 THEN -1 ELSE carries END AS carries,
    receptions,
    CASE WHEN week = 3 THEN NULL ELSE receiving_yards END AS receiving_yards,
    receiving_tds, rushing_yards, rushing_tds
  FROM weekly_feed
  UNION ALL
  SELECT player_id, player_display_name, position, recent_team, season, week, opponent_team, targets, carries,
    receptions + 1, receiving_yards - 5.0, receiving_tds, rushing_yards, rushing_tds
  FROM weekly_feed WHERE week % 4 = 0),
births AS (
  SELECT player_id, season,
    CASE WHEN player_id % 11 = 0 THEN 'unknown'
         ELSE concat(CAST(1965 + player_id % 12 AS VARCHAR), '-', lpad(CAST(1 + player_id % 12 AS VARCHAR), 2, '0'),
                     '-', lpad(CAST(1 + player_id % 28 AS VARCHAR), 2, '0')) END AS birth_date
  FROM (SELECT DISTINCT player_id, season FROM player_stats) d)
"""


def with_fixtures(body: str, doubles=(), digits: int = 6) -> str:
    """Wrap an oracle query: fixture CTEs first, then the query as a subquery
    whose double columns get the same half-even rounding as the Spark side.

    `body` is a plain query and may carry its own WITH clause.
    """
    repl = ", ".join(f"{sql_round(c, digits)} AS {c}" for c in doubles)
    select = f"SELECT * REPLACE ({repl})" if doubles else "SELECT *"
    return f"WITH {FIXTURE_CTES.strip()}\n{select} FROM (\n{body.strip()}\n) AS q"


def register(key: str, sql: str | None = None, doubles=(), round_digits: int | None = 6):
    """Register a query builder ``fn(tables) -> DataFrame`` under `key`.

    Doubles in the result are rounded half-even to `round_digits` so the
    Spark result and the oracle (which rounds the listed `doubles` the same
    way) hash alike.
    """

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return round_doubles(df, round_digits) if round_digits is not None else df

        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = with_fixtures(sql, doubles, round_digits or 6)
        return fn

    return deco


def sql_round(expr: str, digits: int) -> str:
    """DuckDB twin of `round_half_even`: snap to 9 dp, then half-even."""
    x = f"({expr})"
    if digits < 9:
        x = f"(round_even({x} * 1e9, 0) / 1e9)"
    return f"(round_even({x} * 1e{digits}, 0) / 1e{digits} + 0.0)"
