"""Registered cleaning queries (C1-C10) over the dirty weekly feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.operators import cleaning as C
from fieldcast.plans.registry import register, sql_round

KEY = "player_id, season, week"

_C1 = """SELECT * FROM dirty_weekly
WHERE player_id IS NOT NULL AND season IS NOT NULL AND week IS NOT NULL
  AND position IS NOT NULL AND recent_team IS NOT NULL"""

_C3 = f"""SELECT player_id, player_display_name, position, recent_team, season, week, opponent_team,
  CAST(rint_targets AS INTEGER) AS targets, CAST(rint_carries AS INTEGER) AS carries,
  CAST(rint_receptions AS INTEGER) AS receptions, CAST(rint_receiving_tds AS INTEGER) AS receiving_tds,
  CAST(rint_rushing_tds AS INTEGER) AS rushing_tds,
  coalesce(CAST(receiving_yards AS DOUBLE), 0.0) AS receiving_yards,
  coalesce(CAST(rushing_yards AS DOUBLE), 0.0) AS rushing_yards
FROM (SELECT *,
  round_even(greatest(coalesce(CAST(targets AS DOUBLE), 0.0), 0.0), 0) AS rint_targets,
  round_even(greatest(coalesce(CAST(carries AS DOUBLE), 0.0), 0.0), 0) AS rint_carries,
  round_even(greatest(coalesce(CAST(receptions AS DOUBLE), 0.0), 0.0), 0) AS rint_receptions,
  round_even(greatest(coalesce(CAST(receiving_tds AS DOUBLE), 0.0), 0.0), 0) AS rint_receiving_tds,
  round_even(greatest(coalesce(CAST(rushing_tds AS DOUBLE), 0.0), 0.0), 0) AS rint_rushing_tds
  FROM ({_C1}) c1) c2"""

_C4 = f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id, season, week
     ORDER BY receiving_yards DESC NULLS LAST, receptions DESC NULLS LAST, targets DESC NULLS LAST,
              carries DESC NULLS LAST) AS rn
  FROM ({_C3}) c3) d WHERE rn = 1"""

_PTS = ("(((((0.0 + CAST(receptions AS DOUBLE) * 1.0) + receiving_yards * 0.1) + CAST(receiving_tds AS DOUBLE) * 6.0)"
        " + rushing_yards * 0.1) + CAST(rushing_tds AS DOUBLE) * 6.0)")
_C5 = f"""SELECT *, {sql_round(_PTS, 2)} AS fantasy_points
FROM ({_C4}) c4"""

_CLEAN = f"""SELECT player_id, player_display_name AS name, position, recent_team AS team,
  CAST(season AS INTEGER) AS season, CAST(week AS INTEGER) AS week,
  substr(upper(coalesce(CAST(opponent_team AS VARCHAR), 'UNK')), 1, 8) AS opponent, true AS is_home,
  targets, carries, receptions, receiving_yards + rushing_yards AS yards,
  receiving_tds + rushing_tds AS touchdowns, fantasy_points
FROM ({_C5}) c5"""


def _stages(t):
    c1 = C.drop_unjoinable(t.dirty_weekly)
    c3 = C.clean_floats(C.clean_counts(c1))
    c4 = C.dedupe_fullest(c3)
    c5 = c4.withColumn("fantasy_points", C.fantasy_points(c4))
    return c1, c3, c4, c5


@register("c1_drop_unjoinable", doubles=("receiving_yards", "rushing_yards"), sql=_C1)
def q_drop_unjoinable(t):
    return _stages(t)[0]


@register("c2_clean_counts", sql=f"""
SELECT {KEY}, targets, carries, receptions, receiving_tds, rushing_tds FROM ({_C3}) x""")
def q_clean_counts(t):
    return C.clean_counts(_stages(t)[0]).select(
        "player_id", "season", "week", "targets", "carries", "receptions", "receiving_tds", "rushing_tds")


@register("c3_clean_floats", doubles=("receiving_yards", "rushing_yards"), sql=f"""
SELECT {KEY}, receiving_yards, rushing_yards FROM ({_C3}) x""")
def q_clean_floats(t):
    return _stages(t)[1].select("player_id", "season", "week", "receiving_yards", "rushing_yards")


@register("c4_dedupe_fullest", doubles=("receiving_yards",), sql=f"""
SELECT {KEY}, receiving_yards, receptions, targets FROM ({_C4}) x""")
def q_dedupe_fullest(t):
    return _stages(t)[2].select("player_id", "season", "week", "receiving_yards", "receptions", "targets")


@register("c5_fantasy_points", doubles=("fantasy_points",), sql=f"""
SELECT {KEY}, fantasy_points FROM ({_C5}) x""")
def q_fantasy_points(t):
    return _stages(t)[3].select("player_id", "season", "week", "fantasy_points")


@register("c6_derive_totals", doubles=("yards",), sql=f"""
SELECT {KEY}, receiving_yards + rushing_yards AS yards, receiving_tds + rushing_tds AS touchdowns
FROM ({_C4}) x""")
def q_derive_totals(t):
    return C.derive_totals(_stages(t)[2]).select("player_id", "season", "week", "yards", "touchdowns")


@register("c7_normalise_opponent", sql=f"""
SELECT {KEY}, substr(upper(coalesce(CAST(opponent_team AS VARCHAR), 'UNK')), 1, 8) AS opponent
FROM ({_C4}) x""")
def q_normalise_opponent(t):
    return _stages(t)[2].select("player_id", "season", "week",
                                C.normalise_opponent("opponent_team").alias("opponent"))


@register("c8_project_clean", doubles=("yards", "fantasy_points"), sql=_CLEAN)
def q_project_clean(t):
    return C.clean_weekly(t.dirty_weekly)


ROSTERS_CLEAN = """
SELECT player_id, player_name AS name, position, team, season, CAST(age AS DOUBLE) AS age,
  CAST(height AS DOUBLE) AS height_inches, CAST(weight AS DOUBLE) AS weight_lbs,
  CAST(draft_round AS DOUBLE) AS draft_round, CAST(draft_pick AS DOUBLE) AS draft_pick,
  CAST(rookie_season AS DOUBLE) AS rookie_season
FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS rn
      FROM rosters WHERE player_id IS NOT NULL) r WHERE rn = 1
"""


@register("c9_clean_rosters", sql=ROSTERS_CLEAN,
          doubles=("age", "height_inches", "weight_lbs", "draft_round", "draft_pick", "rookie_season"))
def q_clean_rosters(t):
    return C.clean_rosters(t.rosters)


@register("c10_row_accounting", sql=f"""
WITH counts AS (SELECT (SELECT count(*) FROM dirty_weekly) AS a, (SELECT count(*) FROM ({_C1}) c) AS b,
  (SELECT count(*) FROM ({_C4}) c) AS u, (SELECT count(*) FROM ({_CLEAN}) c) AS z),
steps AS (SELECT 'drop_unjoinable' AS stage, a AS rows_in, b AS rows_out FROM counts
  UNION ALL SELECT 'clean_numbers', b, (SELECT count(*) FROM ({_C3}) c) FROM counts
  UNION ALL SELECT 'dedupe_fullest', b, u FROM counts UNION ALL SELECT 'shape', u, z FROM counts
  UNION ALL SELECT 'clean_weekly', a, z FROM counts)
SELECT *, rows_in - rows_out AS dropped FROM steps
""")
def q_row_accounting(t):
    return C.stage_counts(t.dirty_weekly)


__all__ = ["F"]
