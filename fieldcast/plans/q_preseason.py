"""Registered pre-season context queries (P1-P23), all target seasons at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.functions.columns import age_multiplier
from fieldcast.operators import preseason as P
from fieldcast.operators.dimensions import roster_versions
from fieldcast.plans.registry import register, sql_round
from fieldcast.sources import readers as R


def _targets(t):
    return P.target_season_list(t.player_stats)


def _ps(t):
    """The stored player-season aggregate (one row per player and season)."""
    return t.stored("player_seasons", lambda: P.player_seasons(t.player_stats),
                    sources=("lineitem", "supplier")) \
        .withColumn("season", F.col("season").cast("int"))


def _r(expr, d):
    return sql_round(expr, d)


def _mult(a):
    return (f"(CASE WHEN {a} IS NULL OR isnan({a}) THEN 1.0 "
            f"ELSE greatest(0.55, 1.0 - 0.01 * pow({a} - 26.5, 2)) END)")


# --------------------------------------------------------------- oracle CTEs
TG = """tg AS (SELECT DISTINCT season FROM player_stats WHERE season > (SELECT min(season) FROM player_stats)
       UNION SELECT max(season) + 1 FROM player_stats)"""

PROD = """prod AS (
  SELECT ps.player_id, t.season, p.external_id, p.team AS current_team, ps.week, ps.targets, ps.carries,
         ps.yards, ps.fantasy_points,
         row_number() OVER (PARTITION BY ps.player_id, t.season ORDER BY ps.week DESC) AS rn
  FROM player_stats ps JOIN tg t ON ps.season = t.season - 1 JOIN players p ON p.player_id = ps.player_id
  WHERE ps.week <= 18),
production AS (
  SELECT player_id, season, any_value(external_id) AS external_id, any_value(current_team) AS current_team,
    count(*) AS prior_games, avg(fantasy_points) AS prior_points_per_game, avg(targets) AS prior_targets_per_game,
    avg(carries) AS prior_carries_per_game, avg(yards) AS prior_yards_per_game,
    CAST(sum(targets) AS BIGINT) AS prior_targets_total, CAST(sum(carries) AS BIGINT) AS prior_carries_total,
    avg(fantasy_points) FILTER (WHERE rn <= 4) AS prior_last4_points_per_game
  FROM prod GROUP BY player_id, season),
team_prior AS (
  SELECT p.team, t.season, CAST(sum(ps.targets) AS BIGINT) AS team_targets,
         CAST(sum(ps.carries) AS BIGINT) AS team_carries, sum(ps.fantasy_points) AS team_points
  FROM player_stats ps JOIN tg t ON ps.season = t.season - 1 JOIN players p ON p.player_id = ps.player_id
  WHERE ps.week <= 18 AND p.team IS NOT NULL GROUP BY p.team, t.season),
usage AS (
  SELECT pr.player_id, pr.season, pr.external_id, pr.current_team, pr.prior_games, pr.prior_points_per_game,
    pr.prior_targets_per_game, pr.prior_carries_per_game, pr.prior_yards_per_game, pr.prior_last4_points_per_game,
    least(greatest(coalesce(pr.prior_targets_total / nullif(tp.team_targets, 0), 0.0), 0), 1) AS prior_target_share,
    least(greatest(coalesce(pr.prior_carries_total / nullif(tp.team_carries, 0), 0.0), 0), 1) AS prior_carry_share,
    coalesce(tp.team_points, 0.0) AS team_points_prior
  FROM production pr LEFT JOIN team_prior tp ON tp.team = pr.current_team AND tp.season = pr.season)"""

QB = """qb1 AS (
  SELECT p.team, t.season, p.external_id AS qb_id, sum(ps.yards) AS pass_yards
  FROM player_stats ps JOIN tg t ON ps.season = t.season - 1 JOIN players p ON p.player_id = ps.player_id
  WHERE ps.week <= 18 AND p.position = 'QB' AND p.team IS NOT NULL GROUP BY p.team, t.season, p.external_id),
qb2 AS (
  SELECT p.team, t.season, p.external_id AS qb_id, sum(ps.yards) AS pass_yards
  FROM player_stats ps JOIN tg t ON ps.season = t.season - 2 JOIN players p ON p.player_id = ps.player_id
  WHERE ps.week <= 18 AND p.position = 'QB' AND p.team IS NOT NULL GROUP BY p.team, t.season, p.external_id),
prim1 AS (SELECT team, season, qb_id FROM (SELECT *, row_number() OVER (PARTITION BY team, season
            ORDER BY pass_yards DESC, qb_id) AS rn FROM qb1) x WHERE rn = 1),
prim2 AS (SELECT team, season, qb_id FROM (SELECT *, row_number() OVER (PARTITION BY team, season
            ORDER BY pass_yards DESC, qb_id) AS rn FROM qb2) x WHERE rn = 1),
vol AS (SELECT team, season, sum(pass_yards) AS team_pass_attempts_prior FROM qb1 GROUP BY team, season),
situation AS (
  SELECT v.team, v.season, v.team_pass_attempts_prior,
         (b.qb_id IS NOT NULL AND coalesce(a.qb_id <> b.qb_id, true)) AS qb_changed
  FROM vol v LEFT JOIN prim1 a ON a.team = v.team AND a.season = v.season
  LEFT JOIN prim2 b ON b.team = v.team AND b.season = v.season)"""

CAREER = f"""hist AS (
  SELECT player_id, season, count(*) AS games, avg(fantasy_points) AS ppg, avg(targets) AS targets_per_game,
    avg(carries) AS carries_per_game, sum(targets) AS targets, sum(carries) AS carries, sum(fantasy_points) AS points
  FROM player_stats WHERE week <= 18 GROUP BY player_id, season HAVING count(*) >= 3),
hf AS (
  SELECT h.player_id, t.season, h.season AS played_season, h.games, h.ppg, h.targets_per_game,
    h.carries_per_game, h.targets, h.carries, h.points, p.age, p.team, t.season - h.season AS seasons_ago
  FROM hist h JOIN tg t ON h.season < t.season LEFT JOIN players p ON p.player_id = h.player_id),
hw AS (
  SELECT *,
    coalesce(least(greatest({_mult('CAST(age AS DOUBLE)')} / {_mult('CAST(age AS DOUBLE) - seasons_ago')}, 0.6), 1.4), 1.0)
      AS age_factor,
    (CASE WHEN seasons_ago = 0 THEN 0.45 WHEN seasons_ago = 1 THEN 0.28 WHEN seasons_ago = 2 THEN 0.15 ELSE 0.06 END)
      * least(CAST(games AS DOUBLE) / 17.0, 1.0) AS weight
  FROM hf),
career AS (
  SELECT player_id, season,
    {_r("CASE WHEN sum(weight) > 0 THEN sum(coalesce(ppg * age_factor, 0.0) * weight) / sum(weight) ELSE 0.0 END", 3)}
      AS career_weighted_ppg,
    {_r("CASE WHEN sum(weight) > 0 THEN sum(coalesce(targets_per_game, 0.0) * weight) / sum(weight) ELSE 0.0 END", 3)}
      AS career_weighted_targets_per_game,
    {_r("CASE WHEN sum(weight) > 0 THEN sum(coalesce(carries_per_game, 0.0) * weight) / sum(weight) ELSE 0.0 END", 3)}
      AS career_weighted_carries_per_game,
    {_r("max(ppg)", 3)} AS career_best_ppg,
    count(*) AS career_seasons, CAST(sum(games) AS BIGINT) AS career_games,
    {_r("CASE WHEN sum(targets) > 0 THEN sum(points) / sum(targets) ELSE 0.0 END", 4)} AS career_points_per_target
  FROM hw GROUP BY player_id, season),
team_all AS (
  SELECT p.team, ps.season, sum(ps.targets) AS team_targets
  FROM player_stats ps JOIN players p ON p.player_id = ps.player_id
  WHERE ps.week <= 18 AND p.team IS NOT NULL GROUP BY p.team, ps.season),
cshare AS (
  SELECT hw.player_id, hw.season,
    {_r("coalesce(sum(least(greatest(coalesce(hw.targets / nullif(ta.team_targets, 0), 0.0), 0), 1) * hw.weight) / nullif(sum(hw.weight), 0), 0.0)", 4)}
      AS career_weighted_target_share
  FROM hw LEFT JOIN team_all ta ON ta.team = hw.team AND ta.season = hw.played_season
  GROUP BY hw.player_id, hw.season),
eff AS (
  SELECT pr.player_id, pr.season,
    {_r("coalesce(pr.points / nullif(pr.targets, 0), 0.0)", 4)} AS prior_points_per_target,
    {_r("coalesce(pr.points / nullif(pr.targets, 0), 0.0) - coalesce(c.career_points_per_target, 0.0)", 4)}
      AS efficiency_delta
  FROM (SELECT ps.player_id, t.season, sum(ps.fantasy_points) AS points, sum(ps.targets) AS targets
        FROM player_stats ps JOIN tg t ON ps.season = t.season - 1 WHERE ps.week <= 18
        GROUP BY ps.player_id, t.season) pr
  LEFT JOIN career c ON c.player_id = pr.player_id AND c.season = pr.season)"""

SHARES = """rs AS (
  SELECT ps.player_id, t.season, p.position, g.team AS prod_team, p.team AS now_team,
    sum(ps.targets) AS targets, sum(ps.carries) AS carries
  FROM player_stats ps JOIN tg t ON ps.season = t.season - 1 JOIN players p ON p.player_id = ps.player_id
  JOIN game_teams g ON g.player_id = ps.player_id AND g.season = ps.season AND g.week = ps.week
  WHERE ps.week <= 18 GROUP BY ps.player_id, t.season, p.position, g.team, p.team),
rt AS (SELECT prod_team, season, sum(targets) AS team_targets, sum(carries) AS team_carries
       FROM rs WHERE prod_team IS NOT NULL GROUP BY prod_team, season),
shares AS (
  SELECT rs.player_id, rs.season, rs.position, rs.prod_team, rs.now_team,
    coalesce(rs.targets / nullif(rt.team_targets, 0), 0.0) AS target_share,
    coalesce(rs.carries / nullif(rt.team_carries, 0), 0.0) AS carry_share,
    coalesce(rs.now_team = rs.prod_team, false) AS still_here
  FROM rs LEFT JOIN rt ON rt.prod_team = rs.prod_team AND rt.season = rs.season),
dep AS (SELECT prod_team AS team, season, sum(target_share) AS team_departed_target_share,
          sum(carry_share) AS team_departed_carry_share FROM shares WHERE NOT still_here GROUP BY prod_team, season),
top AS (
  SELECT a.player_id, a.season, coalesce(max(b.target_share), 0.0) AS teammate_top_target_share,
    coalesce(max(b.carry_share), 0.0) AS teammate_top_carry_share
  FROM shares a LEFT JOIN shares b ON b.prod_team = a.prod_team AND b.position = a.position
    AND b.season = a.season AND b.player_id <> a.player_id AND b.still_here
  WHERE a.still_here GROUP BY a.player_id, a.season)"""

ELIG = """elig AS (
  SELECT p.player_id, t.season, p.external_id, p.team, p.position, p.age, p.draft_round, p.draft_pick, p.rookie_season
  FROM players p JOIN tg t ON EXISTS (SELECT 1 FROM player_stats ps WHERE ps.player_id = p.player_id
                                      AND ps.season IN (t.season, t.season - 1))
                           OR p.rookie_season = t.season)"""

EXTRA = f"""extra AS (
  SELECT e.player_id, e.season,
    {_r("coalesce(d.team_departed_target_share, 0.0)", 4)} AS team_departed_target_share,
    {_r("coalesce(d.team_departed_carry_share, 0.0)", 4)} AS team_departed_carry_share,
    {_r("coalesce(x.teammate_top_target_share, 0.0)", 4)} AS teammate_top_target_share,
    {_r("coalesce(x.teammate_top_carry_share, 0.0)", 4)} AS teammate_top_carry_share
  FROM elig e LEFT JOIN dep d ON d.team = e.team AND d.season = e.season
  LEFT JOIN top x ON x.player_id = e.player_id AND x.season = e.season)"""

FEEDS = """snapm AS (
  SELECT t.season, sc.pfr_player_id AS pfr_id, avg(sc.offense_pct) AS share
  FROM snap_counts sc JOIN tg t ON sc.season = t.season - 1 GROUP BY t.season, sc.pfr_player_id),
snapj AS (SELECT b.gsis_id AS external_id, s.season, s.share FROM snapm s JOIN bios b ON b.pfr_id = s.pfr_id),
snaps AS (SELECT external_id, season, CASE WHEN max(share) OVER (PARTITION BY season) > 1.5 THEN share / 100.0
          ELSE share END AS prior_snap_share FROM snapj),
depth AS (SELECT t.season, d.gsis_id AS external_id, least(greatest(arg_max(d.pos_rank, d.dt), 1), 10) AS depth_chart_rank
          FROM tg t JOIN depth_charts d ON d.dt < make_date(t.season, 9, 1)
          WHERE d.pos_rank IS NOT NULL GROUP BY t.season, d.gsis_id)"""

CONTEXT_SELECT = """
SELECT e.player_id, e.season, e.team,
  CAST(coalesce(u.prior_games, 0) AS BIGINT) AS prior_games,
  CAST(coalesce(u.prior_points_per_game, 0.0) AS DOUBLE) AS prior_points_per_game,
  CAST(coalesce(u.prior_targets_per_game, 0.0) AS DOUBLE) AS prior_targets_per_game,
  CAST(coalesce(u.prior_yards_per_game, 0.0) AS DOUBLE) AS prior_yards_per_game,
  CAST(coalesce(u.prior_target_share, 0.0) AS DOUBLE) AS prior_target_share,
  CAST(coalesce(u.prior_carries_per_game, 0.0) AS DOUBLE) AS prior_carries_per_game,
  CAST(coalesce(u.prior_carry_share, 0.0) AS DOUBLE) AS prior_carry_share,
  CAST(coalesce(u.prior_last4_points_per_game, 0.0) AS DOUBLE) AS prior_last4_points_per_game,
  sn.prior_snap_share, CAST(dp.depth_chart_rank AS INTEGER) AS depth_chart_rank,
  CAST(coalesce(e.draft_round, b.draft_round) AS INTEGER) AS draft_round,
  CAST(coalesce(e.draft_pick, b.draft_pick) AS INTEGER) AS draft_pick,
  CAST(coalesce(e.rookie_season, b.rookie_season) AS INTEGER) AS rookie_season,
  CAST(b.years_of_experience AS INTEGER) AS years_experience,
  coalesce(coalesce(e.rookie_season, b.rookie_season) = e.season, coalesce(u.prior_games, 0) = 0) AS is_rookie,
  CAST(e.age AS DOUBLE) AS age,
  CAST(coalesce(s.team_pass_attempts_prior, 0.0) AS DOUBLE) AS team_pass_attempts_prior,
  CAST(coalesce(u.team_points_prior, 0.0) AS DOUBLE) AS team_points_prior,
  coalesce(s.qb_changed, false) AS qb_changed,
  CAST(coalesce(c.career_weighted_ppg, 0.0) AS DOUBLE) AS career_weighted_ppg,
  CAST(coalesce(c.career_weighted_targets_per_game, 0.0) AS DOUBLE) AS career_weighted_targets_per_game,
  CAST(coalesce(c.career_weighted_carries_per_game, 0.0) AS DOUBLE) AS career_weighted_carries_per_game,
  CAST(coalesce(cs.career_weighted_target_share, 0.0) AS DOUBLE) AS career_weighted_target_share,
  CAST(coalesce(c.career_best_ppg, 0.0) AS DOUBLE) AS career_best_ppg,
  CAST(coalesce(c.career_seasons, 0) AS BIGINT) AS career_seasons,
  CAST(coalesce(c.career_games, 0) AS BIGINT) AS career_games,
  CAST(coalesce(f.prior_points_per_target, 0.0) AS DOUBLE) AS prior_points_per_target,
  CAST(coalesce(c.career_points_per_target, 0.0) AS DOUBLE) AS career_points_per_target,
  CAST(coalesce(f.efficiency_delta, 0.0) AS DOUBLE) AS efficiency_delta,
  CAST(coalesce(x.team_departed_target_share, 0.0) AS DOUBLE) AS team_departed_target_share,
  CAST(coalesce(x.team_departed_carry_share, 0.0) AS DOUBLE) AS team_departed_carry_share,
  CAST(coalesce(x.teammate_top_target_share, 0.0) AS DOUBLE) AS teammate_top_target_share,
  CAST(coalesce(x.teammate_top_carry_share, 0.0) AS DOUBLE) AS teammate_top_carry_share
FROM elig e
LEFT JOIN usage u ON u.player_id = e.player_id AND u.season = e.season
LEFT JOIN situation s ON s.team = e.team AND s.season = e.season
LEFT JOIN career c ON c.player_id = e.player_id AND c.season = e.season
LEFT JOIN cshare cs ON cs.player_id = e.player_id AND cs.season = e.season
LEFT JOIN eff f ON f.player_id = e.player_id AND f.season = e.season
LEFT JOIN extra x ON x.player_id = e.player_id AND x.season = e.season
LEFT JOIN snaps sn ON sn.external_id = e.external_id AND sn.season = e.season
LEFT JOIN depth dp ON dp.external_id = e.external_id AND dp.season = e.season
LEFT JOIN bios b ON b.gsis_id = e.external_id"""

CONTEXT_SQL = (f"WITH {TG},\n{PROD},\n{QB},\n{CAREER},\n{SHARES},\n{ELIG},\n{EXTRA},\n{FEEDS}\n"
               f"{CONTEXT_SELECT}")
CONTEXT_DOUBLES = (
    "prior_points_per_game", "prior_targets_per_game", "prior_yards_per_game", "prior_target_share",
    "prior_carries_per_game", "prior_carry_share", "prior_last4_points_per_game", "prior_snap_share", "age",
    "team_pass_attempts_prior", "team_points_prior", "career_weighted_ppg", "career_weighted_targets_per_game",
    "career_weighted_carries_per_game", "career_weighted_target_share", "career_best_ppg",
    "prior_points_per_target", "career_points_per_target", "efficiency_delta", "team_departed_target_share",
    "team_departed_carry_share", "teammate_top_target_share", "teammate_top_carry_share")


def _volumes(t):
    """Volume by the team of the game, stored once like the other season tables."""
    return t.stored("team_volumes", lambda: P.team_volumes(t.player_stats, t.game_teams),
                    sources=("lineitem", "supplier"))


def build_context(t):
    return P.build_context(t.player_stats, t.players, _targets(t), snaps=t.snap_counts, volumes=_volumes(t),
                           bios=R.read_bios(t.bios), depth=R.depth_versions(t.depth_charts), ps=_ps(t))


def context_table(t):
    """The stored player_context table (built by P19 once, read by scoring,
    boards and training), as the weekly job persists it."""
    built = t.stored("player_context", lambda: build_context(t),
                     sources=("lineitem", "supplier", "events"))
    cols = [c for c in P.CONTEXT_COLUMNS]
    return built.select(*[F.col(c).cast("int").alias(c) if c == "season" else F.col(c) for c in cols])


# ---------------------------------------------------------------- queries
@register("p22_build_all_seasons", sql=f"WITH {TG} SELECT season FROM tg")
def q_targets(t):
    return P.target_seasons(t.player_stats)


@register("p1_prior_production", doubles=(
    "prior_points_per_game", "prior_targets_per_game", "prior_carries_per_game", "prior_yards_per_game",
    "prior_last4_points_per_game"), sql=f"WITH {TG},\n{PROD}\nSELECT * FROM production")
def q_prior_production(t):
    return P.prior_production(_ps(t), t.players, _targets(t))


@register("p2_last4_form", doubles=("prior_last4_points_per_game",), sql=f"""
WITH {TG},\n{PROD}
SELECT player_id, season, prior_last4_points_per_game FROM production""")
def q_last4(t):
    return P.last4_form(_ps(t), _targets(t))


@register("p3_team_totals", doubles=("team_points",), sql=f"WITH {TG},\n{PROD}\nSELECT * FROM team_prior")
def q_team_totals(t):
    return P.team_totals(_ps(t), t.players, _targets(t))


@register("p4_usage_share", doubles=(
    "prior_points_per_game", "prior_targets_per_game", "prior_carries_per_game", "prior_yards_per_game",
    "prior_last4_points_per_game", "prior_target_share", "prior_carry_share", "team_points_prior"),
    sql=f"WITH {TG},\n{PROD}\nSELECT * FROM usage")
def q_usage_share(t):
    tg = _targets(t)
    return P.usage_share(P.prior_production(_ps(t), t.players, tg),
                         P.team_totals(_ps(t), t.players, tg))


@register("p5_primary_qb", sql=f"WITH {TG},\n{QB}\nSELECT * FROM prim1")
def q_primary_qb(t):
    return P.primary_qb(P.qb_yardage(_ps(t), t.players, _targets(t), 1))


@register("p6_team_volume", doubles=("team_pass_attempts_prior",), sql=f"WITH {TG},\n{QB}\nSELECT * FROM vol")
def q_team_volume(t):
    return P.team_volume(P.qb_yardage(_ps(t), t.players, _targets(t), 1))


@register("p7_qb_changed", doubles=("team_pass_attempts_prior",), sql=f"WITH {TG},\n{QB}\nSELECT * FROM situation")
def q_qb_changed(t):
    return P.team_situation(_ps(t), t.players, _targets(t))


@register("p8_season_history", doubles=("ppg", "targets_per_game", "carries_per_game", "points"), sql=f"""
WITH {CAREER.split('),', 1)[0]})
SELECT player_id, season, games, ppg, targets_per_game, carries_per_game, CAST(targets AS BIGINT) AS targets,
       CAST(carries AS BIGINT) AS carries, points FROM hist""")
def q_season_history(t):
    return P.season_history(_ps(t))


@register("p9_age_multiplier", doubles=("age", "age_multiplier"), sql=f"""
SELECT player_id, season, age, {_mult('age')} AS age_multiplier FROM rosters""")
def q_age_multiplier(t):
    return t.rosters.select("player_id", "season", "age", age_multiplier("age").alias("age_multiplier"))


@register("p10_age_factor", doubles=("age_factor",), sql=f"""
WITH {TG},\n{CAREER}
SELECT player_id, season, played_season, seasons_ago, age_factor FROM hw""")
def q_age_factor(t):
    h = P.history_for_targets(P.season_history(_ps(t)), _targets(t), t.players)
    return h.select("player_id", "season", "played_season", "seasons_ago", "age_factor")


@register("p11_season_weight", doubles=("weight",), sql=f"""
WITH {TG},\n{CAREER}
SELECT player_id, season, played_season, games, weight FROM hw""")
def q_season_weight(t):
    h = P.history_for_targets(P.season_history(_ps(t)), _targets(t), t.players)
    return h.select("player_id", "season", "played_season", "games", "weight")


@register("p12_career_aggregate", doubles=(
    "career_weighted_ppg", "career_weighted_targets_per_game", "career_weighted_carries_per_game",
    "career_best_ppg", "career_points_per_target"), sql=f"WITH {TG},\n{CAREER}\nSELECT * FROM career")
def q_career(t):
    h = P.history_for_targets(P.season_history(_ps(t)), _targets(t), t.players)
    return P.career_aggregate(h)


@register("p13_career_target_share", doubles=("career_weighted_target_share",),
          sql=f"WITH {TG},\n{CAREER}\nSELECT * FROM cshare")
def q_career_share(t):
    h = P.history_for_targets(P.season_history(_ps(t)), _targets(t), t.players)
    return P.career_target_share(h, P.team_totals(_ps(t), t.players))


@register("p14_efficiency_delta", doubles=("prior_points_per_target", "efficiency_delta"),
          sql=f"WITH {TG},\n{CAREER}\nSELECT * FROM eff")
def q_efficiency(t):
    tg = _targets(t)
    return P.efficiency_delta(_ps(t), tg, P.build_career(_ps(t), t.players, tg))


@register("p15_roster_shares", doubles=("target_share", "carry_share"), sql=f"""
WITH {TG},\n{SHARES}
SELECT player_id, season, position, prod_team, now_team, target_share, carry_share, still_here FROM shares""")
def q_roster_shares(t):
    return P.roster_shares(_ps(t), t.players, _targets(t), volumes=_volumes(t))


@register("p15_team_stints", sql="""
WITH moves AS (SELECT *, CASE WHEN team IS DISTINCT FROM lag(team) OVER w THEN 1 ELSE 0 END AS moved
  FROM game_teams WINDOW w AS (PARTITION BY player_id ORDER BY season, week)),
spells AS (SELECT *, sum(moved) OVER (PARTITION BY player_id ORDER BY season, week) AS stint FROM moves)
SELECT player_id, CAST(stint AS INTEGER) AS stint, team, CAST(min(season * 100 + week) // 100 AS INTEGER) AS first_season,
  CAST(min(season * 100 + week) % 100 AS INTEGER) AS first_week, CAST(max(season * 100 + week) // 100 AS INTEGER) AS last_season,
  CAST(max(season * 100 + week) % 100 AS INTEGER) AS last_week, count(*) AS games
FROM spells GROUP BY player_id, stint, team""")
def q_team_stints(t):
    return P.team_stints(t.game_teams)


@register("p16_departed_share", doubles=("team_departed_target_share", "team_departed_carry_share"),
          sql=f"WITH {TG},\n{SHARES}\nSELECT * FROM dep")
def q_departed(t):
    return P.departed_share(P.roster_shares(_ps(t), t.players, _targets(t), volumes=_volumes(t)))


@register("p17_top_teammate_share", doubles=("teammate_top_target_share", "teammate_top_carry_share"),
          sql=f"WITH {TG},\n{SHARES}\nSELECT * FROM top")
def q_top_teammate(t):
    return P.top_teammate_share(P.roster_shares(_ps(t), t.players, _targets(t), volumes=_volumes(t)))


@register("p18_eligible_players", sql=f"WITH {TG},\n{ELIG}\nSELECT * FROM elig")
def q_eligible(t):
    return P.eligible_players(_ps(t), t.players, _targets(t))


@register("p18_eligible_as_of", sql=f"""
WITH {TG},\n{ELIG},
known AS (SELECT e.player_id, e.season, arg_max(r.team, r.season) AS team
  FROM elig e JOIN season_rosters r ON r.external_id = e.external_id AND r.season <= e.season GROUP BY e.player_id, e.season)
SELECT e.* REPLACE (coalesce(k.team, e.team) AS team,
  CAST(CASE WHEN k.team IS NULL THEN e.age ELSE e.age - 2002 + e.season END AS INTEGER) AS age)
FROM elig e LEFT JOIN known k ON k.player_id = e.player_id AND k.season = e.season""")
def q_eligible_as_of(t):
    return P.eligible_players(_ps(t), t.players, _targets(t), roster_versions(t.season_rosters))


@register("p19_context_assembly", doubles=CONTEXT_DOUBLES, sql=CONTEXT_SQL)
def q_context(t):
    return build_context(t)


@register("p20_context_defaults", doubles=("prior_points_per_game", "career_weighted_ppg"), sql=f"""
SELECT player_id, season, prior_games, prior_points_per_game, career_seasons, career_weighted_ppg, qb_changed,
       prior_snap_share IS NULL AS snap_missing, depth_chart_rank IS NULL AS depth_missing
FROM ({CONTEXT_SQL}) c""")
def q_context_defaults(t):
    c = context_table(t)
    return c.select("player_id", "season", "prior_games", "prior_points_per_game", "career_seasons",
                    "career_weighted_ppg", "qb_changed",
                    F.col("prior_snap_share").isNull().alias("snap_missing"),
                    F.col("depth_chart_rank").isNull().alias("depth_missing"))


@register("p21_rookie_flag", sql=f"""
SELECT player_id, season, rookie_season, prior_games, is_rookie FROM ({CONTEXT_SQL}) c""")
def q_rookie_flag(t):
    return context_table(t).select("player_id", "season", "rookie_season", "prior_games", "is_rookie")


@register("p23_next_period", sql="""
SELECT CAST((SELECT max(season) FROM player_stats) AS INTEGER) AS season,
  CAST(least(coalesce((SELECT max(week) FROM player_stats WHERE week <= 18
                       AND season = (SELECT max(season) FROM player_stats)), 0) + 1, 18) AS INTEGER) AS next_week,
  CAST((SELECT max(season) FROM player_stats) + 1 AS INTEGER) AS next_season""")
def q_next_period(t):
    return P.next_period(t.player_stats)
