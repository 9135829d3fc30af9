"""Pre-season context features.

Every operator works for a *set* of target seasons at once (a small frame
with one column ``season``), so the whole multi-season build (P22) is one
job, not a driver loop. Target seasons are joined by equality: prior-season
inputs are re-keyed with ``season + 1``; career history fans each
(player, season) aggregate out to the later target seasons with
``explode(sequence(...))`` before an equi-join, so no inequality or cross
join is planned. Group-level tables (team x season, team x position x
season) are bounded by the league's team count and broadcast; everything
player-level stays shuffled on (player_id, season).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.functions.columns import (
    age_factor, clip, round_half_even, safe_ratio, season_weight,
)
from fieldcast.operators.dimensions import as_of
from fieldcast.session import cut_lineage

MAX_WEEK = S.REGULAR_SEASON_WEEKS
Targets = "list[int] | DataFrame"   # target seasons: a literal list (preferred) or a frame


# ------------------------------------------------------------------ targets
def target_seasons(stats: DataFrame) -> DataFrame:
    """Seasons with data except the first, plus the next one (max + 1)."""
    seasons = stats.select("season").distinct()
    first = stats.select(F.min("season")).scalar()
    last = stats.select(F.max("season")).scalar()
    return seasons.where(F.col("season") > first).unionByName(
        stats.sparkSession.range(1).select((last + 1).cast("int").alias("season"))).distinct()


def target_season_list(stats: DataFrame) -> list[int]:
    """P22 resolved on the driver: a handful of season numbers (one tiny
    aggregate), so later plans carry the targets as a literal relation."""
    return sorted(r[0] for r in target_seasons(stats).collect())


def as_targets(stats: DataFrame, seasons) -> DataFrame:
    """Normalise an int / list / frame of target seasons to a one-column frame."""
    if isinstance(seasons, DataFrame):
        return seasons.select(F.col("season").cast("int").alias("season"))
    if isinstance(seasons, int):
        seasons = [seasons]
    return stats.sparkSession.createDataFrame([(int(s),) for s in seasons], "season int")


def player_seasons(stats: DataFrame, max_week: int = MAX_WEEK) -> DataFrame:
    """The one base aggregate every pre-season operator derives from.

    One row per (player, season): regular-season (week <= max_week) counts,
    sums and means via filtered aggregates, last-4 form via a row_number on
    the same (player_id, season) partitioning (so window and aggregate share
    one shuffle), and ``games_all`` over every week for eligibility.
    """
    reg = F.col("week") <= max_week
    w = Window.partitionBy("player_id", "season").orderBy(reg.desc(), F.col("week").desc())
    rows = stats.withColumn("_reg", reg).withColumn("_rn", F.row_number().over(w))
    r = F.col("_reg")
    return rows.groupBy("player_id", "season").agg(
        F.count(F.lit(1)).alias("games_all"),
        F.count_if(r).alias("games"),
        F.avg(F.when(r, F.col("fantasy_points"))).alias("ppg"),
        F.avg(F.when(r, F.col("targets"))).alias("targets_per_game"),
        F.avg(F.when(r, F.col("carries"))).alias("carries_per_game"),
        F.avg(F.when(r, F.col("yards"))).alias("yards_per_game"),
        F.sum(F.when(r, F.col("targets"))).alias("targets"),
        F.sum(F.when(r, F.col("carries"))).alias("carries"),
        F.sum(F.when(r, F.col("yards"))).alias("yards"),
        F.sum(F.when(r, F.col("fantasy_points"))).alias("points"),
        F.avg(F.when(r & (F.col("_rn") <= 4), F.col("fantasy_points"))).alias("last4_ppg"),
    )


DIM_COLS = ("external_id", "position", "team", "age")


def with_player_dims(ps: DataFrame, players: DataFrame) -> DataFrame:
    """Attach the player dimension once (left join, `_known` marks matches) so
    the operators below need no further joins to it."""
    dims = players.select("player_id", *DIM_COLS, F.lit(True).alias("_known"))
    return ps.join(dims, "player_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))


def _dims(ps: DataFrame, players: DataFrame) -> DataFrame:
    """Player-seasons restricted to known players, with dimension columns."""
    if "_known" not in ps.columns:
        ps = with_player_dims(ps, players)
    return ps.where(F.col("_known"))


def _keep_targets(df: DataFrame, targets, col: str = "season") -> DataFrame:
    """Keep rows whose `col` is a target season: an IN-list filter for a
    literal list (no join at all), else an equi-join on a broadcast frame."""
    if isinstance(targets, (list, tuple)):
        return df.where(F.col(col).isin([int(x) for x in targets]))
    return df.join(F.broadcast(targets.select(F.col("season").alias(col))), col)


def _last_target(targets):
    if isinstance(targets, (list, tuple)):
        return F.lit(max(int(x) for x in targets))
    return targets.select(F.max("season")).scalar()


def _prior(ps: DataFrame, targets, lag: int = 1) -> DataFrame:
    """Player-seasons of S - lag with regular-season games, re-keyed to target
    season S."""
    s = ps.where(F.col("games") > 0).withColumn("season", (F.col("season") + lag).cast("int"))
    return _keep_targets(s, targets)


# ------------------------------------------------------------------ P1-P4
def prior_production(ps: DataFrame, players: DataFrame, targets: Targets) -> DataFrame:
    """P1 + P2: prior-season games, per-game means, totals and last-4 form."""
    rows = _prior(_dims(ps, players), targets)
    return rows.select(
        "player_id", "season", "external_id", F.col("team").alias("current_team"),
        F.col("games").alias("prior_games"),
        F.col("ppg").alias("prior_points_per_game"),
        F.col("targets_per_game").alias("prior_targets_per_game"),
        F.col("carries_per_game").alias("prior_carries_per_game"),
        F.col("yards_per_game").alias("prior_yards_per_game"),
        F.col("targets").alias("prior_targets_total"),
        F.col("carries").alias("prior_carries_total"),
        F.col("last4_ppg").alias("prior_last4_points_per_game"),
    )


def last4_form(ps: DataFrame, targets: Targets) -> DataFrame:
    """P2 alone: mean points over the last 4 regular-season games of S - 1."""
    return _prior(ps, targets).select("player_id", "season",
                                      F.col("last4_ppg").alias("prior_last4_points_per_game"))


def team_totals(ps: DataFrame, players: DataFrame, targets: Targets | None = None,
                lag: int = 1) -> DataFrame:
    """Team targets / carries / points by the players' current team.

    With `targets`: the prior season re-keyed to each target season.
    Without: every season (used by the career share, P13). Team x season rows.
    """
    d = _dims(ps, players)
    base = _prior(d, targets, lag) if targets is not None else d.where(F.col("games") > 0)
    j = base.where(F.col("team").isNotNull())
    return j.groupBy("team", "season").agg(
        F.sum("targets").alias("team_targets"), F.sum("carries").alias("team_carries"),
        F.sum("points").alias("team_points"))


def usage_share(production: DataFrame, teams: DataFrame) -> DataFrame:
    """Share of team targets / carries, 0 for a zero or missing
    denominator, clipped to 0..1. Team totals are team x season rows."""
    t = teams.withColumnRenamed("team", "current_team")
    j = production.join(F.broadcast(t), ["current_team", "season"], "left")
    share = lambda n, d: clip(F.coalesce(safe_ratio(n, d), F.lit(0.0)), 0, 1)
    return j.select(
        *[c for c in production.columns if c not in ("prior_targets_total", "prior_carries_total")],
        share("prior_targets_total", "team_targets").alias("prior_target_share"),
        share("prior_carries_total", "team_carries").alias("prior_carry_share"),
        F.coalesce(F.col("team_points"), F.lit(0.0)).alias("team_points_prior"),
    )


# ------------------------------------------------------------------ P5-P7
def qb_yardage(ps: DataFrame, players: DataFrame, targets: Targets, lag: int) -> DataFrame:
    """Per (team, QB) yardage in season S - lag, keyed by target S."""
    qbs = _dims(ps, players).where((F.col("position") == "QB") & F.col("team").isNotNull()) \
        .withColumn("qb_id", F.col("external_id"))
    return _prior(qbs, targets, lag).groupBy("team", "season", "qb_id").agg(
        F.sum("yards").alias("pass_yards"), F.sum("games").alias("games"))


def primary_qb(qb_rows: DataFrame) -> DataFrame:
    """P5: per team the QB with most yardage (ties: smallest id). The window
    partition is one team's QBs."""
    w = Window.partitionBy("team", "season").orderBy(F.col("pass_yards").desc(), "qb_id")
    return qb_rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1) \
        .select("team", "season", "qb_id")


def team_volume(qb_rows: DataFrame) -> DataFrame:
    """QB yardage summed per team (named team_pass_attempts_prior, D12)."""
    return qb_rows.groupBy("team", "season").agg(F.sum("pass_yards").alias("team_pass_attempts_prior"))


def team_situation(ps: DataFrame, players: DataFrame, targets: Targets) -> DataFrame:
    """Volume and whether the primary QB changed between S-1 and S-2.

    Unknown previous QB is not a change. Teams without QB rows in S-1 are absent.
    """
    prior = qb_yardage(ps, players, targets, 1)
    now = primary_qb(prior)
    before = primary_qb(qb_yardage(ps, players, targets, 2)).withColumnRenamed("qb_id", "prev_qb")
    m = team_volume(prior).join(now, ["team", "season"], "left").join(before, ["team", "season"], "left")
    changed = F.col("prev_qb").isNotNull() & F.coalesce(F.col("qb_id") != F.col("prev_qb"), F.lit(True))
    return m.select("team", "season", "team_pass_attempts_prior", changed.alias("qb_changed"))


# ------------------------------------------------------------------ P8-P14
def season_history(ps: DataFrame, min_games: int = S.MIN_GAMES_FOR_RATE) -> DataFrame:
    """Per (player, season) aggregates of seasons with >= min_games games."""
    extra = [c for c in (*DIM_COLS, "_known") if c in ps.columns]
    return ps.where(F.col("games") >= min_games).select(
        "player_id", "season", "games", "ppg", "targets_per_game", "carries_per_game",
        "targets", "carries", "points", *extra)


def history_for_targets(history: DataFrame, targets: Targets, players: DataFrame,
                        recency_base: int = 0) -> DataFrame:
    """Fan each past season out to every later target season (equi-join),
    with seasons_ago, P10 age factor and P11 weight attached. The fan-out is
    bounded by the number of target seasons (tens)."""
    last_target = _last_target(targets)
    if "_known" not in history.columns:
        history = history.join(players.select("player_id", "age", "team"), "player_id", "left")
    fanned = history.where(F.col("season") < last_target) \
        .withColumn("played_season", F.col("season")).withColumn(
            "season", F.explode(F.sequence(F.col("played_season") + 1, last_target.cast("int"))))
    h = _keep_targets(fanned, targets)
    ago = F.col("season") - F.col("played_season")
    return h.withColumns({
        "seasons_ago": ago,
        "age_factor": age_factor(F.col("age"), ago),
        "weight": season_weight(ago, F.col("games"), recency_base),
    })


def _wavg(value: Column, weight: str = "weight") -> Column:
    """np.average semantics: sum(v*w)/sum(w); 0 when the weights sum to 0."""
    num = F.sum(F.coalesce(value, F.lit(0.0)) * F.col(weight))
    den = F.sum(F.col(weight))
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def career_aggregate(hist: DataFrame) -> DataFrame:
    """Weighted means, best season, seasons, games, points per target."""
    return hist.groupBy("player_id", "season").agg(*_career_columns())


def _career_columns() -> list[Column]:
    tot_t = F.sum("targets")
    return [
        round_half_even(_wavg(F.col("ppg") * F.col("age_factor")), 3).alias("career_weighted_ppg"),
        round_half_even(_wavg(F.col("targets_per_game")), 3).alias("career_weighted_targets_per_game"),
        round_half_even(_wavg(F.col("carries_per_game")), 3).alias("career_weighted_carries_per_game"),
        round_half_even(F.max("ppg"), 3).alias("career_best_ppg"),
        F.count(F.lit(1)).alias("career_seasons"),
        F.sum("games").alias("career_games"),
        round_half_even(F.when(tot_t > 0, F.sum("points") / tot_t).otherwise(F.lit(0.0)), 4)
        .alias("career_points_per_target"),
    ]


def career_target_share(hist: DataFrame, all_team_totals: DataFrame) -> DataFrame:
    """Weighted mean of per-season target share (clipped 0..1)."""
    return _with_team_targets(hist, all_team_totals).groupBy("player_id", "season").agg(
        _career_share().alias("career_weighted_target_share"))


def _with_team_targets(hist: DataFrame, all_team_totals: DataFrame) -> DataFrame:
    t = all_team_totals.select("team", F.col("season").alias("played_season"), "team_targets")
    return hist.join(F.broadcast(t), ["team", "played_season"], "left")


def _career_share() -> Column:
    share = clip(F.coalesce(safe_ratio("targets", "team_targets"), F.lit(0.0)), 0, 1)
    num, den = F.sum(share * F.col("weight")), F.sum("weight")
    return round_half_even(F.coalesce(safe_ratio(num, den), F.lit(0.0)), 4)


def build_career(ps: DataFrame, players: DataFrame, targets: Targets,
                 recency_base: int = 0) -> DataFrame:
    """P8-P13 composed: one career row per (player, target season), from one aggregate of the fanned seasons."""
    hist = history_for_targets(season_history(ps), targets, players, recency_base)
    share = F.when(F.col("player_id").isNotNull(), _career_share()).otherwise(F.lit(0.0))
    return _with_team_targets(hist, team_totals(ps, players)).groupBy("player_id", "season").agg(
        *_career_columns(), share.alias("career_weighted_target_share"))


def efficiency_delta(ps: DataFrame, targets: Targets, career: DataFrame) -> DataFrame:
    """Prior points per target and its gap to the career rate (4 dp)."""
    prior = _prior(ps, targets).select("player_id", "season", "points", "targets")
    ppt = F.coalesce(safe_ratio("points", "targets"), F.lit(0.0))
    j = prior.join(career.select("player_id", "season", "career_points_per_target"),
                   ["player_id", "season"], "left")
    return j.select(
        "player_id", "season",
        round_half_even(ppt, 4).alias("prior_points_per_target"),
        round_half_even(ppt - F.coalesce(F.col("career_points_per_target"), F.lit(0.0)), 4)
        .alias("efficiency_delta"),
    )


# ------------------------------------------------------------------ P15-P17
def team_stints(game_teams: DataFrame) -> DataFrame:
    """Spells of a player with one team, from the team of each game.

    Gaps and islands along (season, week): a spell ends where the next game is
    for another team, so a player who returns has two spells with that team.
    One row per spell: first and last game, and games played. The window's
    partition is one player's career. Games without a known team are left out.
    """
    games = game_teams.where(F.col("team").isNotNull()).select("player_id", "season", "week", "team")
    along = Window.partitionBy("player_id").orderBy("season", "week", "team")
    moved = F.coalesce(F.col("team") != F.lag("team").over(along), F.lit(True))
    spells = games.withColumn("_moved", moved.cast("int")) \
        .withColumn("stint", F.sum("_moved").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    first, last = F.min(F.struct("season", "week")), F.max(F.struct("season", "week"))
    return spells.groupBy("player_id", "stint", "team").agg(
        first.alias("_f"), last.alias("_l"), F.count(F.lit(1)).alias("games")) \
        .select("player_id", "stint", "team", F.col("_f.season").alias("first_season"), F.col("_f.week").alias("first_week"),
                F.col("_l.season").alias("last_season"), F.col("_l.week").alias("last_week"), "games")


def team_volumes(stats: DataFrame, game_teams: DataFrame, max_week: int = MAX_WEEK) -> DataFrame:
    """Regular-season volume per (player, season, team of the game).

    Every game counts once, for the team it was played for; repeated rows of a
    game in `game_teams` are one, games without a known team have none. Games and
    their teams meet in one shuffle by (player, season), which holds the few weeks
    of a season, and both aggregates run behind it.
    """
    keys = ["player_id", "season", "week"]
    early = F.col("week") <= max_week
    games = stats.where(early).select(*keys, F.lit(1).cast("long").alias("games"), "targets", "carries")
    teams = game_teams.where(early).select(*keys, "team")
    met = games.unionByName(teams, allowMissingColumns=True).repartition("player_id", "season")
    # the team of a game; a game without player or season has none
    known = F.col("player_id").isNotNull() & F.col("season").isNotNull()
    by_game = met.groupBy(*keys).agg(
        F.sum("games").alias("games"), F.sum("targets").alias("targets"), F.sum("carries").alias("carries"),
        F.min("team").alias("team")).where(F.col("games").isNotNull()).withColumn("team", F.when(known, F.col("team")))
    return by_game.groupBy("player_id", "season", "team").agg(
        F.sum("games").alias("games"), F.sum("targets").alias("targets"), F.sum("carries").alias("carries"))


def roster_shares(ps: DataFrame, players: DataFrame, targets: Targets,
                  team_of_record: str = "game", volumes: DataFrame | None = None) -> DataFrame:
    """S-1 target & carry share within the team the volume was produced for.

    ``team_of_record="game"`` needs `volumes` (`team_volumes`): a traded player
    has a row for each team of the season, with the volume produced there.
    ``"current"`` takes the player's current team for all of it (D1: nobody
    ever departs). Team denominators are a groupBy (team x season rows) sent to
    the players rather than a window partitioned by team, which would put a
    whole team in one task.
    """
    if team_of_record not in ("game", "current"):
        raise ValueError(f"unknown team_of_record {team_of_record!r}")
    if team_of_record == "game" and volumes is None:
        raise ValueError('team_of_record="game" needs the volumes by team of the game')
    rows = _prior(_dims(ps, players), targets).withColumn("now_team", F.col("team"))
    if team_of_record == "game":
        per = rows.select("player_id", "season", "position", "now_team").join(
            volumes.select("player_id", (F.col("season") + 1).cast("int").alias("season"),
                           F.col("team").alias("prod_team"), "targets", "carries"), ["player_id", "season"])
    else:
        per = rows.select("player_id", "season", "position", "now_team", F.col("now_team").alias("prod_team"),
                          "targets", "carries")
    team = per.where(F.col("prod_team").isNotNull()).groupBy("prod_team", "season").agg(
        F.sum("targets").alias("team_targets"), F.sum("carries").alias("team_carries"))
    j = per.join(F.broadcast(team), ["prod_team", "season"], "left")
    return j.select(
        "player_id", "season", "position", "prod_team", "now_team",
        F.coalesce(safe_ratio("targets", "team_targets"), F.lit(0.0)).alias("target_share"),
        F.coalesce(safe_ratio("carries", "team_carries"), F.lit(0.0)).alias("carry_share"),
        F.coalesce(F.col("now_team") == F.col("prod_team"), F.lit(False)).alias("still_here"),
    )


def departed_share(shares: DataFrame) -> DataFrame:
    """Team share owned by players no longer on that team."""
    return shares.where(~F.col("still_here") & F.col("prod_team").isNotNull()) \
        .groupBy(F.col("prod_team").alias("team"), "season").agg(
            F.sum("target_share").alias("team_departed_target_share"),
            F.sum("carry_share").alias("team_departed_carry_share"))


def max_of_others(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Largest `value` among the *other* rows of each group (0 when alone).

    Exact and skew-proof: the two largest rows of a group tell it all (equal
    ones count twice), and the top-2 is cut before its shuffle, so neither a
    whole (possibly huge) group nor pairs of its rows come together. The groups
    (two numbers each) are sent to the rows: use it where they do not grow with rows.
    """
    w = Window.partitionBy(*group).orderBy(F.col(value).desc_nulls_last())
    top = df.select(*group, value).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    best = top.groupBy(*group).agg(F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("_m1"),
                                   F.max(F.when(F.col("_rn") == 2, F.col(value))).alias("_m2"))
    other = F.when(F.col(value) < F.col("_m1"), F.col("_m1")).otherwise(F.coalesce(F.col("_m2"), F.lit(0.0)))
    return df.join(F.broadcast(best), group).withColumn(out, other).drop("_m1", "_m2")


def top_teammate_share(shares: DataFrame) -> DataFrame:
    """Strongest remaining teammate at the same position (targets and
    carries independently), among players still on the team."""
    staying = shares.where(F.col("still_here"))
    grp = ["prod_team", "position", "season"]
    t = max_of_others(staying, grp, "target_share", "teammate_top_target_share")
    c = max_of_others(t, grp, "carry_share", "teammate_top_carry_share")
    return c.select("player_id", "season", "teammate_top_target_share", "teammate_top_carry_share")


def build_situation(ps: DataFrame, players: DataFrame, targets: Targets,
                    roster: DataFrame, team_of_record: str = "game",
                    volumes: DataFrame | None = None) -> DataFrame:
    """P15-P17 expanded onto roster keys (player_id, season, team), 4 dp, nulls -> 0."""
    shares = cut_lineage(roster_shares(ps, players, targets, team_of_record, volumes))   # read three times
    out = roster.select("player_id", "season", "team").join(
        F.broadcast(departed_share(shares)), ["team", "season"], "left") \
        .join(top_teammate_share(shares), ["player_id", "season"], "left")
    cols = ("team_departed_target_share", "team_departed_carry_share",
            "teammate_top_target_share", "teammate_top_carry_share")
    return out.select("player_id", "season", *[
        round_half_even(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(c) for c in cols])


# ------------------------------------------------------------------ P18-P21
def eligible_players(ps: DataFrame, players: DataFrame, targets: Targets,
                     rosters: DataFrame | None = None) -> DataFrame:
    """Played in S or S-1, or rookie_season = S (one row per player, S).

    Team, position and age are today's (D11) unless `rosters` has versions of
    them (`dimensions.roster_versions`): then they are those known in S, and
    today's only for a player without a roster row up to S.
    """
    played = ps.select("player_id", "season")
    cand = _keep_targets(played.select("player_id", F.explode(
        F.array(F.col("season"), F.col("season") + 1)).alias("season")), targets)
    rookies = _keep_targets(players.select("player_id", F.col("rookie_season").alias("season")), targets)
    keys = cand.unionByName(rookies).distinct()
    now = keys.join(players.select("player_id", "external_id", "team", "position", "age",
                                   "draft_round", "draft_pick", "rookie_season"), "player_id")
    if rosters is None:
        return now
    known = rosters.withColumnsRenamed({"team": "_team", "position": "_position", "born": "_born"})
    return as_of(now, known, ["external_id"]).withColumns({
        "team": F.coalesce("_team", "team"), "position": F.coalesce("_position", "position"),
        "age": F.coalesce(F.col("season") - F.col("_born"), "age").cast(now.schema["age"].dataType),
    }).drop("_team", "_position", "_born")


def snap_feed(snaps: DataFrame, crosswalk: DataFrame, targets: Targets) -> DataFrame:
    """S10 per target season: prior-season snap share keyed by external_id.

    The percent-or-fraction rescale is decided per season from that season's
    maximum (a seasons-sized aggregate).
    """
    s = _keep_targets(snaps.withColumn("season", (F.col("season") + 1).cast("int")), targets)
    means = s.groupBy("season", F.col("pfr_player_id").alias("pfr_id")).agg(F.avg("offense_pct").alias("share"))
    j = means.join(crosswalk.select("external_id", "pfr_id"), "pfr_id")
    top = j.groupBy("season").agg(F.max("share").alias("_top"))
    return j.join(F.broadcast(top), "season").select(
        "external_id", "season",
        F.when(F.col("_top") > 1.5, F.col("share") / 100.0).otherwise(F.col("share")).alias("prior_snap_share"))


def context_assembly(eligible: DataFrame, production: DataFrame, situation: DataFrame,
                     career: DataFrame, efficiency: DataFrame, extra: DataFrame,
                     snaps: DataFrame | None = None, depth: DataFrame | None = None,
                     bios: DataFrame | None = None) -> DataFrame:
    """Left joins onto the eligible roster. Player-level frames share the
    (player_id, season) key; team-level situation is broadcast. The feeds, keyed by
    external_id, come first, while a row is narrow. `depth` with a validity range
    (`readers.depth_versions`) gives the rank known before each season."""
    df = eligible
    if snaps is not None:
        df = df.join(snaps, ["external_id", "season"], "left")
    else:
        df = df.withColumn("prior_snap_share", F.lit(None).cast("double"))
    if depth is not None and "valid_from" in depth.columns:
        df = as_of(df, depth, ["external_id"])
    elif depth is not None:
        on = ["external_id", "season"] if "season" in depth.columns else ["external_id"]
        df = df.join(depth.select(*on, "depth_chart_rank"), on, "left")
    else:
        df = df.withColumn("depth_chart_rank", F.lit(None).cast("int"))
    if bios is not None:
        b = bios.select("external_id", F.col("draft_round").alias("_b_round"),
                        F.col("draft_pick").alias("_b_pick"), F.col("rookie_season").alias("_b_rookie"),
                        F.col("years_of_experience").alias("years_experience"))
        # D3: roster values first, bio values fill the gaps.
        df = df.join(b, "external_id", "left").withColumns({
            "draft_round": F.coalesce(F.col("draft_round"), F.col("_b_round")),
            "draft_pick": F.coalesce(F.col("draft_pick"), F.col("_b_pick")),
            "rookie_season": F.coalesce(F.col("rookie_season"), F.col("_b_rookie")),
        }).drop("_b_round", "_b_pick", "_b_rookie")
    else:
        df = df.withColumn("years_experience", F.lit(None).cast("int"))
    return df.join(production.drop("external_id", "current_team"), ["player_id", "season"], "left") \
        .join(career, ["player_id", "season"], "left") \
        .join(efficiency, ["player_id", "season"], "left") \
        .join(extra, ["player_id", "season"], "left") \
        .join(F.broadcast(situation), ["team", "season"], "left")


def context_defaults(df: DataFrame) -> DataFrame:
    """P20 + P21: numeric defaults, nullable columns kept, qb_changed false,
    rookie flag = coalesce(rookie_season == S, prior_games == 0)."""
    cols = {}
    for c, d in S.CONTEXT_NUMERIC_DEFAULTS.items():
        v = F.col(c) if c in df.columns else F.lit(None)
        typ = "bigint" if isinstance(d, int) else "double"
        cols[c] = F.coalesce(v.cast(typ), F.lit(d).cast(typ))
    cols["qb_changed"] = F.coalesce(F.col("qb_changed"), F.lit(False)) if "qb_changed" in df.columns \
        else F.lit(False)
    out = df.withColumns(cols)
    rookie = F.coalesce(F.col("rookie_season") == F.col("season"), F.col("prior_games") == 0)
    return out.withColumn("is_rookie", rookie)


CONTEXT_COLUMNS = (
    "player_id", "season", "team", "prior_games", "prior_points_per_game", "prior_targets_per_game",
    "prior_yards_per_game", "prior_target_share", "prior_carries_per_game", "prior_carry_share",
    "prior_last4_points_per_game", "prior_snap_share", "depth_chart_rank", "draft_round", "draft_pick",
    "rookie_season", "years_experience", "is_rookie", "age", "team_pass_attempts_prior",
    "team_points_prior", "qb_changed", "career_weighted_ppg", "career_weighted_targets_per_game",
    "career_weighted_carries_per_game", "career_weighted_target_share", "career_best_ppg",
    "career_seasons", "career_games", "prior_points_per_target", "career_points_per_target",
    "efficiency_delta", "team_departed_target_share", "team_departed_carry_share",
    "teammate_top_target_share", "teammate_top_carry_share",
)


def build_context(stats: DataFrame, players: DataFrame, targets: Targets,
                  snaps: DataFrame | None = None, bios: DataFrame | None = None,
                  depth: DataFrame | None = None, recency_base: int = 0,
                  team_of_record: str = "game", volumes: DataFrame | None = None,
                  ps: DataFrame | None = None, rosters: DataFrame | None = None) -> DataFrame:
    """P1-P21 for every target season in one plan: the player_context table.

    The fact is aggregated once to player-seasons; every feature derives from
    that frame (its shuffle is reused across the branches). Pass `ps` (the
    stored `player_seasons` table) to start from a scan of it instead. `rosters`
    (versions) gives the eligible players the team and age of the season (P18).
    Frames that several steps read (roster, shares, career) are stored while the
    plan is built: none is computed twice, and no task holds the sorts of them all.
    """
    ps = with_player_dims(ps if ps is not None else player_seasons(stats), players)
    production = usage_share(prior_production(ps, players, targets),
                             team_totals(ps, players, targets))
    situation = team_situation(ps, players, targets)
    career = cut_lineage(build_career(ps, players, targets, recency_base))
    efficiency = efficiency_delta(ps, targets, career)
    eligible = cut_lineage(eligible_players(ps, players, targets, rosters))
    extra = build_situation(ps, players, targets, eligible, team_of_record, volumes)
    snap = snap_feed(snaps, bios, targets) if snaps is not None and bios is not None else None
    df = context_assembly(eligible, production, situation, career, efficiency, extra, snap, depth, bios)
    df = context_defaults(df)
    return df.select(
        *[F.col(c) for c in CONTEXT_COLUMNS if c not in ("age", "draft_round", "draft_pick",
                                                          "rookie_season", "depth_chart_rank",
                                                          "years_experience")],
        F.col("age").cast("double").alias("age"),
        F.col("draft_round").cast("int").alias("draft_round"),
        F.col("draft_pick").cast("int").alias("draft_pick"),
        F.col("rookie_season").cast("int").alias("rookie_season"),
        F.col("depth_chart_rank").cast("int").alias("depth_chart_rank"),
        F.col("years_experience").cast("int").alias("years_experience"),
    )


# ------------------------------------------------------------------ P23
def next_period(stats: DataFrame, season: int | None = None, max_week: int = MAX_WEEK) -> DataFrame:
    """One row (season, next_week, next_season): season defaults to the
    newest with rows; next week = min(max(week <= 18) + 1, 18); next season =
    newest + 1."""
    newest = stats.select(F.max("season")).scalar()
    s = F.lit(season) if season is not None else newest
    last_week = stats.where((F.col("season") == s) & (F.col("week") <= max_week)) \
        .select(F.coalesce(F.max("week"), F.lit(0))).scalar()
    return stats.sparkSession.range(1).select(
        s.cast("int").alias("season"),
        F.least(last_week + 1, F.lit(max_week)).cast("int").alias("next_week"),
        (newest + 1).cast("int").alias("next_season"))
