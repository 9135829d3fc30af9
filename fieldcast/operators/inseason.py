"""In-season form features (F1-F9): windows and filtered aggregates.

Every window here is partitioned by (entity, period): the fact is unique on
(entity, period, step), so a window partition holds at most one season of
weeks no matter how skewed the entity distribution is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.functions.columns import clip, round_half_even

FORM_STATS = ("targets", "receptions", "yards", "touchdowns", "fantasy_points")


def _window_filter(stats: DataFrame, season: int, week: int, max_week: int | None) -> DataFrame:
    cond = (F.col("season") == season) & (F.col("week") < week)
    if max_week is not None:
        cond = cond & (F.col("week") <= max_week)
    return stats.where(cond)


def recency_rank(stats: DataFrame, season: int, week: int,
                 max_week: int | None = S.REGULAR_SEASON_WEEKS, entity: str = "player_id") -> DataFrame:
    """1 = most recent prior game of the season, strictly before `week`."""
    w = Window.partitionBy(entity).orderBy(F.col("week").desc())
    return _window_filter(stats, season, week, max_week).select(
        entity, "week", *FORM_STATS, F.row_number().over(w).alias("recency"))


def rolling_form(ranked: DataFrame, entity: str = "player_id", last_n: int = 3) -> DataFrame:
    """filtered aggregates over the recency rank."""
    recent = F.col("recency") <= last_n
    aggs = [F.avg(F.when(recent, F.col(c))).alias(f"{c}_last_{last_n}") for c in FORM_STATS]
    aggs += [
        F.max(F.when(F.col("recency") == 1, F.col("fantasy_points"))).alias("fantasy_points_last_1"),
        F.avg("fantasy_points").alias("season_avg_points"),
        F.count(F.lit(1)).alias("games_played"),
    ]
    return ranked.groupBy(entity).agg(*aggs)


def defence_rank(stats: DataFrame, season: int, week: int,
                 max_week: int | None = S.REGULAR_SEASON_WEEKS) -> DataFrame:
    """RANK of opponents by avg points allowed (ties share a rank).

    The un-partitioned window runs after aggregation to one row per opponent,
    i.e. on at most the number of teams.
    """
    allowed = _window_filter(stats, season, week, max_week) \
        .where(F.col("opponent").isNotNull()) \
        .groupBy("opponent").agg(round_half_even(F.avg("fantasy_points"), 9).alias("pts_allowed"))
    return allowed.select("opponent", F.rank().over(
        Window.orderBy(F.col("pts_allowed").desc())).alias("opponent_rank"))


def schedule_sides(schedule: DataFrame) -> DataFrame:
    """A schedule (season, week, home_team, away_team) as one row a team and game: (season, week, team, opponent, is_home)."""
    sides = F.array(F.struct(F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.lit(1).alias("is_home")),
                    F.struct(F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.lit(0).alias("is_home")))
    return schedule.select("season", "week", F.inline(sides)).where("team is not null")


def upcoming_features(players: DataFrame, stats: DataFrame, season: int, week: int,
                      positions=S.FLEX_POSITIONS, max_week: int | None = S.REGULAR_SEASON_WEEKS,
                      opponent_source: str = "own_team", schedule: DataFrame | None = None) -> DataFrame:
    """one fs1 feature row per eligible player for the upcoming week.

    Inner join to form (so rookies / week-1 rows are absent, as in the
    reference), left join to the team-level defence rank (<= team count rows,
    broadcast). `opponent_source="own_team"` reproduces the reference's join of
    the defence rank on the player's own team. "schedule" takes opponent and
    is_home from the `schedule` (D4, D16) and adds the column `opponent`; a
    player whose team has no game that week has no row, and one whose team has
    two (a schedule that is wrong) keeps the first by opponent, home first.
    """
    if opponent_source not in ("own_team", "schedule"):
        raise ValueError(f"opponent_source {opponent_source!r} is neither 'own_team' nor 'schedule'")
    if (opponent_source == "schedule") != (schedule is not None):
        raise ValueError("opponent_source='schedule' and a schedule go together")
    form = rolling_form(recency_rank(stats, season, week, max_week))
    rank = defence_rank(stats, season, week, max_week)
    p = players.where(F.col("position").isin(*positions)).select(
        "player_id", "name", "position", "team")
    joined = p.join(form.where(F.col("games_played") >= 1), "player_id")
    if schedule is None:
        joined = joined.join(F.broadcast(rank), p["team"] == rank["opponent"], "left").drop("opponent") \
            .withColumn("is_home", F.lit(1))
    else:
        games = schedule_sides(schedule.where((F.col("season") == season) & (F.col("week") == week)))
        game = games.groupBy("team").agg(F.min(F.struct("opponent", -F.col("is_home"))).alias("_g")) \
            .select("team", F.col("_g.opponent").alias("opponent"), (-F.col("_g.col2")).alias("is_home"))
        joined = joined.join(game, "team").join(rank, "opponent", "left")
    feats = [F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in (
        "targets_last_3", "receptions_last_3", "yards_last_3", "touchdowns_last_3",
        "fantasy_points_last_3", "fantasy_points_last_1", "season_avg_points")]
    return joined.select(
        "player_id", "name", "position", "team", *feats,
        F.col("games_played").cast("int").alias("games_played"),
        clip(F.coalesce(F.col("opponent_rank"), F.lit(16)), 1, 32).cast("int").alias("opponent_rank"),
        "is_home", *(["opponent"] if schedule is not None else []))


def training_windows(stats: DataFrame, players: DataFrame) -> DataFrame:
    """leak-free rolling features per (player, season) by week.

    Two frames (3..1 preceding, unbounded..1 preceding) and a LAG share one
    partitioning and ordering, so they plan as a single Window operator over
    one shuffle on (player_id, season).
    """
    w = Window.partitionBy("player_id", "season").orderBy("week")
    last3 = w.rowsBetween(-3, -1)
    to_date = w.rowsBetween(Window.unboundedPreceding, -1)
    s = stats.join(players.select("player_id", "position"), "player_id")
    out = s.select(
        "player_id", "season", "week", "position", "opponent", "is_home",
        F.col("fantasy_points").alias("target"),
        *[F.avg(c).over(last3).alias(f"{c}_last_3") for c in FORM_STATS],
        F.lag("fantasy_points", 1).over(w).alias("fantasy_points_last_1"),
        F.avg("fantasy_points").over(to_date).alias("season_avg_points"),
        F.count(F.lit(1)).over(to_date).alias("games_played"),
    )
    return out.where(F.col("games_played") >= 1)


def season_defence_rank(frame: DataFrame, target: str = "target", to_date: bool = False) -> DataFrame:
    """per-season rank of opponents by mean target, method='first'.

    Ties break by opponent name (the group order). The ranking table is
    seasons x teams rows, broadcast back onto the frame. With `to_date` a row
    sees the rank by earlier weeks of its season alone (D18); 16 before the first.
    """
    if to_date:
        weekly = frame.groupBy("season", "week", "opponent").agg(F.sum(target).alias("pts"), F.count(target).alias("n"))
        ranks = ranks_to_date(weekly, frame.select("season", "week").distinct())
        out = frame.join(ranks, ["season", "week", "opponent"], "left")
        return out.withColumn("opponent_rank", clip(F.coalesce("opponent_rank", F.lit(16)), 1, 32).cast("int"))
    allowed = frame.groupBy("season", "opponent").agg(round_half_even(F.avg(target), 9).alias("pts_allowed"))
    w = Window.partitionBy("season").orderBy(F.col("pts_allowed").desc(), F.col("opponent"))
    ranks = allowed.select("season", "opponent", F.row_number().over(w).alias("opp_rank_raw"))
    out = frame.join(F.broadcast(ranks), ["season", "opponent"], "left")
    return out.withColumn("opponent_rank", clip(F.coalesce(F.col("opp_rank_raw"), F.lit(16)), 1, 32)
                          .cast("int")).drop("opp_rank_raw")


def finalise_training(frame: DataFrame, positions=S.FLEX_POSITIONS,
                      feature_order=S.FEATURE_ORDER, rank_to_date: bool = False) -> DataFrame:
    """position filter, season rank (`rank_to_date`: D18), numeric coercion, contract check, target."""
    if positions:
        frame = frame.where(F.upper(F.col("position")).isin(*[p.upper() for p in positions]))
    frame = season_defence_rank(frame, to_date=rank_to_date)
    frame = frame.withColumn("is_home", F.col("is_home").cast("int")) \
        .withColumn("games_played", F.coalesce(F.col("games_played"), F.lit(0)).cast("int"))
    missing = [c for c in feature_order if c not in frame.columns]
    if missing:
        raise KeyError(f"feature '{missing[0]}' missing from dataset")
    cols = []
    for c in frame.columns:
        if c in feature_order and c not in ("is_home", "games_played", "opponent_rank"):
            cols.append(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c))
        elif c == "target":
            cols.append(F.col("target").alias("fantasy_points"))
        else:
            cols.append(F.col(c))
    return frame.select(*cols).where(F.col("fantasy_points").isNotNull())


def ranks_to_date(weekly: DataFrame, periods: DataFrame) -> DataFrame:
    """(season, week, opponent, opponent_rank): opponents by average points allowed in earlier weeks of the season.

    `weekly` has (season, week, opponent, pts, n), sums and counts; `periods` the
    asked (season, week), once each. Sums run over an opponent's weeks, so no
    week meets all earlier ones; asked weeks lie among them and sort before the
    games of their week. Rows are bounded by teams x weeks of a season.
    """
    asked = periods.join(weekly.select("season", "opponent").distinct(), "season").select(
        "season", "week", "opponent", F.lit(0.0).alias("pts"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("_game"))
    both = asked.unionByName(weekly.select("season", "week", "opponent", "pts", "n", F.lit(1).alias("_game")))
    before = Window.partitionBy("season", "opponent").orderBy("week", "_game").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.withColumns({"_pts": F.sum("pts").over(before), "_n": F.sum("n").over(before)})
    allowed = sums.where("_game = 0 and _n > 0").withColumn("_allowed", round_half_even(F.col("_pts") / F.col("_n"), 9))
    w = Window.partitionBy("season", "week").orderBy(F.col("_allowed").desc(), "opponent")
    return allowed.select("season", "week", "opponent", F.row_number().over(w).alias("opponent_rank"))


def _with_opponent_rank(requests: DataFrame, stats: DataFrame) -> DataFrame:
    """Requests with the 1-based rank of their opponent by average points allowed
    before the week; one row out for each row in.

    Stats are pre-aggregated to (season, week, opponent) sums; `ranks_to_date`
    ranks them for the distinct request periods.
    """
    weekly = stats.groupBy("season", "week", "opponent").agg(
        F.sum("fantasy_points").alias("pts"), F.count("fantasy_points").alias("n"))
    ranks = ranks_to_date(weekly, requests.select("season", "week").distinct()) \
        .toDF("_s", "_w", "_o", "_rk")
    opp = F.upper(requests["opponent"])
    out = requests.join(ranks, (requests["season"] == F.col("_s")) & (requests["week"] == F.col("_w"))
                        & (opp == F.col("_o")), "left")
    rank = F.when(opp.isNull() | (opp == "UNK"), F.lit(16)).otherwise(F.coalesce(F.col("_rk"), F.lit(16)))
    return out.withColumn("opponent_rank", rank.cast("int")).drop("_s", "_w", "_o", "_rk")


def opponent_rank_lookup(requests: DataFrame, stats: DataFrame,
                         key=("player_id", "season", "week")) -> DataFrame:
    """1-based position of the request's opponent by avg points allowed
    before the request week (list order; ties by opponent); missing/UNK -> 16.

    Every request keeps its row, also those that repeat a key.
    """
    return _with_opponent_rank(requests, stats).select(*key, "opponent_rank")


def _form_as_of(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """Form of each distinct (player_id, season, week) from that season's strictly earlier games.

    Games and asked weeks lie in one partitioning on (player_id, season): each
    game has the form up to and with it, and an asked week takes that of the
    last game before it. No join, so no fan-out by the games of a season.
    """
    asked = asked.select("player_id", "season", "week").distinct()
    games = stats.select("player_id", "season", "week", F.lit(1).alias("_game"), *FORM_STATS)
    both = games.unionByName(asked.withColumn("_game", F.lit(0)), allowMissingColumns=True) \
        .repartition("player_id", "season")
    own = Window.partitionBy("player_id", "season", "_game").orderBy("week")
    last3, to_date = own.rowsBetween(-2, 0), own.rowsBetween(Window.unboundedPreceding, 0)
    form = F.struct(*[F.avg(c).over(last3).alias(f"{c}_last_3") for c in FORM_STATS],
                    F.col("fantasy_points").alias("fantasy_points_last_1"),
                    F.avg("fantasy_points").over(to_date).alias("season_avg_points"),
                    F.count(F.lit(1)).over(to_date).alias("games_played"))
    # An asked week sorts before a game of that week.
    before = Window.partitionBy("player_id", "season").orderBy("week", "_game").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_form", form) \
        .withColumn("_form", F.last(F.when(F.col("_game") == 1, F.col("_form")), ignorenulls=True).over(before))
    return seen.where("_game = 0").select("player_id", "season", "week", "_form.*")


def point_in_time_features(requests: DataFrame, stats: DataFrame,
                           key=("player_id", "season", "week")) -> DataFrame:
    """F8: fs1 vector per request as of (season, week): strictly earlier games.

    Cold start (no earlier game) gives zeros. Means rounded to 3 dp. Requests
    may repeat: each keeps its row, with its own opponent's rank.
    """
    key = list(key)
    asked = ["player_id", "season", "week"]
    base = _with_opponent_rank(requests, stats).select(
        *dict.fromkeys(key + asked), F.col("is_home").cast("int").alias("is_home"), "opponent_rank")
    out = base.join(_form_as_of(requests, stats), asked, "left")
    three = [f"{c}_last_3" for c in FORM_STATS] + ["fantasy_points_last_1", "season_avg_points"]
    return out.select(
        *key,
        *[round_half_even(F.coalesce(F.col(c), F.lit(0.0)), 3).alias(c) for c in three],
        F.coalesce(F.col("games_played"), F.lit(0)).cast("int").alias("games_played"),
        "opponent_rank", "is_home",
    )
