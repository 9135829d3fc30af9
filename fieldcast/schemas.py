"""Domain constants and column contracts.

FIXED VALUES: everything in this module must equal the behaviour being
reproduced (feature orders, defaults, weights, labels, thresholds). They are
stated here once, in natural order, and imported everywhere else.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
REGULAR_SEASON_WEEKS = 18
FULL_SEASON_GAMES = 17
SEASON_PROJECTION_WEEK = 0          # week 0 = whole-season projection row
FLEX_POSITIONS = ("WR", "RB", "TE")
INGEST_POSITIONS = ("WR", "RB", "TE", "QB")

# PPR scoring weights per raw counting column.
SCORING = {
    "receptions": 1.0,
    "receiving_yards": 0.1,
    "receiving_tds": 6.0,
    "rushing_yards": 0.1,
    "rushing_tds": 6.0,
    "fumbles_lost": -2.0,
}

COUNT_COLS = ("targets", "carries", "receptions", "receiving_tds", "rushing_tds")
FLOAT_COLS = ("receiving_yards", "rushing_yards")

WEEKLY_COLUMNS = (
    "player_id", "player_display_name", "position", "recent_team", "season", "week",
    "opponent_team", "targets", "carries", "receptions", "receiving_yards",
    "receiving_tds", "rushing_yards", "rushing_tds", "fantasy_points_ppr",
)
ROSTER_COLUMNS = (
    "player_id", "player_name", "position", "team", "age", "height", "weight",
    "draft_round", "draft_pick", "rookie_season",
)

# Canonical name -> candidate source names, in priority order.
WEEKLY_ALIASES = {
    "player_id": ("player_id", "gsis_id"),
    "player_display_name": ("player_display_name", "player_name", "full_name"),
    "recent_team": ("recent_team", "team"),
    "opponent_team": ("opponent_team", "opponent"),
    "receptions": ("receptions", "rec"),
    "carries": ("carries", "rushing_attempts", "rush_att", "att"),
    "receiving_yards": ("receiving_yards", "rec_yds"),
    "receiving_tds": ("receiving_tds", "rec_td"),
    "rushing_yards": ("rushing_yards", "rush_yds"),
    "rushing_tds": ("rushing_tds", "rush_td"),
}
ROSTER_ALIASES = {
    "player_id": ("player_id", "gsis_id"),
    "player_name": ("player_name", "full_name", "player_display_name", "football_name"),
    "team": ("team", "recent_team", "club_code"),
    "height": ("height", "height_inches"),
    "weight": ("weight", "weight_lbs"),
    "draft_pick": ("draft_pick", "draft_number"),
    "rookie_season": ("rookie_season", "rookie_year", "entry_year"),
    "years_of_experience": ("years_of_experience", "years_exp"),
}

# In-season feature vector, version fs1.
FEATURE_ORDER = (
    "targets_last_3", "receptions_last_3", "yards_last_3", "touchdowns_last_3",
    "fantasy_points_last_3", "fantasy_points_last_1", "season_avg_points",
    "games_played", "opponent_rank", "is_home",
)

# Pre-season feature vector, version ps5.
PRESEASON_FEATURE_ORDER = (
    "prior_points_per_game", "prior_last4_points_per_game", "prior_targets_per_game",
    "prior_target_share", "prior_carries_per_game", "prior_carry_share",
    "prior_yards_per_game", "prior_games", "prior_snap_share", "depth_chart_rank",
    "draft_round", "draft_pick", "years_experience", "is_rookie", "age",
    "team_pass_attempts_prior", "qb_changed", "career_weighted_ppg",
    "career_weighted_targets_per_game", "career_weighted_carries_per_game",
    "career_weighted_target_share", "career_best_ppg", "career_seasons", "career_games",
    "prior_points_per_target", "career_points_per_target", "efficiency_delta",
    "team_departed_target_share", "team_departed_carry_share",
    "teammate_top_target_share", "teammate_top_carry_share",
)
# Null -> default; everything not listed defaults to 0.0.
PRESEASON_NONZERO_DEFAULTS = {"depth_chart_rank": 5.0, "draft_round": 8.0,
                              "draft_pick": 300.0, "age": 25.0}
PRESEASON_DEFAULTS = {f: PRESEASON_NONZERO_DEFAULTS.get(f, 0.0) for f in PRESEASON_FEATURE_ORDER}

# Draft capital fades to neutral over this many career games.
DRAFT_EVIDENCE_GAMES = 32.0
NEUTRAL_DRAFT_ROUND = 4.0
NEUTRAL_DRAFT_PICK = 120.0

# Monotone direction per pre-season feature (+1 up, -1 down, absent = free).
MONOTONE = {
    "prior_points_per_game": 1, "prior_last4_points_per_game": 1,
    "prior_targets_per_game": 1, "prior_target_share": 1, "prior_carries_per_game": 1,
    "prior_carry_share": 1, "prior_yards_per_game": 1, "prior_snap_share": 1,
    "career_weighted_ppg": 1, "career_weighted_targets_per_game": 1,
    "career_weighted_carries_per_game": 1, "career_weighted_target_share": 1,
    "career_best_ppg": 1, "prior_points_per_target": 1, "career_points_per_target": 1,
    "team_pass_attempts_prior": 1, "team_departed_target_share": 1,
    "team_departed_carry_share": 1,
    "depth_chart_rank": -1, "draft_round": -1, "draft_pick": -1,
    "teammate_top_target_share": -1, "teammate_top_carry_share": -1,
}

# Career weighting.
RECENCY_WEIGHTS = {0: 0.45, 1: 0.28, 2: 0.15}
TAIL_WEIGHT = 0.06
MIN_GAMES_FOR_RATE = 3
PEAK_AGE = 26.5
AGE_DECAY = 0.010
AGE_FLOOR = 0.55
AGE_FACTOR_CLIP = (0.6, 1.4)

# Pre-season training target.
TARGET_WEEKS = 18
MIN_TARGET_GAMES = 6
MIN_TRAINING_ROWS = 500

# Value over replacement: starters per position in a 12-team league.
STARTERS_BY_POSITION = {"WR": 36, "RB": 30, "TE": 14}
DEFAULT_STARTERS = 24
MIN_POOL = 3

# Context-table defaults (24 numeric columns) and the nullable columns kept as null.
CONTEXT_NUMERIC_DEFAULTS = {
    "prior_games": 0, "prior_points_per_game": 0.0, "prior_targets_per_game": 0.0,
    "prior_yards_per_game": 0.0, "prior_target_share": 0.0, "prior_carries_per_game": 0.0,
    "prior_carry_share": 0.0, "prior_last4_points_per_game": 0.0,
    "team_pass_attempts_prior": 0.0, "team_points_prior": 0.0,
    "career_weighted_ppg": 0.0, "career_weighted_targets_per_game": 0.0,
    "career_weighted_carries_per_game": 0.0, "career_weighted_target_share": 0.0,
    "career_best_ppg": 0.0, "career_seasons": 0, "career_games": 0,
    "prior_points_per_target": 0.0, "career_points_per_target": 0.0,
    "efficiency_delta": 0.0, "team_departed_target_share": 0.0,
    "team_departed_carry_share": 0.0, "teammate_top_target_share": 0.0,
    "teammate_top_carry_share": 0.0,
}
CONTEXT_NULLABLE = ("prior_snap_share", "depth_chart_rank", "draft_round", "draft_pick",
                    "rookie_season", "years_experience", "age")

# Upsert column policies: columns listed are coalesce(new, old); others overwrite.
CONTEXT_COALESCE_COLUMNS = ("prior_snap_share", "depth_chart_rank", "draft_round",
                            "draft_pick", "rookie_season", "age")
PLAYER_OVERWRITE_COLUMNS = ("name", "team", "position")
PLAYER_COALESCE_COLUMNS = ("age", "height_inches", "weight_lbs", "draft_round",
                           "draft_pick", "rookie_season")
ROOKIE_COALESCE_COLUMNS = ("team", "draft_round", "draft_pick", "rookie_season")
ROOKIE_OVERWRITE_COLUMNS = ("position",)
ROOKIE_DEFAULT_AGE = 22.0
ROOKIE_DEFAULT_POSITION = "WR"

# Heuristic and confidence constants.
PRESEASON_PRIOR_MEAN = 6.0
PRESEASON_FALLBACK_STD = 5.0
INSEASON_FALLBACK_STD = 6.5
PRESEASON_MISSING_STD = 5.5
INSEASON_MISSING_STD = 6.0
GAMES_PER_SEASON = 17

# Feature labels for explanations.
LABELS = {
    "prior_points_per_game": "last season's points per game",
    "prior_last4_points_per_game": "how he finished last season",
    "prior_targets_per_game": "targets per game last season",
    "prior_target_share": "share of his team's targets",
    "prior_carries_per_game": "carries per game last season",
    "prior_carry_share": "share of his team's carries",
    "prior_yards_per_game": "yards per game last season",
    "prior_games": "games played last season",
    "prior_snap_share": "share of snaps played",
    "depth_chart_rank": "depth chart position",
    "draft_round": "draft capital, faded by games played",
    "draft_pick": "draft slot, faded by games played",
    "years_experience": "years in the league",
    "is_rookie": "rookie",
    "age": "age",
    "team_pass_attempts_prior": "how much his team throws",
    "qb_changed": "new quarterback",
    "career_weighted_ppg": "career scoring rate",
    "career_weighted_targets_per_game": "career targets per game",
    "career_weighted_carries_per_game": "career carries per game",
    "career_weighted_target_share": "career target share",
    "career_best_ppg": "his best season",
    "career_seasons": "seasons played",
    "career_games": "career games",
    "prior_points_per_target": "points per target last season",
    "career_points_per_target": "career points per target",
    "efficiency_delta": "efficiency vs his own career norm",
    "team_departed_target_share": "targets vacated by departed teammates",
    "team_departed_carry_share": "carries vacated by departed teammates",
    "teammate_top_target_share": "competition for targets",
    "teammate_top_carry_share": "competition for carries",
}
SHARE_FEATURES = ("prior_target_share", "prior_carry_share", "prior_snap_share",
                  "career_weighted_target_share", "team_departed_target_share",
                  "team_departed_carry_share", "teammate_top_target_share",
                  "teammate_top_carry_share")
FLAG_FEATURES = ("is_rookie", "qb_changed")
COUNT_FEATURES = ("prior_games", "career_games", "career_seasons", "years_experience",
                  "depth_chart_rank")

# Range rules of the scoring contracts: feature -> (low, high).
INSEASON_RANGES = {"opponent_rank": (1, 32), "is_home": (0, 1)}
PRESEASON_RANGES = {
    "prior_target_share": (0, 1), "prior_carry_share": (0, 1), "prior_snap_share": (0, 1),
    "prior_games": (0, 25), "depth_chart_rank": (1, 10), "draft_round": (1, 8),
    "draft_pick": (1, 300), "years_experience": (0, 25), "is_rookie": (0, 1),
    "qb_changed": (0, 1), "age": (18, 50),
}
# ------------------------------------------------------------ end FIXED VALUES

CLEAN_WEEKLY_COLUMNS = ("player_id", "name", "position", "team", "season", "week",
                        "opponent", "is_home", "targets", "carries", "receptions",
                        "yards", "touchdowns", "fantasy_points")
