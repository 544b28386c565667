"""Basketball player seasons: eight per-season tables and one career table.

All values below are fixed values: names, ranges and labels that results depend on.
"""

from __future__ import annotations

from dataclasses import replace

from profilekit.config import BlockRule, CompositeRule, ProfileConfig, TableSpec

_SEASON_KEYS = ("season", "player_id", "player", "lg", "team", "pos", "age", "g", "mp")

# Input files, required columns and smallest row counts.
_TABLES = (
    TableSpec(
        "advanced", "Advanced.csv",
        _SEASON_KEYS + (
            "per", "ts_percent", "x3p_ar", "f_tr", "orb_percent", "drb_percent", "trb_percent",
            "ast_percent", "stl_percent", "blk_percent", "tov_percent", "usg_percent",
            "ows", "dws", "ws", "ws_48", "obpm", "dbpm", "bpm", "vorp",
        ),
        500,
    ),
    TableSpec("totals", "Player Totals.csv", _SEASON_KEYS, 500),
    TableSpec("per_game", "Player Per Game.csv", _SEASON_KEYS[:-1] + ("mp_per_game",), 500, {"mp_per_game": "mp"}),
    TableSpec(
        "shooting", "Player Shooting.csv",
        _SEASON_KEYS + (
            "avg_dist_fga", "percent_fga_from_x0_3_range", "percent_fga_from_x3_10_range",
            "percent_fga_from_x10_16_range", "percent_fga_from_x16_3p_range", "percent_fga_from_x3p_range",
        ),
        500,
    ),
    TableSpec("play_by_play", "Player Play By Play.csv", _SEASON_KEYS, 500),
    TableSpec("per_100", "Per 100 Poss.csv", _SEASON_KEYS, 500),
    TableSpec("per_36", "Per 36 Minutes.csv", _SEASON_KEYS, 500),
    TableSpec("season_info", "Player Season Info.csv", _SEASON_KEYS[:-2], 500),
)
FACT_TABLES = tuple(replace(t, types=dict.fromkeys(("player_id", "player", "lg", "team", "pos"), "string")) for t in _TABLES)
CAREER_TABLE = TableSpec(
    "career", "Player Career Info.csv", ("player_id", "ht_in_in", "wt", "hof"), 100,
    types={"ht_in_in": "double", "wt": "double", "hof": "boolean"}, other="string",
)

# Debut cohorts, both ends included.
COHORTS = {
    "Pre-3PT": (1900, 1979),
    "Early-3PT": (1980, 1989),
    "Expansion-90s": (1990, 1999),
    "Dead-Ball": (2000, 2011),
    "Modern": (2012, 2019),
    "Post-COVID": (2020, 2100),
}

# Column -> the column of the same concept that is kept instead.
CONCEPT_VARIANTS = {
    "pts_per_100_poss": "pts_per_game",
    "pts_per_36_min": "pts_per_game",
    "fg_per_100_poss": "fg_per_game",
    "fga_per_100_poss": "fga_per_game",
    "x3p_per_100_poss": "x3p_per_game",
    "x3pa_per_100_poss": "x3pa_per_game",
    "x2p_per_100_poss": "x2p_per_game",
    "x2pa_per_100_poss": "x2pa_per_game",
    "ft_per_100_poss": "ft_per_game",
    "fta_per_100_poss": "fta_per_game",
    "ast_per_100_poss": "ast_per_game",
    "ast_per_36_min": "ast_per_game",
    "orb_per_game": "orb_percent",
    "drb_per_game": "drb_percent",
    "trb_per_game": "trb_percent",
    "orb_per_100_poss": "orb_percent",
    "drb_per_100_poss": "drb_percent",
    "trb_per_100_poss": "trb_percent",
    "orb_per_36_min": "orb_percent",
    "drb_per_36_min": "drb_percent",
    "trb_per_36_min": "trb_percent",
    "stl_per_100_poss": "stl_percent",
    "blk_per_100_poss": "blk_percent",
}

# The columns of each block (parts of names, or whole names where exact).
BLOCKS = {
    "scoring": BlockRule((
        "pts_per_game", "pts_per_100_poss", "pts_per_36_min", "usg_percent", "ts_percent", "fg_percent",
        "fg_per_game", "fga_per_game", "x3p_per_game", "x3pa_per_game", "ft_per_game", "fta_per_game",
        "x2p_per_game", "x2pa_per_game",
    )),
    "playmaking": BlockRule((
        "ast_per_game", "ast_percent", "ast_per_100_poss", "ast_per_36_min", "tov_per_game", "tov_percent",
        "points_generated_by_assists",
    )),
    "rebounding": BlockRule((
        "orb_per_game", "drb_per_game", "trb_per_game", "orb_percent", "drb_percent", "trb_percent",
        "orb_per_100_poss", "drb_per_100_poss", "trb_per_100_poss",
        "orb_per_36_min", "drb_per_36_min", "trb_per_36_min",
    )),
    "defense": BlockRule((
        "stl_per_game", "blk_per_game", "stl_percent", "blk_percent", "stl_per_100_poss", "blk_per_100_poss",
        "dbpm", "dws",
    )),
    "shooting": BlockRule((
        "avg_dist_fga", "percent_fga_from", "fg_percent_from", "x3p_ar", "f_tr", "e_fg_percent",
        "x3p_percent", "ft_percent",
    )),
    "positional": BlockRule(
        ("pg_percent", "sg_percent", "sf_percent", "pf_percent", "c_percent"), merge_variants=False
    ),
    "advanced": BlockRule(
        ("per", "bpm", "obpm", "dbpm", "vorp", "ws", "ows", "dws", "ws_48"), exact=True, merge_variants=False
    ),
}

# Composite scores.
COMPOSITES = {
    "scoring_score": CompositeRule(("scoring", "advanced"), ("pts", "usg", "per", "fg_per_game", "fga")),
    "playmaking_score": CompositeRule(("playmaking",)),
    "defense_score": CompositeRule(("defense",), also=("dbpm", "dws")),
    "rebounding_score": CompositeRule(("rebounding",)),
    "spacing_score": CompositeRule(("shooting",), ("x3p_ar", "avg_dist", "x3p_percent", "e_fg")),
    "versatility_score": CompositeRule(("positional",)),
}

# The block a feature is weighted with; the first rule that matches counts.
WEIGHT_RULES = (
    ("scoring", ("pts", "usg", "ts_percent", "fg_percent", "fg_per_game")),
    ("playmaking", ("ast", "tov", "points_generated")),
    ("rebounding", ("orb", "drb", "trb")),
    ("defense", ("stl", "blk", "dbpm", "dws")),
    ("shooting", ("x3p_ar", "avg_dist", "percent_fga", "fg_percent_from")),
    ("positional", ("pg_percent", "sg_percent", "sf_percent", "pf_percent", "c_percent")),
    ("advanced", ("per", "bpm", "vorp", "ws", "obpm")),
)

# Parts of feature names per search block.
SEARCH_BLOCKS = {
    "scoring": (
        "pts_per_game", "usg_percent", "ts_percent", "fg_percent", "fg_per_game", "fga_per_game",
        "x3p_per_game", "x3pa_per_game", "ft_per_game", "fta_per_game", "x2p_per_game", "x2pa_per_game",
        "scoring_score",
    ),
    "playmaking": (
        "ast_per_game", "ast_percent", "tov_per_game", "tov_percent", "points_generated_by_assists",
        "playmaking_score",
    ),
    "rebounding": (
        "orb_percent", "drb_percent", "trb_percent", "orb_per_game", "drb_per_game", "trb_per_game",
        "rebounding_score",
    ),
    "defense": ("stl_percent", "blk_percent", "dbpm", "dws", "stl_per_game", "blk_per_game", "defense_score"),
    "shooting": (
        "avg_dist_fga", "x3p_ar", "f_tr", "e_fg_percent", "x3p_percent", "ft_percent", "percent_fga_from",
        "fg_percent_from", "spacing_score",
    ),
    "positional": ("pg_percent", "sg_percent", "sf_percent", "pf_percent", "c_percent", "versatility_score"),
    "advanced": ("per", "bpm", "obpm", "vorp", "ws", "ows", "ws_48"),
}

# What a high or low feature is called.
LABELS = {
    ("pts_per_game", "high"): "High-Volume Scorer",
    ("pts_per_game", "low"): "Low-Volume Scorer",
    ("pts_per_100_poss", "high"): "Efficient Scorer",
    ("pts_per_100_poss", "low"): "Low-Impact Scorer",
    ("usg_percent", "high"): "High-Usage",
    ("usg_percent", "low"): "Low-Usage",
    ("per", "high"): "High-PER",
    ("per", "low"): "Low-PER",
    ("fg_per_game", "high"): "High-FGA",
    ("fg_per_game", "low"): "Low-FGA",
    ("fga_per_game", "high"): "Volume Shooter",
    ("fga_per_game", "low"): "Selective Shooter",
    ("x2p_per_game", "high"): "Paint Scorer",
    ("x2pa_per_game", "high"): "Paint Attacker",
    ("ft_per_game", "high"): "Foul Drawer",
    ("fta_per_game", "high"): "Contact Seeker",
    ("fta_per_game", "low"): "Avoids Contact",
    ("ts_percent", "high"): "Efficient Scorer",
    ("ts_percent", "low"): "Inefficient Scorer",
    ("e_fg_percent", "high"): "Efficient Shooter",
    ("e_fg_percent", "low"): "Inefficient Shooter",
    ("fg_percent", "high"): "High-FG%",
    ("fg_percent", "low"): "Low-FG%",
    ("x2p_percent", "high"): "Inside-Finisher",
    ("x2p_percent", "low"): "Poor-Finisher",
    ("ast_per_game", "high"): "Floor General",
    ("ast_per_game", "low"): "Non-Passer",
    ("ast_percent", "high"): "High-Assist-Rate",
    ("ast_percent", "low"): "Low-Assist-Rate",
    ("ast_per_100_poss", "high"): "Playmaker",
    ("points_generated_by_assists", "high"): "Offense Creator",
    ("tov_per_game", "high"): "Turnover-Prone",
    ("tov_per_game", "low"): "Ball-Secure",
    ("tov_percent", "high"): "High-TOV%",
    ("tov_percent", "low"): "Careful",
    ("trb_per_game", "high"): "Glass Cleaner",
    ("trb_per_game", "low"): "Weak Rebounder",
    ("orb_per_game", "high"): "Offensive Rebounder",
    ("orb_per_game", "low"): "Non-Crasher",
    ("drb_per_game", "high"): "Defensive Rebounder",
    ("drb_per_game", "low"): "Poor-DRB",
    ("orb_percent", "high"): "ORB Specialist",
    ("orb_percent", "low"): "Leaks Out",
    ("drb_percent", "high"): "DRB Anchor",
    ("drb_percent", "low"): "Weak-on-Glass",
    ("trb_percent", "high"): "Elite Rebounder",
    ("trb_percent", "low"): "Below-Avg Rebounder",
    ("stl_per_game", "high"): "Ball Hawk",
    ("stl_per_game", "low"): "Low-Steal",
    ("blk_per_game", "high"): "Shot Blocker",
    ("blk_per_game", "low"): "Non-Blocker",
    ("stl_percent", "high"): "Passing-Lane Disruptor",
    ("stl_percent", "low"): "Low-STL%",
    ("blk_percent", "high"): "Rim Protector",
    ("blk_percent", "low"): "Low-BLK%",
    ("dbpm", "high"): "Defensive Plus",
    ("dbpm", "low"): "Defensive Minus",
    ("dws", "high"): "Defensive Anchor",
    ("dws", "low"): "Low-Defensive-WS",
    ("x3p_per_game", "high"): "3PT Marksman",
    ("x3p_per_game", "low"): "Non-Shooter",
    ("x3pa_per_game", "high"): "Volume 3PT Shooter",
    ("x3pa_per_game", "low"): "Rare 3PT Shooter",
    ("x3p_percent", "high"): "Sharpshooter",
    ("x3p_percent", "low"): "Poor-Shooter",
    ("x3p_ar", "high"): "3PT-Reliant",
    ("x3p_ar", "low"): "Paint-Focused",
    ("avg_dist_fga", "high"): "Perimeter Player",
    ("avg_dist_fga", "low"): "Interior Player",
    ("percent_fga_from_x0_3_range", "high"): "Rim Attacker",
    ("percent_fga_from_x0_3_range", "low"): "Rim-Averse",
    ("percent_fga_from_x3_10_range", "high"): "Floater Game",
    ("percent_fga_from_x10_16_range", "high"): "Mid-Range Specialist",
    ("percent_fga_from_x16_3p_range", "high"): "Long-2 Specialist",
    ("percent_fga_from_x3p_range", "high"): "3PT Specialist",
    ("percent_fga_from_x3p_range", "low"): "Non-3PT Shooter",
    ("fg_percent_from_x0_3_range", "high"): "Elite Finisher",
    ("fg_percent_from_x3_10_range", "high"): "Floater Ace",
    ("fg_percent_from_x10_16_range", "high"): "Mid-Range Ace",
    ("fg_percent_from_x16_3p_range", "high"): "Long-2 Ace",
    ("fg_percent_from_x3p_range", "high"): "3PT Sniper",
    ("pg_percent", "high"): "Point Guard",
    ("sg_percent", "high"): "Shooting Guard",
    ("sf_percent", "high"): "Small Forward",
    ("pf_percent", "high"): "Power Forward",
    ("c_percent", "high"): "Center",
    ("pg_percent", "low"): "Non-PG",
    ("c_percent", "low"): "Non-C",
    ("bpm", "high"): "High-BPM",
    ("bpm", "low"): "Low-BPM",
    ("obpm", "high"): "Offensive Star",
    ("obpm", "low"): "Offensive Minus",
    ("vorp", "high"): "High-Value",
    ("vorp", "low"): "Low-Value",
    ("ws", "high"): "Win Producer",
    ("ws", "low"): "Low-WS",
    ("ws_48", "high"): "Efficient Contributor",
    ("ows", "high"): "Offensive Anchor",
    ("scoring_score", "high"): "Scoring Threat",
    ("scoring_score", "low"): "Non-Scorer",
    ("playmaking_score", "high"): "Creator",
    ("playmaking_score", "low"): "Finisher",
    ("defense_score", "high"): "Defensive Specialist",
    ("defense_score", "low"): "Low-Effort Defender",
    ("rebounding_score", "high"): "Board Man",
    ("rebounding_score", "low"): "Non-Rebounder",
    ("spacing_score", "high"): "Floor Spacer",
    ("spacing_score", "low"): "Non-Spacer",
    ("versatility_score", "high"): "Versatile",
    ("versatility_score", "low"): "One-Dimensional",
    ("ft_percent", "high"): "Clutch FT Shooter",
    ("ft_percent", "low"): "Poor FT Shooter",
    ("f_tr", "high"): "Draws Contact",
    ("f_tr", "low"): "Finesse Player",
}

# Features named first when z-scores are equal.
LABEL_PRIORITY = (
    "scoring_score",
    "playmaking_score",
    "defense_score",
    "rebounding_score",
    "spacing_score",
    "versatility_score",
    "pts_per_game",
    "usg_percent",
    "ast_per_game",
    "trb_per_game",
    "stl_per_game",
    "blk_per_game",
    "x3p_per_game",
    "x3pa_per_game",
    "x3p_percent",
    "x3p_ar",
    "avg_dist_fga",
    "ts_percent",
    "e_fg_percent",
    "ast_percent",
    "tov_percent",
    "orb_percent",
    "drb_percent",
    "stl_percent",
    "blk_percent",
    "dbpm",
    "dws",
    "percent_fga_from_x3p_range",
    "percent_fga_from_x0_3_range",
    "percent_fga_from_x3_10_range",
    "percent_fga_from_x10_16_range",
    "fg_percent_from_x0_3_range",
    "fg_percent_from_x3p_range",
    "pg_percent",
    "sg_percent",
    "sf_percent",
    "pf_percent",
    "c_percent",
    "per",
    "bpm",
    "obpm",
    "vorp",
    "ws",
    "ws_48",
    "ft_percent",
    "f_tr",
    "fta_per_game",
)

# Curated cluster names, positions and radar dimensions.
DISPLAY_NAMES = {
    -1: "Unclassified",
    0: "Offensive Hubs",
    1: "Floor Spacers",
    2: "Low-Usage Role Players",
    3: "Volume Scorers",
    4: "Wing Finishers",
    5: "Defensive Anchors",
    6: "Floor Generals",
    7: "Rim Runners",
    8: "Traditional Centers",
    9: "Glass Cleaners",
    10: "Low-Efficiency Scorers",
    11: "Franchise Anchors",
}
POSITIONS = ("PG", "SG", "SF", "PF", "C", "G", "F", "F-C", "G-F")
RADAR = (
    "scoring_score", "playmaking_score", "defense_score", "rebounding_score", "spacing_score",
    "versatility_score", "ast_per_game", "x3p_per_game",
)

PLAYER_SEASONS = ProfileConfig(
    entity="player_id",
    period="season",
    name="player",
    role="pos",
    context_keys=("lg", "player", "age", "team", "pos", "g", "gs", "mp"),
    fact_tables=FACT_TABLES,
    dimension=CAREER_TABLE,
    dimension_measures=("ht_in_in", "wt"),
    flag="hof",
    cohorts=COHORTS,
    blocks=BLOCKS,
    concept_variants=CONCEPT_VARIANTS,
    composites=COMPOSITES,
    weight_rules=WEIGHT_RULES,
    search_blocks=SEARCH_BLOCKS,
    labels=LABELS,
    label_priority=LABEL_PRIORITY,
    display_names=DISPLAY_NAMES,
    roles=POSITIONS,
    radar=RADAR,
    required_after_mean=("season", "age", "g", "gs", "mp"),
)
