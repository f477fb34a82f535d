"""Fixed values of the baseball configuration.

Everything below is a published vocabulary or convention that results depend on.
"""

# Event types that complete a plate appearance.
PLATE_APPEARANCE_EVENTS = [
    "single", "double", "triple", "home_run", "double_play", "field_error", "field_out", "fielders_choice",
    "fielders_choice_out", "force_out", "grounded_into_double_play", "strikeout", "strike_out",
    "strikeout_double_play", "strikeout_triple_play", "triple_play", "sac_fly", "catcher_interf",
    "batter_interference", "fan_interference", "sac_fly_double_play", "sac_bunt", "sac_bunt_double_play",
    "walk", "intent_walk", "hit_by_pitch", "os_ruling_pending_primary",
]
HIT_EVENTS = ["single", "double", "triple", "home_run"]
WALK_OR_HIT_EVENTS = ["walk", "intent_walk", "hit_by_pitch"]
STRIKEOUT_EVENTS = ["strikeout", "strike_out", "strikeout_double_play", "strikeout_triple_play"]
SPECIAL_EVENTS = ["catcher_interf", "batter_interference", "os_ruling_pending_primary"]

# Trajectory families, the twelve profile bins and the parts of a bin name.
TRAJECTORY_FAMILY = {
    "popup": "IFFB",
    "fly_ball": "OFFB",
    "line_drive": "LD",
    "ground_ball": "GB",
    "bunt_grounder": "BUNT",
    "bunt_popup": "BUNT",
    "bunt_line_drive": "BUNT",
}
AIR_FAMILIES = ["IFFB", "OFFB", "LD"]
DIRECTED_FAMILIES = ["OFFB", "LD", "GB"]
DIRECTION_PREFIX = {"pull": "PULL", "center": "CENTER", "opposite": "OPPO"}
OUTCOME_BINS = ["BB_HBP", "K"]
CONTACT_BINS = [
    "IFFB", "PULL_OFFB", "CENTER_OFFB", "OPPO_OFFB", "PULL_LD", "CENTER_LD", "OPPO_LD", "PULL_GB", "CENTER_GB", "OPPO_GB",
]
PROFILE_BINS = OUTCOME_BINS + CONTACT_BINS
FOUL_TERRITORY = r"(?i)\bfoul\s+territory\b"

# Nine outcome groups of a structured contact result and what each is worth.
CONTACT_RESULT_GROUP = {
    "single": "1B",
    "double": "2B",
    "triple": "3B",
    "home_run": "HR",
    "field_error": "ROE",
    "fielders_choice": "FC_REACH",
    "sac_fly": "SF",
    "double_play": "MULTI_OUT",
    "grounded_into_double_play": "MULTI_OUT",
    "sac_fly_double_play": "MULTI_OUT",
    "triple_play": "MULTI_OUT",
    "field_out": "OUT",
    "fielders_choice_out": "OUT",
    "force_out": "OUT",
}
CONTACT_RESULT_VALUE = {
    "1B": 0.4651970407443663,
    "2B": 0.7665843002990237,
    "3B": 1.0004100521698496,
    "HR": 1.3834396983847337,
    "ROE": 0.43273757678346964,
    "FC_REACH": 0.1558534038205505,
    "SF": -0.06260868067734615,
    "MULTI_OUT": -0.8151401718384932,
    "OUT": -0.24975231369042597,
}

# Narrative patterns of the nine groups, and the ones that exclude a narrative.
NARRATIVE_PATTERNS = [
    (r"(?i)\b(homers|home run|grand slam)\b", "HR"),
    (r"(?i)\btriples\b", "3B"),
    (r"(?i)\b(doubles|ground-rule double)\b", "2B"),
    (r"(?i)\bsingles\b", "1B"),
    (r"(?i)\b(double play|triple play)\b", "MULTI_OUT"),
    (r"(?i)\bsacrifice fly\b", "SF"),
    (r"(?i)\breaches(?: first base)? on (?:a |an )?[^.]{0,80}\berror\b", "ROE"),
    (r"(?i)\breaches(?: first base)? on (?:a )?fielder'?s choice(?! out)\b", "FC_REACH"),
    (
        r"(?i)\b(grounds out|flies out|flyout|lines out|lineout|pops out|pop out|fouls out|foul out|force out|fielder'?s choice out)\b",
        "OUT",
    ),
]
BUNT_NARRATIVE = r"(?i)\bbunt\b"
SPECIAL_NARRATIVE = r"(?i)\b(catcher interference|batter interference|fan interference|runner interference)\b"

# Leagues of each level, the order of levels, and the pooling strength of each level.
LEAGUE_LEVEL = {
    103: "MLB",
    104: "MLB",
    112: "AAA",
    117: "AAA",
    109: "AA",
    111: "AA",
    113: "AA",
    116: "HIGH_A",
    118: "HIGH_A",
    126: "HIGH_A",
    110: "SINGLE_A",
    122: "SINGLE_A",
    123: "SINGLE_A",
    121: "ROOKIE_COMPLEX",
    124: "ROOKIE_COMPLEX",
    130: "ROOKIE_COMPLEX",
}
LEVEL_ORDER = {"ROOKIE_COMPLEX": 1, "SINGLE_A": 2, "HIGH_A": 3, "AA": 4, "AAA": 5, "MLB": 6}
LEVEL_POOLING_STRENGTH = {"MLB": 5, "AAA": 25, "AA": 75, "HIGH_A": 0, "SINGLE_A": 25, "ROOKIE_COMPLEX": 0}

# Canonical vocabularies and the identifier pattern.
SEQUENCE_STATUSES = ["official_true_pa", "official_non_pa", "unclassified_source_sequence"]
SEVERITIES = ["info", "warning", "error", "quarantine"]
ENTITY_TYPES = ["source_snapshot", "game", "play_sequence", "pitch", "player_crosswalk"]
SHA256_HEX = "^[0-9a-f]{64}$"
