"""Results depend on them, so they are stated here and nowhere else."""

# --- fixed values -----------------------------------------------------------
# Weight limits by division label; the first label contained in the text wins.
DIVISION_LIMITS = (
    ("light heavyweight", 205.0),
    ("heavyweight", 265.0),
    ("middleweight", 185.0),
    ("welterweight", 170.0),
    ("lightweight", 155.0),
    ("featherweight", 145.0),
    ("bantamweight", 135.0),
    ("flyweight", 125.0),
    ("strawweight", 115.0),
)

# Spelling corrections applied after name normalisation.
NAME_ALIASES = {
    "ian garry": "ian machado garry",
    "paulo henrique costa": "paulo costa",
    "rafael cerquiera": "rafael cerqueira",
    "ramazonbek temirov": "ramazan temirov",
    "stephen erceg": "steve erceg",
}

# Path segment in front of the hexadecimal participant id of a profile URL.
PROFILE_ID_PATTERN = r"(?i)/fighter-details/([0-9a-f]+)"

# Market-key fragments that mark a proposition market.
PROP_TERMS = ("method", "victory", "finish", "round", "decision", "submission", "ko")

EDGE_RULE = 0.04
TWO_UNIT_RULE = 0.10
MAX_STAKE = 1
EVENT_DAY_CAP = 2
MIN_MARKET_BOOKS = 3
MAX_ODDS_AGE_MINUTES = 360
ENSEMBLE_C = 0.05
OFFSET_L2 = 0.02
BLEND_GRID = (0.0, 0.25, 0.50, 0.75, 0.90, 1.0)
EDGE_BUCKETS = (
    ("4_to_6", 0.04, 0.06),
    ("6_to_8", 0.06, 0.08),
    ("8_to_10", 0.08, 0.10),
    ("10_plus", 0.10, None),
)
LIVE_SOURCE_PREFIX = "the-odds-api"
CLOSING_SOURCES = ("standardized-t30", "master")
POLICIES = (
    {"policy": "active_flat_1u_day_cap2", "high": None, "max_stake": 1.0, "cap": 2.0},
    {"policy": "legacy_2u_at_8_day_cap2", "high": 0.08, "max_stake": 2.0, "cap": 2.0},
    {"policy": "candidate_2u_at_10_day_cap2", "high": 0.10, "max_stake": 2.0, "cap": 2.0},
)
ROI_GATE_TEXT = "90% event-clustered ROI lower bound > 0"
CLV_GATE_TEXT = "90% event-clustered mean CLV lower bound > 0"
FORWARD_STATUS = "paper_only"
FORWARD_NOTE = ("Forward-test evidence only. Positive closing-line value should be "
                "established before ROI is treated as meaningful.")
TERMINAL_STATUSES = ("ok", "no_match", "no_quotes", "invalid_snapshot_time")
# ----------------------------------------------------------------------------
