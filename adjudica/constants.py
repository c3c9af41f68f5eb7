"""Column lists, word lists, thresholds and patterns the results depend on."""

from __future__ import annotations

# The 38 columns of a processed incident, in file order.
INCIDENT_COLUMNS = (
    "incident_id", "circuit", "country", "first_season", "round", "season",
    "current_top_4_drivers", "rounds", "num_teams", "lap", "lap_remaining", "full_laps",
    "completion_percentage", "sector", "flag", "safety_car", "track_conditions",
    "weather_conditions", "session", "incident_type", "severity",
    "positions_of_involved parties", "num_drivers", "drivers", "nationalities",
    "respective_teams", "driver_standings", "driver_points", "construct_standings",
    "construct_points", "years_in_sport", "superlicense_points_before_incident",
    "investigation", "incident_classification", "driver_at_fault", "penalty",
    "superlicense_points_added", "mentioned_article",
)

# Comma-separated multi-value columns.
MULTI_VALUE_COLUMNS = (
    "current_top_4_drivers", "positions_of_involved parties", "drivers", "nationalities",
    "respective_teams", "driver_standings", "driver_points", "construct_standings",
    "construct_points", "years_in_sport", "superlicense_points_before_incident",
)
ALIGNMENT_EXEMPT = ("current_top_4_drivers", "positions_of_involved parties")

# Column groups whose element counts must agree in a valid row.
ALIGNMENT_GROUPS = (
    ("drivers", "nationalities", "driver_standings", "driver_points", "years_in_sport",
     "superlicense_points_before_incident"),
    ("drivers", "respective_teams"),
    ("drivers", "construct_standings", "construct_points"),
)

# Multi-value source column -> per-driver column, per-opponent column.
DRIVER_FIELDS = (
    ("nationalities", "driver_nationality", "opponent_nationality"),
    ("respective_teams", "driver_team", "opponent_team"),
    ("driver_standings", "driver_standing", "opponent_standing"),
    ("driver_points", "driver_points", "opponent_points"),
    ("construct_standings", "driver_construct_standing", "opponent_construct_standing"),
    ("construct_points", "driver_construct_points", "opponent_construct_points"),
    ("years_in_sport", "years_in_sport", "opponent_years_in_sport"),
    ("superlicense_points_before_incident", "superlicense_points_before_incident",
     "opponent_superlicense_points_before"),
)

# Incident-level columns carried to the driver grain.
SHARED_COLUMNS = (
    "incident_id", "season", "round", "circuit", "country", "first_season", "rounds",
    "num_teams", "lap", "lap_remaining", "full_laps", "completion_percentage", "sector",
    "flag", "safety_car", "track_conditions", "weather_conditions", "session",
    "incident_type", "severity", "positions_of_involved parties", "num_drivers",
    "current_top_4_drivers", "investigation", "incident_classification", "driver_at_fault",
    "penalty", "superlicense_points_added", "mentioned_article", "penalty_severity",
    "source_file", "source_season",
)

# Labels that end a field in a decision text.
FIELD_LABELS = (
    "No / Driver", "Competitor", "Time", "Session", "Fact", "Offence", "Infringement",
    "Decision", "Reason", "Document", "Date",
)

# Incident type -> terms; the first type with a term in the text wins.
INCIDENT_TYPE_KEYWORDS = {
    "collision": ("collision", "contact", "crashed", "incident with car", "incident between",
                  "turned into"),
    "track_limits": ("track limits", "left the track", "exceeded track limits"),
    "unsafe_release": ("unsafe release", "released unsafely"),
    "blocking": ("impeding", "blocking", "dangerously slow"),
    "pit_lane": ("pit lane", "pit entry", "pit exit", "speeding in the pit lane"),
    "yellow_flag": ("yellow flag", "double yellow"),
    "speeding": ("speeding", "exceeded the speed limit"),
    "overtaking": ("overtaking under", "move under yellow"),
    "driving_standards": ("dangerous driving", "repeated changes of direction", "weaving"),
    "technical": ("technical infringement", "fuel flow", "plank", "floor"),
}

# Severity class -> penalty substrings; classes are tried 2, 1, 0.
SEVERITY_PATTERNS = {
    2: ("disqualification", "dsq", "grid", "place grid", "grid drop", "grid penalty",
        "suspension", "stop and go", "stop-go", "time penalty 10 seconds",
        "10 second time penalty", "15 second", "20 second"),
    1: ("warning", "reprimand", "fine", "drive through", "drive-through", "5 second", "5s",
        "10 second", "10s", "time penalty", "penalty points"),
    0: ("no further action", "no action", "no penalty", "resolved during race", "noted",
        "reminder"),
}
SEVERITY_NAMES = {0: "no_penalty", 1: "minor", 2: "major"}
SEVERITY_LABELS = (0, 1, 2)

# Document title filters.
TITLE_INCLUDE = ("Infringement", "Decision", "Offence", "Summons")
TITLE_EXCLUDE = (
    "Entry List", "Classification", "Starting Grid", "scrutineering", "Championship Points",
    "PU elements", "gearboxes", "Circuit Map", "Race Directors", "Race Director",
    "Fuel declaration", "Parts and parameters", "Dry tyre type", "Provisional",
    "Final Race Classification", "Final Qualifying Classification", "P1 Classification",
    "P2 Classification", "P3 Classification", "Initial Scrutineering",
)

# The same event under two names (normalised), valid in both directions.
EVENT_ALIASES = (("sao paulo", "brazilian"), ("mexico city", "mexican"))

# Text columns searched by fact conditions, in order.
FACT_TEXT_FIELDS = ("fact", "Fact", "fact_text", "reason", "investigation")

# Thresholds.
MATCH_TOLERANCE_SECONDS = 45
FEED_FIRST_SEASON = 2023
MIN_PARSE_CONFIDENCE = 0.7
FAULT_MIN_CONFIDENCE = 0.7
MIN_PRECEDENTS = 3
HISTORY_WINDOWS = (3, 5)
OPTIONAL_MISSING_RATE = 0.30
SELECTION_MISSING_RATE = 0.40
CORRELATION_THRESHOLD = 0.95
IMPORTANCE_DROP_PERCENTILE = 20
RACE_STAGE_BINS = (33, 66, 85)
CONTENDER_MAX_STANDING = 3
CONTENDER_MAX_GAP = 40
POINTS_PER_RACE = 25

# Quality gates (id, metric, target, strictly greater).
QUALITY_GATES = (
    ("lap_race", "lap_race_fill_rate", 0.5, True),
    ("flag_race", "flag_race_fill_rate", 0.5, True),
    ("positions_with_drivers", "positions_with_drivers_fill_rate", 0.4, True),
    ("sector", "sector_fill_rate", 0.5, False),
    ("standings_round_n_minus_1", "standings_provenance_rate", 0.9, False),
    ("points_before_given_prior", "points_before_given_prior_rate", 0.8, False),
)
SECTOR_TARGETS = {"2019": 0.7, "2025": 0.5}

# Feature columns by kind and by ablation group.
CATEGORICAL_V1 = (
    "circuit", "country", "sector", "flag", "safety_car", "track_conditions",
    "weather_conditions", "session", "incident_type", "severity", "driver",
    "driver_nationality", "driver_team", "opponent", "opponent_nationality", "opponent_team",
)
CATEGORICAL_V2 = ("race_stage",)
BOOLEAN_V1 = ("same_team",)
BOOLEAN_V2 = ("is_first_round", "is_last_round", "title_contender", "construct_title_contender")
NUMERIC_V1 = (
    "round", "season", "rounds", "num_teams", "lap", "lap_remaining", "full_laps",
    "completion_percentage", "first_season", "driver_standing", "driver_points",
    "driver_construct_standing", "driver_construct_points", "years_in_sport",
    "superlicense_points_before_incident", "opponent_standing", "opponent_points",
    "opponent_construct_standing", "opponent_construct_points", "opponent_years_in_sport",
    "opponent_superlicense_points_before", "standing_difference", "points_difference",
    "num_drivers",
)
FEATURE_GROUPS = {
    "race": ("race_stage", "round_progress", "is_first_round", "is_last_round"),
    "championship": ("points_gap_to_leader", "points_gap_to_opponent", "title_contender",
                     "construct_title_contender", "points_available_remaining"),
    "history": ("career_incidents", "career_penalties", "career_major_penalties",
                "career_incidents_per_100_races", "career_penalties_per_100_races",
                "incidents_last_3_races", "incidents_last_5_races", "penalties_last_3_races",
                "penalties_last_5_races", "races_since_last_penalty",
                "races_since_last_incident"),
    "precedent": ("precedent_count", "precedent_no_penalty_rate",
                  "precedent_minor_penalty_rate", "precedent_major_penalty_rate"),
}
NUMERIC_V2 = tuple(
    name for group in FEATURE_GROUPS.values() for name in group
    if name not in CATEGORICAL_V2 + BOOLEAN_V2
)
CATEGORICAL_FEATURES = CATEGORICAL_V1 + CATEGORICAL_V2
BOOLEAN_FEATURES = BOOLEAN_V1 + BOOLEAN_V2
NUMERIC_FEATURES = NUMERIC_V1 + NUMERIC_V2

# Columns that may never be model inputs.
LEAKAGE_COLUMNS = (
    "penalty", "penalty_severity", "driver_at_fault", "superlicense_points_added",
    "mentioned_article", "incident_classification", "incident_id", "row_id", "document_id",
    "decision_id", "investigation", "source_file", "source_season", "drivers",
    "nationalities", "respective_teams", "driver_standings", "driver_points",
    "construct_standings", "construct_points", "current_top_4_drivers",
)
REDUNDANT_COLUMNS = (
    "is_race_session", "is_qualifying", "top_4_driver", "top_4_opponent", "laps_remaining",
)
OPTIONAL_COLUMNS = ("positions_of_involved parties",)

# Name parts that mark an engineered feature.
ENGINEERED_TOKENS = (
    "precedent_", "career_", "incidents_last_", "penalties_last_", "races_since_",
    "round_progress", "points_gap_", "points_available_", "title_contender",
    "construct_title", "is_first_round", "is_last_round", "race_stage",
)

# Standings columns a round N-1 source may overwrite.
STANDINGS_COLUMNS = (
    "driver_standings", "driver_points", "construct_standings", "construct_points",
    "nationalities", "respective_teams", "current_top_4_drivers",
)
