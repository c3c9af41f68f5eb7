"""The default rule set. Priorities, conditions, outcomes and texts."""

from __future__ import annotations

VERSION = "1.0.0"

# Allowed outcome details, severities and condition operators.
ALLOWED_DETAILS = (
    "no_action", "warning", "reprimand", "5s", "10s", "grid_drop", "dsq", "licence_points",
    "manual_review",
)
ALLOWED_SEVERITIES = (0, 1, 2)
ALLOWED_OPERATORS = ("eq", "in", "contains", "gte", "lt")


def rule(id, priority, conditions, detail, severity, reason=None, regulation=None, proceed=False):
    """A rule as plain data; ``proceed`` lets later matches override it."""
    return {"id": id, "priority": priority, "conditions": conditions, "detail": detail,
            "severity": severity, "reason": reason, "regulation": regulation, "continue": proceed}


# The seventeen default rules (lower priority number is tried first).
DEFAULT_RULES = (
    rule("collision_avoidable_advantage", 10,
         {"incident_type": "collision",
          "fact_contains_any": ["gained an advantage", "gaining an advantage", "left the track and gained"],
          "session_in": ["race", "qualifying", "sprint"]},
         "5s", 1, "Avoidable incident with advantage gained → time penalty",
         "Appendix L Chapter IV Article 2"),
    rule("collision_racing_no_fault", 20,
         {"incident_type": "collision",
          "fact_contains_any": ["racing incident", "no driver wholly or predominantly to blame",
                                "no further action"]},
         "no_action", 0, "Racing incident with no single driver predominantly at fault"),
    rule("collision_reckless", 15,
         {"incident_type": "collision",
          "fact_contains_any": ["dangerous driving", "reckless", "dangerous manoeuvre"]},
         "10s", 2, "Reckless or dangerous driving → major time penalty", "Appendix L Chapter IV"),
    rule("track_limits_first_offence", 30,
         {"incident_type": "track_limits", "driver_track_limits_last_5_races": {"lt": 2}},
         "warning", 1, "First or second track-limits breach in rolling window → warning"),
    rule("track_limits_repeat", 31,
         {"incident_type": "track_limits", "driver_track_limits_last_5_races": {"gte": 2}},
         "5s", 1, "Repeated track limits breaches → escalation to time penalty"),
    rule("unsafe_release_pit", 40,
         {"incident_type": "unsafe_release", "session_in": ["race", "qualifying", "sprint"]},
         "10s", 1, "Unsafe release in competitive session → time penalty"),
    rule("blocking_qualifying", 50,
         {"incident_type": "overtaking", "session_in": ["qualifying"],
          "fact_contains_any": ["impeded", "impeding", "blocking"]},
         "grid_drop", 2, "Qualifying impeding → grid penalty"),
    rule("yellow_flag_breach", 60, {"incident_type": "yellow_flag"},
         "10s", 1, "Yellow flag infringement → time penalty"),
    rule("pit_lane_speeding", 70,
         {"incident_type": "pit_lane",
          "fact_contains_any": ["speeding", "pit lane speed", "exceeded the pit lane speed limit"]},
         "reprimand", 1, "Pit lane speeding → reprimand or minor penalty"),
    rule("pit_lane_general", 72, {"incident_type": "pit_lane"},
         "reprimand", 1, "Pit lane infringement without explicit speeding fact → reprimand"),
    rule("collision_unclassified", 25, {"incident_type": "collision"},
         "manual_review", 0, "Collision without matching fact pattern → manual review"),
    rule("unsafe_release_general", 42, {"incident_type": "unsafe_release"},
         "10s", 1, "Unsafe release → time penalty"),
    rule("overtaking_race", 52, {"incident_type": "overtaking", "session_in": ["race", "sprint"]},
         "5s", 1, "Race impeding / overtaking infringement → time penalty"),
    rule("yellow_flag_practice", 61, {"incident_type": "yellow_flag", "session_in": ["practice"]},
         "warning", 1, "Practice yellow flag breach → warning"),
    rule("technical_breach", 80, {"incident_type": "technical"},
         "licence_points", 2, "Technical / procedural breach → major sanction"),
    rule("other_unclassified", 95, {"incident_type": "other"},
         "manual_review", 0, "Unclassified incident type → manual review"),
    rule("default_unmatched", 9999, {"default": True},
         "manual_review", 0, "No specific rule matched — requires manual review"),
)
