"""A cross-section of the registered queries against their SQL on the smallest tables."""

import pytest

import check_oracle
from adjudica.queries import QUERIES, SQL, load

SF = "/root/testdata/sf0.001"
NAMES = ("F02_extract_field", "F28_infer_fault", "F31_lap_progress", "W02_career_counters", "W04_last_n_distinct_rounds", "W05_rounds_since",
         "W06_precedent_rates", "W08_rolling_license_points", "W10_rule_outcome_escalation", "J04_ranked_event_match", "J07_prior_round_standings",
         "J10_session_match", "J12_asof_backward", "J13_asof_nearest", "J14_keyed_asof_nearest", "A04_deviation_breakdowns", "A05_overall_agreement",
         "R02_opponent_pairing", "R09_review_queue", "P16_race_and_championship", "E03_timestamp_enrichment", "E07_text_field_enrichment",
         "N01_condition_leaves", "N07_rule_comparison", "M01_encode_splits", "E01_E07_enrichment_cascade", "E01_E07_cascade_provenance",
         "A13_quality_gates_by_season", "E02_standings_enrichment", "M16_paired_modalities")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


def test_every_sql_has_a_query():
    load()
    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 200


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    load()
    status, _, note = check_oracle.check(spark, con, SF, name)
    assert status == "ok", note
