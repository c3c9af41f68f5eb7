"""Strictly-prior windows and rolling points."""

import random

import pytest
from pyspark.sql import functions as F

from adjudica.operators import points, prior
from adjudica.operators.running import dense_code, running

SCHEMA = "incident_id string, driver string, season int, round int, penalty_severity int"


def history(spark, rows):
    df = spark.createDataFrame([(f"i{n}", "d", *r) for n, r in enumerate(rows)], SCHEMA)
    return {r.incident_id: r for r in prior.history_features(df).collect()}


def test_counts_exclude_the_present(spark):
    row = history(spark, [(2019, 2, 0), (2019, 3, 1), (2019, 4, 0), (2019, 5, 1)])["i3"]
    assert (row.career_incidents, row.incidents_last_3_races, row.penalties_last_3_races) == (3, 3, 1)
    assert row.career_penalties_per_100_races == pytest.approx(100 / 3)


def test_same_round_rows_do_not_count(spark):
    rows = history(spark, [(2019, 5, 1), (2019, 5, 0), (2019, 6, 0)])
    assert rows["i1"].career_incidents == 0 and rows["i2"].career_incidents == 2


def test_season_boundary_and_gaps(spark):
    rows = history(spark, [(2018, 10, 1), (2019, 1, 0)])
    assert rows["i1"].career_penalties == 1 and rows["i1"].races_since_last_penalty is None
    assert history(spark, [(2019, 2, 1), (2019, 5, 0)])["i1"].races_since_last_penalty == 2


def test_unknown_round(spark):
    rows = history(spark, [(2019, 1, 0), (2019, None, 1), (2019, 3, 0)])
    assert rows["i1"].career_incidents is None and rows["i2"].career_incidents == 1


def precedents(spark, rounds, severities, kinds=None):
    rows = [(f"i{r}", 2019, r, s, k, "Race") for r, s, k in zip(rounds, severities, kinds or ["collision"] * len(rounds))]
    df = spark.createDataFrame(rows, "incident_id string, season int, round int, penalty_severity int, incident_type string, session string")
    return {r["round"]: r for r in prior.precedent_features(df).collect()}


def test_precedent_rates(spark):
    row = precedents(spark, [1, 2, 3, 4, 5], [0, 1, 2, 0, 1])[3]
    assert (row.precedent_count, row.precedent_no_penalty_rate, row.precedent_minor_penalty_rate, row.precedent_major_penalty_rate) == (2, 0.5, 0.5, 0.0)
    first = precedents(spark, [1], [0])[1]
    assert first.precedent_count == 0 and first.precedent_no_penalty_rate is None
    assert precedents(spark, [1, 2], [0, 1], ["collision", "other"])[2].precedent_count == 0


def test_escalation(spark):
    def rows(rounds, kind="track_limits"):
        df = spark.createDataFrame([(f"i{r}", "d", 2019, r, 1, kind, "warning") for r in rounds], SCHEMA + ", incident_type string, penalty string")
        return {r["round"]: r for r in prior.escalation_counters(df).collect()}
    assert rows([1, 2, 3])[3].driver_track_limits_last_5_races == 2
    assert rows(range(1, 9))[8].driver_track_limits_last_5_races == 5
    assert rows(range(1, 13))[12].driver_warnings_last_10_races == 10


def test_rule_outcomes_drive_the_second_mode(spark):
    df = spark.createDataFrame([(f"i{r}", "d", 2019, r, 0, s, t) for r, s, t in ((1, 0, "no_action"), (2, 1, "warning"), (3, 0, "no_action"))],
                               SCHEMA + ", normative_penalty_severity int, normative_penalty_detail string")
    last = {r["round"]: r for r in prior.escalation_counters(df, "rules").collect()}[3]
    assert (last.driver_penalties_last_5_races, last.driver_warnings_last_10_races) == (1, 1)


def test_order_does_not_matter(spark):
    rng = random.Random(1)
    rows = [(f"i{n}", f"d{rng.randrange(3)}", 2019 + rng.randrange(2), rng.randrange(1, 8), rng.randrange(3)) for n in range(80)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    left, right = ({r.incident_id: tuple(r[5:]) for r in prior.history_features(spark.createDataFrame(x, SCHEMA)).collect()} for x in (rows, shuffled))
    assert left == right


def test_points_before(spark):
    rows = [("inc_a", 2025, "3", "driver_a", "2", "2025-03-01"), ("inc_b", 2025, "5", "driver_a,driver_b", "1", "2025-03-15"),
            ("inc_c", 2025, "4", "driver_b,car_99", "", "2025-03-10"), ("inc_d", 2025, "", "driver_a,driver_a", "nan", None)]
    df = spark.createDataFrame(rows, "incident_id string, season int, round string, drivers string, superlicense_points_added string, date string")
    got = {r[0]: r[1] for r in points.points_before(df).collect()}
    assert got == {"inc_a": "0", "inc_b": "2,0", "inc_c": "0,", "inc_d": "3,3"}
    assert {r[0] for r in points.incidents_with_prior_points(df).collect()} == {"inc_b", "inc_d"}


def test_running_equals_one_window_under_skew(spark):
    """A key with most rows gives the same prefix whatever the cells."""
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.randrange(1000), n, rng.randrange(9) if rng.random() < 0.7 else None) for n in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int").withColumn("cell", F.floor(F.col("t") / 37))
    for how in ("sum", "max", "last"):
        got = {r.id: r.out for r in running(df, ["k"], ["cell"], [F.col("t"), F.col("id")], F.col("v"), "out", how).collect()}
        for key in {r[0] for r in rows}:
            seen = []
            for _, t, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
                want = sum(seen) if how == "sum" else (max(seen) if seen else None) if how == "max" else (seen[-1] if seen else None)
                assert got[i] == want
                if v is not None:
                    seen.append(v)


def test_dense_code(spark):
    df = spark.createDataFrame([("a", w) for w in ("pear", "apple", "peach", "pear", "Zoo", "p")], "g string, w string")
    assert {r.w: r.c for r in dense_code(df, "g", "w", "c").collect()} == {"Zoo": 0, "apple": 1, "p": 2, "peach": 3, "pear": 4}
