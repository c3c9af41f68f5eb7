"""Rules, comparison, flatten, quality, encoding, selection and splits."""

import statistics

import pytest
from pyspark.sql import functions as F

from adjudica.functions.text import section
from adjudica.operators import compare, encode, fill, flatten, learning, metrics, quality, rules, selection, splits, textset
from adjudica.plans import jobs
from adjudica.rulesets import DEFAULT_RULES, rule
from adjudica.sources import readers

DEFAULT = rule("rest", 99, {"default": True}, "manual_review", 0)


def hit(spark, conditions, row, schema):
    df = spark.createDataFrame([row], schema)
    return df.select(rules.compile_conditions(df, conditions).alias("v")).first().v


@pytest.mark.parametrize("conditions,expected", [
    ({"incident_type": "Collision "}, True), ({"incident_type": {"in": ["x", "collision"]}}, True), ({"counter": {"gte": 2}}, True),
    ({"counter": {"lt": 2}}, False), ({"absent": {"gte": 0}}, False), ({"fact_contains_any": ["GAINED"]}, True), ({"session_in": ["race"]}, True),
    ({"session_in": ["sprint"]}, False), ({"and": [{"incident_type": "collision"}, {"counter": 2}]}, True),
    ({"or": [{"incident_type": "x"}, {"counter": {"eq": 3}}]}, False), ({"default": True}, True), ({}, True), ({"incident_type": {"between": 1}}, False),
    ({"incident_type": "collision", "or": [{"counter": {"lt": 1}}]}, False), ({"incident_type": {"contains": "LLIS"}}, True)])
def test_conditions(spark, conditions, expected):
    row = ("collision", "Race 2", "he gained a place", 2.0)
    assert hit(spark, conditions, row, "incident_type string, session string, fact string, counter double") is expected


def test_first_and_continuing_matches(spark):
    df = spark.createDataFrame([("a",), ("b",)], "incident_type string")
    plain = (rule("two", 2, {"incident_type": "a"}, "5s", 1), rule("one", 1, {"incident_type": "a"}, "10s", 2), DEFAULT)
    assert [r.normative_rule_id for r in rules.apply_rules(df, plain).collect()] == ["one", "rest"]
    running = (rule("one", 1, {"incident_type": "a"}, "10s", 2, proceed=True), rule("two", 2, {"incident_type": "a"}, "5s", 1), DEFAULT)
    assert [r.normative_rule_id for r in rules.apply_rules(df, running).collect()] == ["two", "rest"]


@pytest.mark.parametrize("bad", [
    (DEFAULT, DEFAULT), (rule("a", 1, {"x": 1}, "5s", 1),), (rule("a", 1, {}, "5s", 1), DEFAULT), (rule("a", 1, {"x": {"near": 1}}, "5s", 1), DEFAULT),
    (rule("a", 1, {"x": 1}, "slap", 1), DEFAULT), (rule("a", 1, {"x": 1}, "5s", 7), DEFAULT), (rule("a", 100, {"x": 1}, "5s", 1), DEFAULT)])
def test_bad_rule_sets(bad):
    with pytest.raises(rules.RuleError):
        rules.check_rules(bad)


def test_default_rules():
    rules.check_rules(DEFAULT_RULES)
    assert len(DEFAULT_RULES) == 17


def test_comparison(spark):
    df = spark.createDataFrame([("a", "collision", "race", "monaco", 2024, 1, 0, 0, "no_action"), ("b", "collision", "race", "monaco", 2024, 1, 1, 2, "5s"),
                                ("c", "track_limits", "qualifying", "spa", 2024, 1, 1, 1, "warning"), ("d", "other", "race", None, 2025, 1, 2, 0, "manual_review")],
                               "row_id string, incident_type string, session string, circuit string, season int, round int, penalty_severity int, "
                               "normative_penalty_severity int, normative_penalty_detail string")
    out = jobs.compare_outcomes(df)
    o = out["overall"].first()
    assert (o.row_count, o.agreement_rate, o.actual_harsher_rate, o.rule_harsher_rate, o.manual_review_rate, o.matched_row_count) == (4, 0.5, 0.25, 0.25, 0.25, 3)
    assert o.agreement_rate_excl_manual_review == pytest.approx(2 / 3)
    assert out["top_deviations"].first().row_id == "d"
    keys = {(r.dimension, r.key) for r in out["breakdowns"].collect()}
    assert ("circuit", None) in keys and sum(d == "incident_type" for d, _ in keys) == 3
    model = spark.createDataFrame([("a", 0), ("b", 0)], "row_id string, pred int")
    three = compare.three_way(out["rows"], model).first()
    assert (three.overlap_rows, three.agreement_actual_model, three.agreement_rule_model) == (2, 0.5, 0.5)


def test_kappa_and_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 0)], "a int, p int")
    got = df.agg(metrics.kappa("a", "p").alias("k")).first().k
    assert got == pytest.approx((0.6 - 0.32) / 0.68)
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, p int")
    assert same.agg(metrics.kappa("a", "p").alias("k")).first().k is None
    assert metrics.summary(same, "a", "p").first().macro_f1 == 1.0
    assert sum(r.n for r in metrics.confusion(df, "a", "p").collect()) == 5


def test_flatten(spark):
    rows = [("i1", "a,b", "x,y", "1"), ("i2", "a,b,c", "x,y", "1"), ("i3", "a,b,c", "x,y,", "")]
    df = spark.createDataFrame(rows, "incident_id string, drivers string, nationalities string, respective_teams string")
    one_team = df.where("incident_id <> 'i1'").unionByName(df.where("incident_id = 'i1'").withColumn("respective_teams", F.lit("t,u")))
    out = {r.row_id: r for r in flatten.flatten_incidents(one_team).collect()}
    assert set(out) == {"i1_a", "i1_b", "i3_a", "i3_b", "i3_c"}
    assert (out["i1_a"].opponent, out["i1_a"].opponent_nationality, out["i1_b"].opponent_team) == ("b", "y", "t")
    assert out["i3_c"].driver_nationality is None and out["i3_a"].opponent is None
    assert [r.incident_id for r in flatten.misaligned_incidents(one_team).collect()] == ["i2"]


def test_fill_and_provenance(spark):
    df = spark.createDataFrame([("a", "", "x"), ("b", "1", "nan")], "incident_id string, lap string, flag string")
    out = {r.incident_id: r for r in fill.fill_columns(df, {"lap": F.lit("9"), "flag": F.lit("")}, always=("flag",)).collect()}
    assert out["a"].lap == "9" and out["b"].lap == "1" and out["a"].flag == "x"
    first = fill.record(df, "lap", "one", 1, F.lit(True), {"value": F.col("lap")})
    last = fill.latest_provenance(first.unionByName(fill.record(df, "lap", "two", 2, F.col("lap") != "", {"value": F.col("lap")})))
    assert {(r.incident_id, r.source, tuple(sorted(r.details))) for r in last.collect()} == {("a", "one", ()), ("b", "two", ("value",))}


def test_gates_and_fill(spark):
    rows = [("a", "race", "3", "d", "10", "yellow", "2", "3", "0"), ("b", "race", "5", "d,e", "", "", "", "", "2,0")]
    df = spark.createDataFrame(rows, "incident_id string, session string, round string, drivers string, lap string, flag string, sector string, "
                                     "`positions_of_involved parties` string, superlicense_points_before_incident string")
    rates = {r.column: r.fill_rate for r in quality.fill_rates(df, ("lap", "drivers", "missing")).collect()}
    assert rates == {"lap": 0.5, "drivers": 1.0, "missing": 0.0}
    prior = spark.createDataFrame([("b",)], "incident_id string")
    rate = spark.createDataFrame([(1.0,)], "rate double")
    gates = {r.gate: r.passed for r in quality.evaluate_gates(quality.gate_metrics(df, prior, rate)).collect()}
    assert gates == {"lap_race": False, "flag_race": False, "positions_with_drivers": True, "sector": True,
                     "standings_round_n_minus_1": True, "points_before_given_prior": True}
    none = quality.gate_metrics(df, prior.where("false"), rate)
    assert quality.evaluate_gates(none).count() == 5


def test_exact_medians(spark):
    import random
    rng = random.Random(4)
    values = [(rng.gauss(0, 1), float(rng.randrange(5)), None) for _ in range(3001)]
    df = spark.createDataFrame(values, "a double, b double, c double")
    got = encode.exact_medians(df, ["a", "b", "c"])
    assert got == {"a": statistics.median(v[0] for v in values), "b": statistics.median(v[1] for v in values), "c": None}
    even = spark.createDataFrame([(1.0,), (4.0,), (2.0,), (9.0,)], "a double")
    assert encode.exact_medians(even, ["a"]) == {"a": 3.0}


def test_encoder_is_fit_on_train_only(spark):
    df = spark.createDataFrame([("r1", "race", "5", "train"), ("r2", "sprint", "7", "train"), ("r3", None, "", "train"), ("r4", "test", "1", "validation")],
                               "row_id string, session string, lap string, split string")
    coder = encode.fit_encoder(df.where("split = 'train'"), ["session", "lap"])
    got = {r.row_id: (r.cat__session, r.num__lap) for r in coder.transform(df, ("row_id",)).collect()}
    assert got == {"r1": (0.0, 5.0), "r2": (1.0, 7.0), "r3": (0.0, 6.0), "r4": (-1.0, 1.0)}
    with pytest.raises(ValueError):
        encode.fit_encoder(df, ["row_id"])


def test_correlation_prune(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, None if i == 3 else float(i * i % 7)) for i in range(20)], "a double, b double, c double, d double")
    pairs = [(r.left, r.right, r.corr) for r in selection.correlations(df, {c: F.col(c) for c in "abcd"}).collect()]
    by_pair = {(a, b): c for a, b, c in pairs}
    assert by_pair["a", "b"] == pytest.approx(1.0) and by_pair["a", "c"] is None
    kept, dropped = selection.correlation_prune(pairs, {"a": 0.1, "b": 0.2}, list("abcd"), list("abcd"))
    assert dropped == [("a", "b")] and kept == ["b", "c", "d"]


def test_splits(spark):
    plan = {"train_seasons": [2019, 2020], "validation_season": 2021, "test_season": [2022]}
    df = spark.createDataFrame([(s,) for s in (2019, 2020, 2021, 2022)], "season int")
    assert [r.split for r in splits.temporal_split(df, plan).orderBy("season").collect()] == ["train", "train", "validation", "test"]
    with pytest.raises(ValueError):
        splits.temporal_split(df.union(spark.createDataFrame([(2030,)], "season int")), plan)
    with pytest.raises(ValueError):
        splits.assignments({"train_seasons": [2019], "validation_season": 2019})
    with pytest.raises(ValueError):
        splits.temporal_split(df.where("season > 2020"), plan)


def test_text_leakage(spark):
    df = spark.createDataFrame([("it rained", "A long decision text", "x"), ("the a  LONG decision text here", "A long decision text", "x"), ("[REASON] y", "", "")],
                               "t string, d string, r string")
    assert [r.v for r in df.select(textset.leakage("t", "d", "r").alias("v")).collect()] == [False, True, True]


def test_cells_are_counted_and_texts_normalised_once(spark):
    """Each in one place of the plan, however often it is asked for."""
    cells = spark.range(3).selectExpr("string(id) AS incident_id", "concat(id, ',b') AS drivers", "concat('x', id) AS nationalities", "string(NULL) AS driver_points")
    lost = flatten.misaligned_incidents(cells)
    assert lost._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    assert lost.count() == 3 and flatten.flatten_incidents(cells.drop("nationalities")).count() == 6
    facts = spark.range(2).selectExpr("if(id = 0, ' \t ', concat('  a \n\n b', id)) AS fact")
    tagged = facts.select(section("FACT", "fact").alias("v"))
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert {r.v for r in tagged.collect()} == {None, "[FACT] a b1"}


def test_leaky_texts_are_errors(spark):
    docs = spark.createDataFrame(
        [("d1", "Monaco", "the \n LONG  decision text", "A", "long\tdecision text", None), ("d2", "Monaco", "short", "B", "short", "told at\u00a0length"),
         ("d3", "race told", "AT length", "C", "", "x [event] race told"), ("d4", None, None, None, "told [REASON]", "reason enough"), ("d5", "e", "ends here", "begins", "ends here [offence] begins", "")],
        "document_id string, event string, fact string, offence string, decision string, reason string").withColumns(
        {"session": F.lit("race"), "document_type": F.when(F.col("document_id") != "d4", "decision")})
    rows = docs.select(F.concat(F.lit("i"), "document_id").alias("incident_id"))
    meta = docs.select(F.concat(F.lit("i"), "document_id").alias("incident_id"), "document_id", F.lit(1.0).alias("parse_confidence"))
    built = docs.select("document_id", textset.build_text().alias("t"), "decision", "reason").select(
        F.concat(F.lit("i"), "document_id").alias("incident_id"), textset.leakage("t", "decision", "reason").alias("v"))
    out = {r.incident_id: r.drop_reason for r in textset.text_rows(rows, meta, docs).collect()}
    assert out == {"id1": "text_build_error", "id2": None, "id3": None, "id4": None, "id5": "text_build_error"}
    assert {r.incident_id: r.v for r in built.collect()} == {k: v is not None for k, v in out.items()}


def test_fusion_ties(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.1, 0.2, 0.7)], "a double, b double, c double")
    assert [r.v for r in df.select(learning.argmax([F.col(c) for c in "abc"]).alias("v")).collect()] == [0, 2]


def test_text_files(spark, tmp_path):
    (tmp_path / "doc1.txt").write_text("line one\nline two", encoding="utf-8")
    (tmp_path / "doc2.txt").write_text("  \n", encoding="utf-8")
    good, bad = readers.read_raw_texts(spark, str(tmp_path))
    assert [tuple(r) for r in good.collect()] == [("doc1", "line one\nline two")] and bad.first().document_id == "doc2"
    with pytest.raises(FileNotFoundError):
        readers.input_paths(spark, str(tmp_path), seasons=[2019])
    with pytest.raises(ValueError):
        (tmp_path / "processed_2019.csv").write_text("incident_id\n1\n")
        readers.read_csv(spark, [str(tmp_path / "processed_2019.csv")])


def test_null_keys_stay_null_and_apart_from_text(spark):
    rows = spark.createDataFrame([("<missing>", 0, 1), (None, 1, 1), (None, 0, 0)], "incident_type string, penalty_severity int, normative_penalty_severity int")
    got = {r.key: r.n for r in compare.breakdowns(compare.add_deviation(rows), ["incident_type"]).collect()}
    assert got == {"<missing>": 1, None: 2}
