"""Readers of many files, the choice of documents, folds, and what the cascade records."""

import csv
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.operators import documents, encode, fill, learning, quality, selection
from adjudica.plans import enrich
from adjudica.session import cut_lineage
from adjudica.sources import readers, writers


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def write(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])


def test_many_files_with_columns_in_any_order_are_one_scan(spark, tmp_path):
    want = set()
    for k in range(60):
        header = ["a", "b", "c"] if k % 2 else ["c", f"extra{k}", "b", "a"]
        row = {"a": f"a,{k}", "b": "" if k % 3 else 'say "x"', "c": f"c{k}", f"extra{k}": "?"}
        write(tmp_path / f"processed_{k}.csv", header, [[row[h] for h in header]] * 2)
        want.add((row["a"], row["b"], row["c"]))
    rows = readers.read_csv(spark, readers.input_paths(spark, str(tmp_path)), ["a", "b", "c"])
    assert {tuple(r)[:3] for r in rows.collect()} == want and rows.count() == 120
    assert plan_of(rows).count("FileScan csv") == 1 and "Union" not in plan_of(rows)


def test_a_file_without_a_column_is_named(spark, tmp_path):
    write(tmp_path / "processed_1.csv", ["a", "b"], [["1", "2"]])
    write(tmp_path / "processed_2.csv", ["a"], [["1"]])
    with pytest.raises(ValueError, match="processed_2.csv misses columns"):
        readers.read_csv(spark, [str(tmp_path)], ["a", "b"])


def test_primary_documents_are_chosen_by_one_number(spark):
    said = "document_id string, seq long, season int, title string, document_type string, parsed_fields struct<car_number:string,session:string,fact:string,decision:string>"
    rows = [("late", 9, 2020, "Decision", "decision", ("4", "race", "Left  the track", "x")), ("early", 2, 2020, "Decision", "decision", ("4", "race", "left the TRACK", "x")),
            ("infringement", 1, 2020, "Infringement", "infringement", ("4", "race", "left the track", "x")),
            ("correction", 11, 2021, "Decision - Correction", "decision", ("4", "race", "f", "x")), ("plain", 3, 2021, "Decision", "decision", ("4", "race", "f", "x")),
            ("summons", 4, 2021, "Summons", "summons", ("5", "race", "f", "")), ("decided", 5, 2021, "Summons", "summons", ("6", "race", "f", "x")),
            ("unknown", 6, 2021, "Other", "unknown", ("7", "race", "f", "x"))]
    docs = spark.createDataFrame(rows, said)
    best = documents.primary_documents(docs)
    assert {r.document_id for r in best.collect()} == {"early", "correction", "summons"}
    assert "SortAggregate" not in plan_of(best)


def test_out_of_fold_rows_are_scored_by_models_that_have_not_seen_them(spark):
    rows = spark.createDataFrame([(f"r{k % 40}", k % 3, "word") for k in range(120)], "row_id string, penalty_severity int, text string")
    seen = []

    def fit(train):
        seen.append({r.row_id for r in train.select("row_id").collect()})
        return len(seen) - 1

    def fake(model, held, out, keep=None):
        own = {r.row_id for r in held.collect()}
        assert own and not own & seen[model]
        return held.select("row_id", "penalty_severity", F.lit(model).alias(out))

    real = learning.score
    learning.score = fake
    try:
        scored = learning.out_of_fold(rows, fit, "p", folds=4)
    finally:
        learning.score = real
    assert scored.count() == 120 and len(seen) == 4 and set.union(*seen) == {f"r{k}" for k in range(40)}


def test_paired_table(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 0, 1), ("c", 1, 0, 1), ("d", 1, 0, 2)], "row_id string, penalty_severity int, l int, r int")
    got = {r.label: tuple(r)[1:] for r in learning.paired(rows.drop("r"), rows.select("row_id", "r"), "l", "r").collect()}
    assert got == {"0": (2, 1, 1, 0, 0, 1), "1": (2, 0, 0, 1, 1, 1), "all": (4, 1, 1, 1, 1, 2)}


def test_correlations_by_block_equal_those_in_one(spark):
    rows = spark.createDataFrame([(float(k), float(-k) if k % 4 else None, float(k * k % 7), 1.0) for k in range(60)], "a double, b double, c double, one double")
    columns = {c: F.col(c) for c in rows.columns}
    by_size = [{(r.left, r.right): None if r.corr is None else round(r.corr, 9) for r in selection.correlations(rows, columns, block).collect()} for block in (1, 4, 48)]
    assert by_size[0] == by_size[1] == by_size[2] and by_size[0][("a", "b")] == -1.0 and by_size[0][("a", "one")] is None
    assert selection.correlations(rows, {"a": F.col("a")}).count() == 0 and "Generate explode" not in plan_of(selection.correlations(rows, columns))


def test_records_travel_with_their_row(spark):
    rows = spark.createDataFrame([("i", "", "7", 0.5), ("", "x", "8", None)], "incident_id string, lap string, found string, error double")
    new = fill.records("feed", 4, {"lap": (F.col("lap") == "", {"value": F.col("found"), "error": F.col("error"), "none": F.lit(None)}), "flag": (F.lit(False), {})})
    noted = rows.withColumn(enrich.NEW, new)
    assert [[(x.field, x.source, x.stage, x.details) for x in r[enrich.NEW]] for r in noted.orderBy("found").collect()] == [
        [("lap", "feed", 4, {"value": "7", "error": "0.5"})], []]
    assert [tuple(r) for r in fill.unfolded(noted, enrich.NEW).collect()] == [("i", "lap", "feed", 4, {"value": "7", "error": "0.5"})]


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "meta")
    schema = "id string, season int, at long, a string, b string"
    writers.write_parquet(spark.createDataFrame([("x", 1, 0, "old", "keep"), ("y", 1, 5, "old", None), ("z", 2, 0, "z", None)], schema), path, "season")

    def files(season):
        return sorted(p.name for p in (tmp_path / "meta" / f"season={season}").glob("*.parquet"))

    untouched = files(2)
    updates = spark.createDataFrame([("y", 1, 7, "new"), ("n2", 1, 9, "second"), ("n1", 1, 8, "first"), ("x", 1, 3, None), ("q", 3, 4, "fresh")], "id string, season int, at long, a string")
    writers.upsert_partitions(path, updates, "id", "season", "at")
    got = {r.id: (r.season, r.at, r.a, r.b) for r in spark.read.parquet(path).collect()}
    assert got == {"x": (1, 0, "old", "keep"), "y": (1, 5, "new", None), "n1": (1, 6, "first", None), "n2": (1, 7, "second", None),
                   "z": (2, 0, "z", None), "q": (3, 0, "fresh", None)}
    assert files(2) == untouched


def test_correlations_are_one_scan_and_exact(spark):
    random = np.random.default_rng(5)
    cells = random.normal(1e6, 3, (400, 12)).round(3)
    cells[:, 4] = cells[:, 3] * 2 + 1
    gone = random.random(cells.shape) < 0.2
    gone[:, 5] = gone[:, 3] & ~gone[:, 2]
    rows = [tuple(None if g else float(v) for v, g in zip(vs, gs)) + (0.1, float("nan") if k == 7 else float(k), None) for k, (vs, gs) in enumerate(zip(cells, gone))]
    names = [f"k{i}" for i in range(15)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    found = selection.correlations(df, {n: F.col(n) for n in names})
    assert plan_of(found).count("MapInArrow") == 1 and "Union" not in plan_of(found)
    got = {(r.left, r.right): r["corr"] for r in found.collect()}
    assert len(got) == 105
    for i, j in combinations(range(12), 2):
        both = ~gone[:, i] & ~gone[:, j]
        assert abs(got[(f"k{i}", f"k{j}")] - np.corrcoef(cells[both, i], cells[both, j])[0, 1]) < 1e-9
    assert all(got[(f"k{i}", "k12")] is None and got[(f"k{i}", "k14")] is None for i in range(12))
    assert math.isnan(got[("k0", "k13")]) and got[("k13", "k14")] is None
    none = {(r.left, r.right): r["corr"] for r in selection.correlations(df.where("false"), {n: F.col(n) for n in names}).collect()}
    assert len(none) == 105 and set(none.values()) == {None}


def test_class_weights_and_small_dictionaries_leave_the_rows_where_they_are(spark):
    rows = spark.createDataFrame([(k % 3, ("Race", "Sprint", None)[k % 3], float(k)) for k in range(60)], "penalty_severity int, session string, lap double")
    rows = cut_lineage(rows.withColumn("lap", F.col("lap").cast("string")))
    weights = learning.weighted(rows)
    assert "BroadcastHashJoin" in plan_of(weights) and "SortMergeJoin" not in plan_of(weights)
    assert {r["weight"] for r in weights.collect()} == {1.0} and weights.count() == 60
    coder = encode.fit_encoder(rows, ["session", "lap"])
    coded = coder.transform(rows)
    assert coder.sizes == {"session": 2} and "SortMergeJoin" not in plan_of(coded)
    assert sorted({r["cat__session"] for r in coded.collect()}) == [0.0, 1.0] and coded.count() == 60
    coder.sizes["session"] = encode.SMALL + 1
    assert "SortMergeJoin" in plan_of(coder.transform(rows)) and sorted(coder.transform(rows).collect(), key=str) == sorted(coded.collect(), key=str)


def test_standings_read_the_documents_once_for_each_branch(spark):
    """The rounds of events are found once, not again wherever a row or a driver needs one."""
    rows = spark.createDataFrame(
        [("a", 2020, "", "x_1,x_2"), ("a", 2020, "7", "x_2"), ("b", 2020, "", ""), (None, 2020, "", "x_1"), ("c", 2021, "", "x_1")],
        "incident_id string, season int, round string, drivers string")
    rows = quality.conform(rows).withColumn("season", F.col("season").cast("int"))
    meta = spark.range(1234).where("id < 3").selectExpr("chr(int(97 + id)) AS incident_id", "if(id = 1, 'MONACO Grand Prix', 'Monaco') AS event", "string(id) AS car_number")
    calendar = spark.createDataFrame([(2020, 3, "Monaco Grand Prix", "ring", "land"), (2020, 2, "Spa", "wood", "land")], "season int, round int, race_name string, circuit_id string, country string")
    standing = "season int, round int, ordinal int, driver_id string, family_name string, code string, nationality string, position string, points string, constructor_id string"
    standings = spark.createDataFrame([(2020, 2, k, f"x-{k}", f"F{k}", f"C{k}", "n", str(k), str(9 - k), "t") for k in (1, 2)], standing)
    by_team = spark.createDataFrame([(2020, 2, "t", "1", "15")], "season int, round int, constructor_id string, position string, points string")
    results = spark.createDataFrame([(2020, 3, "1", "x-1", 1)], "season int, round int, number string, driver_id string, seq long")
    teams = spark.createDataFrame([("t", 1, ["u"])], "team_id string, ordinal int, legacy_ids array<string>")
    noted = enrich.note_standings(rows, meta, calendar, standings, by_team, results, teams)
    assert noted._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 1234") == 2
    got = sorted((r.incident_id or "", r["round"], r.circuit, r.drivers, r.driver_standings) for r in noted.collect())
    assert got == [("", "", "", "x_1", ""), ("a", "3", "ring", "x_1,x_2", "1,2,2"), ("a", "7", "ring", "x_2", "1,2,2"),
                   ("b", "3", "ring", "x_1", "1"), ("c", "", "", "x_1", "")]
