"""Fields cut where their labels stand against a search of the whole text."""

import random

from pyspark.sql import functions as F

from adjudica.constants import FIELD_LABELS
from adjudica.functions import text as tx
from adjudica.operators.documents import parse_documents

PIECES = [*FIELD_LABELS, "no", "FACT", "reason", "time", "update", "Facts", "sometime", "Competitors are reminded", "Decisions of the Stewards",
          "\n", "\n", "\n", "\n\n", " \n ", " ", " ", "\t", "\u00a0", "\ufffd", "\u2003\n", "a word", "18:21", "\u0130", "1 - A B"]


def texts():
    rng = random.Random(11)
    out = ["", None, "Fact", "Fact\n", "Fact\n\n", "Fact\nFact\nx", "\nTime\nTime\nx", "Time\n1\nTime\n2\nTime \n3\nDate\n4"]
    out += ["".join(rng.choices(PIECES, k=rng.randint(1, 40))) for _ in range(4000)]
    blocks = ["\n".join(f"{label}\n{rng.choice(['one two', 'x', 'fact', 'a time b'])}" for label in rng.sample(list(FIELD_LABELS), 6)) for _ in range(500)]
    return out + blocks


def test_fields_equal_a_search_of_the_whole_text(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "raw string").select(tx.plain_spaces("raw").alias("text")).withColumn("low", tx.lowered("text"))
    text, low = F.col("text"), F.col("low")
    for label in (*FIELD_LABELS, "No"):
        if label == "Reason":
            want = F.split_part(tx._searched_reason(text), F.lit("Competitors are reminded"), F.lit(1))
        else:
            want = tx._searched(text, label)
        pair = rows.select("text", tx.field_of(text, low, label).alias("got"), tx.normalize_text(want).alias("want"))
        assert pair.where(F.col("got") != F.col("want")).limit(3).collect() == [], label
        assert pair.where("got <> ''").count() > 100
    times = rows.select("text", tx.time_of(text, low).alias("got"), tx.last_time_field(text).alias("want"))
    assert times.where(F.col("got") != F.col("want")).limit(3).collect() == []


def test_a_long_text_is_read_once(spark):
    body = "the driver of car 4 left the track at that time and date in fact " * 20_000
    row = spark.createDataFrame([(f"Document\n7\nFact\n{body}\nOffence\nx\nReason\n{body}",)], "raw string").select(tx.plain_spaces("raw").alias("text")).withColumn(
        "low", tx.lowered("text")).select(*[tx.field_of(F.col("text"), F.col("low"), n).alias(n) for n in ("Document", "Fact", "Offence", "Reason")]).first()
    assert row.Document == "7" and row.Fact == body.strip() and row.Offence == "x" and row.Reason == body.strip()


def test_a_text_is_put_in_order_once(spark):
    """Each of these read its input several times: in a condition, in its branches, and in a branch for plain texts."""
    rows = spark.createDataFrame([("Doc - Decision - x", "a  b")], "title string, body string")
    title = rows.select(tx.loose_title("title").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert title.count("regexp_replace") == 2
    body = rows.select(tx.normalize_text("body").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert body.count("regexp_replace") == 1 and body.count("replace(") == 1


def test_parsed_fields_equal_a_search_of_the_whole_text(spark):
    rows = spark.createDataFrame([(i, "Decision", t) for i, t in enumerate(texts())], "document_id long, title string, raw_text string")
    got = parse_documents(rows).select("document_id", "parsed_fields.*")
    text = tx.plain_spaces("raw_text")
    searched = {label: tx.normalize_text(tx._searched(text, label)) for label in ("Fact", "Decision", "Offence", "Infringement", "Document", "No", "Date")}
    filled = F.when(searched["Offence"] != "", searched["Offence"]).otherwise(searched["Infringement"])
    numbered = F.when(searched["Document"] != "", searched["Document"]).otherwise(searched["No"])
    want = rows.select("document_id", searched["Fact"].alias("w_fact"), searched["Decision"].alias("w_decision"), filled.alias("w_offence"),
                       numbered.alias("w_document_no"), searched["Date"].alias("w_date"), tx.last_time_field(text).alias("w_incident_time"))
    both = got.join(want, "document_id")
    for name in ("fact", "decision", "offence", "document_no", "date", "incident_time"):
        assert both.where(F.col(name) != F.col(f"w_{name}")).limit(3).collect() == [], name
        assert both.where(F.col(name) != "").count() > 100
