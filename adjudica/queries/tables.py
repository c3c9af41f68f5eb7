"""Scans and sinks. Each query writes a derived table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.constants import INCIDENT_COLUMNS
from adjudica.functions import text as tx
from adjudica.functions.multi import split_keep
from adjudica.operators import compare, fill, quality
from adjudica.operators.documents import parse_documents
from adjudica.operators.splits import present_seasons
from adjudica.queries import query, roles
from adjudica.queries.aggregates import ruled, rounded, RULED_SQL
from adjudica.queries.joins import DOC_TABLE_SQL, STANDING_SQL, TEXT_ROWS_SQL, ALL_PRED_SQL, all_predictions, document_table, standings
from adjudica.queries.projections import META_SQL, REVIEW_SQL, circuits, meta
from adjudica.queries.roles import FEED_SQL, FIELDS_SQL, LAPS, MESSAGES, MULTI_SQL, table
from adjudica.session import new_path
from adjudica.sources import readers, writers


def season_files(spark, sf) -> str:
    """A processed table per season, each with a legend row."""
    root = new_path(spark, "processed")
    rows = quality.conform(roles.multi_incidents(spark, sf))
    for season in present_seasons(rows):
        part = rows.where(F.col("season") == str(season))
        legend = quality.conform(spark.range(1).select(F.lit("* legend").alias("incident_id"), F.lit("**").alias("drivers")))
        writers.write_csv(part.unionByName(legend), f"{root}/processed_{season}.csv")
    return root


@query("S01_season_csv_scan", f"""WITH m AS ({MULTI_SQL}) SELECT incident_id, season, TRY_CAST(nullif(round, '') AS INT) AS round, drivers, nationalities,
    CAST(season AS STRING) AS source_season FROM m""")
def _(spark, sf):
    root = season_files(spark, sf)
    rows = readers.read_processed(spark, readers.input_paths(spark, root))
    return rows.select("incident_id", "season", "round", "drivers", "nationalities", "source_season")


@query("S02_input_resolution", f"WITH m AS ({MULTI_SQL}) SELECT season, count(*) AS rows FROM m WHERE season IN (1996, 1999) GROUP BY 1")
def _(spark, sf):
    root = season_files(spark, sf)
    paths = readers.input_paths(spark, root, seasons=[1996, 1999])
    return readers.read_processed(spark, paths, ordered=False).groupBy("season").agg(F.count(F.lit(1)).alias("rows"))


@query("S03_parsed_document_scan", f"""WITH f AS ({FIELDS_SQL}) SELECT document_id, {roles.KIND_SQL} AS document_type, fact, decision,
    {roles.OPPONENTS_SQL} AS opponents FROM f""")
def _(spark, sf):
    path = writers.write_json(parse_documents(roles.documents(spark, sf)), new_path(spark, "documents"))
    docs = readers.read_documents(spark, path, one_per_file=False)
    return docs.select("document_id", "document_type", "parsed_fields.fact", "parsed_fields.decision",
                       F.array_join("parsed_fields.opponent_car_numbers", ",").alias("opponents"))


@query("S04_catalogue_scan", f"""WITH f AS ({FIELDS_SQL}) SELECT document_id, event, 'nation_' || CAST(custkey % 25 AS STRING) || '_grand_prix' AS event_slug,
    title, sha256(title) AS sha256, season FROM f""")
def _(spark, sf):
    rows = roles.fields(spark, sf).select(
        "document_id", F.lit("https://example.org").alias("url"), F.lit("").alias("local_path"), "event", tx.slug("event").alias("event_slug"),
        "title", F.sha2("title", 256).alias("sha256"), "season")
    path = writers.write_json(rows, new_path(spark, "catalogue"))
    return readers.read_catalogue(spark, path, one_per_file=False).drop("url", "local_path")


@query("S05_raw_texts", r"""SELECT doc_id AS document_id, md5(replace(replace(text, chr(160), ' '), chr(65533), ' ')) AS digest, NULL AS error FROM documents WHERE trim(text) <> ''
    UNION ALL SELECT doc_id, NULL, 'empty text' FROM documents WHERE trim(text) = ''""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw_text"))
    good, bad = readers.usable_texts(rows)
    return good.select("document_id", F.md5("raw_text").alias("digest"), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("document_id", F.lit(None).cast("string").alias("digest"), "error"))


@query("S06_meta_read_upsert", f"""WITH t AS ({META_SQL}) SELECT incident_id, document_id, parse_confidence,
    CASE WHEN parse_confidence < 0.7 THEN 'lap_hint' END AS time_parse_method FROM t""")
def _(spark, sf):
    stored = meta(spark, sf).withColumns({"car_number": F.lit("1"), "time": F.lit(""), "date": F.lit("")})
    path = writers.write_json(stored, new_path(spark, "meta"))
    current = readers.read_meta(spark, path, one_per_file=False)
    updates = current.where("parse_confidence < 0.7").select("incident_id", F.lit("lap_hint").alias("time_parse_method"))
    return fill.upsert(current, updates, "incident_id").select("incident_id", "document_id", "parse_confidence", "time_parse_method")


_STORED = {"incident_id": roles.MULTI["incident_id"], "season": "CAST(year(o_orderdate) AS INT)", "ordinal": "CAST(o_orderkey AS BIGINT)",
           "document_id": "'doc_' || CAST(o_orderkey AS STRING)"}
_CHANGED = {**_STORED, "document_id": "CASE WHEN o_custkey % 2 = 0 THEN 'updated' END", "lap_hint": "CAST(o_custkey % 60 AS INT)"}


@query("S06_partition_upsert", f"""WITH s AS ({roles.select_sql(_STORED, 'orders WHERE o_totalprice >= 60000')}), u AS (SELECT * FROM ({roles.select_sql(_CHANGED, 'orders WHERE o_totalprice < 200000')})
        WHERE season IN (1996, 1997)), e AS (SELECT season, max(ordinal) + 1 AS last FROM s GROUP BY 1), f AS (SELECT season, min(ordinal) AS first FROM u WHERE incident_id NOT IN (SELECT incident_id FROM s) GROUP BY 1)
    SELECT coalesce(s.incident_id, u.incident_id) AS incident_id, coalesce(s.season, u.season) AS season, coalesce(u.document_id, s.document_id) AS document_id, u.lap_hint,
        coalesce(s.ordinal, e.last + u.ordinal - f.first) AS ordinal
    FROM s FULL OUTER JOIN u ON s.incident_id = u.incident_id LEFT JOIN e ON e.season = u.season LEFT JOIN f ON f.season = u.season""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    stored = roles.select(orders.where("o_totalprice >= 60000"), _STORED).withColumn("lap_hint", F.lit(None).cast("int"))
    path = writers.write_parquet(stored, new_path(spark, "meta-by-season"), "season")
    changed = roles.select(orders.where("o_totalprice < 200000"), _CHANGED).where("season IN (1996, 1997)")
    writers.upsert_partitions(path, changed, "incident_id", "season", "ordinal")
    return spark.read.parquet(path).select("incident_id", "season", "document_id", "lap_hint", "ordinal")


@query("S07_reference_dimensions", """SELECT 'ring_' || n_nationkey AS circuit, 'land_' || n_nationkey AS country, 1950 + n_nationkey AS first_season,
    50 + n_nationkey AS total_laps, 2 AS sector_of_turn_8, n_nationkey AS ordinal FROM nation WHERE n_regionkey <> 4""")
def _(spark, sf):
    ring = circuits(spark, sf)
    value = F.to_json(F.struct("country", "first_season", "total_laps", "event_name", "corners"))
    # A curated dimension of one row per circuit becomes one keyed object.
    member = F.concat(F.lit('"'), F.col("circuit"), F.lit('":'), value)
    listed = ring.agg(F.array_sort(F.collect_list(F.struct("ordinal", member.alias("m")))).alias("e"))
    keyed = listed.select(F.concat(F.lit("{"), F.array_join("e.m", ","), F.lit("}")).alias("value"))
    path = writers.write_texts(keyed, new_path(spark, "circuits"))
    back = readers.read_circuits(spark, path)
    back = back.select("circuit", "country", "first_season", "total_laps", F.try_element_at("corners", F.lit("8")).alias("sector_of_turn_8"))
    return back.join(ring.select("circuit", "ordinal"), "circuit")


def standings_payload(spark, sf):
    """One payload per (season, round): at most one entry per nation."""
    rows = standings(spark, sf)
    driver = F.struct(F.col("driver_id").alias("driverId"), F.col("family_name").alias("familyName"), "code", "nationality")
    entry = F.struct("ordinal", "position", "points", driver.alias("Driver"),
                     F.array(F.struct(F.col("constructor_id").alias("constructorId"))).alias("Constructors"))
    lists = rows.groupBy("season", "round").agg(F.array_sort(F.collect_list(entry)).alias("DriverStandings"))
    table_ = F.struct(F.col("season").cast("string").alias("season"), F.col("round").cast("string").alias("round"),
                      F.array(F.struct("DriverStandings")).alias("StandingsLists"))
    return lists.select(F.to_json(F.struct(F.struct(table_.alias("StandingsTable")).alias("MRData"))).alias("value"))


@query("S08_standings_payload", f"""WITH {STANDING_SQL} SELECT season, round, position - 1 AS ordinal, CASE WHEN k % 5 = 0 THEN 'alias-' || k ELSE 'nation-' || k END AS driver_id,
    CAST(position AS STRING) AS position, CAST(points AS STRING) AS points, 'old-' || (k % 5) AS constructor_id FROM st""")
def _(spark, sf):
    path = writers.write_texts(standings_payload(spark, sf), new_path(spark, "standings"))
    return readers.read_driver_standings(spark, path).select("season", "round", "ordinal", "driver_id", "position", "points", "constructor_id")


@query("S09_schedule_payload", """WITH r AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS season, CAST(month(o_orderdate) AS INT) AS round FROM orders)
    SELECT season, round, 'race' AS session, season || '-' || lpad(CAST(round AS STRING), 2, '0') || '-15 13:10:00' AS start_ts FROM r
    UNION ALL SELECT season, round, 'qualifying', season || '-' || lpad(CAST(round AS STRING), 2, '0') || '-14 15:00:00' FROM r WHERE round % 2 = 0
    UNION ALL SELECT season, round, 'practice', season || '-' || lpad(CAST(round AS STRING), 2, '0') || '-13 09:30:00' FROM r""")
def _(spark, sf):
    path = writers.write_texts(schedule_payload(spark, sf), new_path(spark, "schedule"))
    return readers.read_schedule(spark, path).withColumn("start_ts", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss"))


def schedule_payload(spark, sf):
    rounds = table(spark, sf, "orders").selectExpr("CAST(year(o_orderdate) AS INT) AS season", "CAST(month(o_orderdate) AS INT) AS round").distinct()
    day = lambda d: F.concat_ws("-", F.col("season").cast("string"), F.lpad(F.col("round").cast("string"), 2, "0"), F.lit(d))
    race = F.struct(
        F.col("round").cast("string").alias("round"), F.concat(F.lit("Race "), "round").alias("raceName"), day("15").alias("date"), F.lit("13:10:00Z").alias("time"),
        F.struct(day("13").alias("date"), F.lit("09:30:00Z").alias("time")).alias("FirstPractice"),
        F.when(F.col("round") % 2 == 0, F.struct(day("14").alias("date"), F.lit("15:00:00Z").alias("time"))).alias("Qualifying"))
    table_ = F.struct(F.col("season").cast("string").alias("season"), F.array(race).alias("Races"))
    return rounds.select(F.to_json(F.struct(F.struct(table_.alias("RaceTable")).alias("MRData"))).alias("value"))


@query("S10_race_feed_scan", f"""WITH e AS ({FEED_SQL}) SELECT session_key, driver_number, lap_number, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS date_start FROM e WHERE event_type = '{LAPS}'""")
def _(spark, sf):
    laps = roles.feed(spark, sf, LAPS).select("session_key", "driver_number", "lap_number", F.date_format(
        "ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date_start"))
    path = writers.write_json(laps, new_path(spark, "laps"))
    return readers.read_feed(spark, path, "laps").withColumn("date_start", F.date_format("date_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("S11_session_frames", f"""WITH e AS ({FEED_SQL}) SELECT day AS round, message AS "Message", sector AS "Sector", round(seconds, 6) AS "Time" FROM e WHERE event_type = '{MESSAGES}'""")
def _(spark, sf):
    frames = roles.feed(spark, sf, MESSAGES).select(
        F.lit(2024).alias("season"), F.col("day").alias("round"), F.lit("race").alias("session"), F.col("seconds").alias("Time"),
        F.col("message").alias("Message"), F.col("flag").alias("Flag"), F.col("sector").alias("Sector"))
    path = writers.write_parquet(frames, new_path(spark, "messages"), "season")
    return readers.read_session_frame(spark, path, "messages").select("round", "Message", "Sector", F.round("Time", 6).alias("Time"))


@query("S12_incident_csv_round_trip", f"WITH m AS ({MULTI_SQL}) SELECT incident_id, drivers, nationalities, lap FROM m")
def _(spark, sf):
    path = writers.write_csv(quality.conform(roles.multi_incidents(spark, sf)), new_path(spark, "raw") + "/raw_incidents.csv")
    return readers.read_csv(spark, [path]).select("incident_id", "drivers", "nationalities", "lap")


@query("S13_review_csv_sink", f"WITH {REVIEW_SQL} SELECT incident_id, array_to_string(list_transform(string_split(drivers, ','), lambda v: trim(v)), ',') AS drivers, review_reasons FROM rv WHERE review_reasons <> ''")
def _(spark, sf):
    queue = quality.review_queue(roles.multi_incidents(spark, sf), meta(spark, sf))
    queue = queue.select("incident_id", split_keep("drivers").alias("drivers"), "review_reasons")
    path = writers.write_csv(queue, new_path(spark, "review") + "/review_queue.csv")
    return readers.read_csv(spark, [path], ("incident_id", "drivers", "review_reasons")).drop("source_file")


@query("S14_partitioned_parquet", f"WITH m AS ({MULTI_SQL}) SELECT season, count(*) AS rows, min(incident_id) AS first_id FROM m WHERE season >= 1999 GROUP BY 1")
def _(spark, sf):
    path = writers.write_parquet(roles.multi_incidents(spark, sf).select("incident_id", "season", "drivers"), new_path(spark, "incidents"), "season")
    rows = spark.read.parquet(path).where("season >= 1999")
    return rows.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.min("incident_id").alias("first_id"))


@query("S15_text_json_lines", f"WITH {TEXT_ROWS_SQL} SELECT row_id, md5(text) AS digest FROM joined WHERE drop_reason IS NULL")
def _(spark, sf):
    from adjudica.operators.flatten import flatten_incidents
    from adjudica.operators.textset import text_rows
    rows = text_rows(flatten_incidents(roles.multi_incidents(spark, sf)), meta(spark, sf).drop("event"), document_table(spark, sf))
    path = writers.write_json(rows.where("drop_reason IS NULL").select("row_id", "text"), new_path(spark, "texts"))
    return spark.read.schema("row_id string, text string").json(path).select("row_id", F.md5("text").alias("digest"))


@query("S16_prediction_sink", f"WITH {RULED_SQL} SELECT row_id, detail AS normative_penalty_detail, ruled AS normative_penalty_severity FROM dev")
def _(spark, sf):
    rows = ruled(spark, sf).select("row_id", "normative_penalty_detail", "normative_penalty_severity", "normative_rule_id")
    path = writers.write_json(rows, new_path(spark, "outcomes"))
    return spark.read.schema("row_id string, normative_penalty_detail string, normative_penalty_severity int").json(path)


@query("S17_prediction_column", f"SELECT row_id, pred FROM ({ALL_PRED_SQL})")
def _(spark, sf):
    path = writers.write_json(all_predictions(spark, sf), new_path(spark, "predictions"))
    stored = spark.read.schema("row_id string, pred int, proba_minor double").json(path)
    return stored.select("row_id", F.col(compare.prediction_column(stored)).alias("pred"))


@query("S18_metric_sink", f"WITH m AS ({MULTI_SQL}) SELECT '{INCIDENT_COLUMNS[0]}' AS \"column\", 1.0 AS fill_rate UNION ALL "
       "SELECT 'lap', 1.0 UNION ALL SELECT 'flag', round(avg(CASE WHEN flag IN ('', 'nan') THEN 0.0 ELSE 1 END), 4) FROM m")
def _(spark, sf):
    rates = quality.fill_rates(roles.multi_incidents(spark, sf), ("incident_id", "lap", "flag"))
    path = writers.write_json(rates, new_path(spark, "quality"))
    return rounded(spark.read.schema("column string, fill_rate double").json(path))


@query("S19_last_fact_text", f"WITH {DOC_TABLE_SQL} SELECT season || '_' || car_number AS incident_id, arg_max(fact, seq) AS fact FROM docs WHERE fact <> '' GROUP BY 1")
def _(spark, sf):
    docs = document_table(spark, sf).withColumn("incident_id", F.concat_ws("_", F.col("season").cast("string"), "car_number"))
    return readers.facts_by_incident(docs, "seq")


