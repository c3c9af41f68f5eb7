"""Scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from adjudica.functions import blanks, feeds, scoring, text as tx, times
from adjudica.functions.multi import pick, split_keep
from adjudica.operators.prior import round_counts
from adjudica.queries import query
from adjudica.queries import roles
from adjudica.queries.roles import CENTS, FEED_SQL, FIELDS_SQL, INCIDENT_SQL, MULTI_SQL, table

# Built when the query runs: columns need a session.
Columns = Callable[[], dict[str, Column]]
_WS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"


def _on_fields(name: str, columns: Columns, sql: str) -> None:
    """A query over the document fields, keyed by document."""
    query(name, f"WITH f AS ({FIELDS_SQL}) SELECT document_id, {sql} FROM f")(
        lambda spark, sf: roles.fields(spark, sf).select("document_id", *[c.alias(n) for n, c in columns().items()]))


def _on_texts(name: str, columns: Columns, sql: str) -> None:
    """A query over the whole decision texts; the SQL states the fields they were built from."""
    query(name, f"WITH f AS ({FIELDS_SQL}) SELECT document_id, {sql} FROM f")(
        lambda spark, sf: roles.documents(spark, sf).select("document_id", *[c.alias(n) for n, c in columns().items()]))


def _on_incidents(name: str, columns: Columns, sql: str) -> None:
    query(name, f"WITH i AS ({INCIDENT_SQL}) SELECT row_id, {sql} FROM i")(
        lambda spark, sf: roles.incidents(spark, sf).select("row_id", *[c.alias(n) for n, c in columns().items()]))


def _on_feed(name: str, columns: Columns, sql: str) -> None:
    query(name, f"WITH e AS ({FEED_SQL}) SELECT event_id, {sql} FROM e")(
        lambda spark, sf: roles.feed(spark, sf).select("event_id", *[c.alias(n) for n, c in columns().items()]))


def _number_sql(column: str) -> str:
    return f"TRY_CAST({column} AS DOUBLE)"


@query("F01_normalize_text", f"""
    SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(
        replace(replace(text, chr(160), ' '), chr(65533), ' '), '{_WS}+', ' ', 'g')) AS t FROM documents)""")
def _(spark, sf):
    body = tx.normalize_text("text")
    return table(spark, sf, "documents").select("doc_id", F.length(body).alias("n"), F.md5(body).alias("digest"))


@query("F02_extract_field", f"WITH f AS ({FIELDS_SQL}) SELECT document_id, fact, offence, decision, reason, document_no, date, incident_time FROM f")
def _(spark, sf):
    text = F.col("text")
    rows = roles.documents(spark, sf).select("document_id", tx.plain_spaces("raw_text").alias("text"))
    labels = {"fact": "Fact", "offence": "Offence", "decision": "Decision", "reason": "Reason", "document_no": "Document", "date": "Date"}
    return rows.select("document_id", *[tx.cut_field(text, label).alias(name) for name, label in labels.items()],
                       tx.last_time_field(text).alias("incident_time"))
_on_fields("F03_document_type", lambda: {"document_type": tx.document_type("title")}, f"{roles.KIND_SQL} AS document_type")
_on_fields("F04_document_session", lambda: {"session": tx.document_session("session_text")}, f"{roles.DOC_SESSION_SQL} AS session")
_on_fields("F05_rule_session", lambda: {"session": tx.rule_session("session_text")},
           "CASE cents % 8 WHEN 0 THEN 'race' WHEN 1 THEN 'qualifying' WHEN 2 THEN 'qualifying' WHEN 3 THEN 'practice' "
           "WHEN 4 THEN 'practice' WHEN 5 THEN 'sprint' WHEN 6 THEN 'race' ELSE 'testing' END AS session")
_on_fields("F06_car_driver", lambda: {
    "car": tx.car_number(F.concat("car_number", F.lit(" - "), "driver_name")),
    "driver": tx.car_driver(F.concat("car_number", F.lit(" – "), "driver_name")),
    "plain": tx.car_driver(F.concat(F.lit(" "), "driver_name")),
}, "car_number AS car, driver_name AS driver, driver_name AS plain")
_on_fields("F07_opponent_cars", lambda: {"opponents": F.array_join(tx.opponent_cars("fact", F.col("car_number")), ",")},
           f"{roles.OPPONENTS_SQL} AS opponents")
_on_fields("F08_turn_number", lambda: {"turn": tx.turn_number("fact")},
           "CASE WHEN cents % 5 IN (0, 1) THEN CAST(cents % 20 + 1 AS STRING) ELSE '' END AS turn")
_on_fields("F09_penalty_points", lambda: {"points": tx.penalty_points("decision")},
           "CASE cents % 9 WHEN 4 THEN '2' WHEN 5 THEN '1' ELSE '' END AS points")
_on_fields("F10_penalty_label", lambda: {"label": tx.penalty_label("decision")},
           f"CASE {roles.LABEL_SQL} WHEN 'warning' THEN 'warning' ELSE {roles.LABEL_SQL} END AS label")
_on_fields("F11_driver_at_fault", lambda: {"fault": tx.driver_at_fault("reason", "fact")}, f"{roles.FAULT_SQL} AS fault")
_on_texts("F12_grand_prix", lambda: {"grand_prix": tx.grand_prix("raw_text")}, "grand_prix")


@query("F13_slugify", """SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.slug("url").alias("slug"))


_on_fields("F14_incident_type", lambda: {"incident_type": tx.incident_type("fact", "offence")}, f"{roles.TYPE_SQL} AS incident_type")


@query("F15_normalize_fact", f"""
    SELECT conv_id, turn, md5(trim(regexp_replace(lower(text), '{_WS}+', ' ', 'g'))) AS digest FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(tx.normalize_fact("text")).alias("digest"))


_on_fields("F16_stable_ids", lambda: {
    "incident_id": tx.incident_id("season", F.lower("session_text"), "car_number", "fact"),
    "doc_id": tx.document_id("season", tx.slug("event"), "title"),
}, """season || '_' || lower(session_text) || '_' || left(sha1(season || '|' || lower(session_text) || '|' || car_number
      || '|' || lower(fact)), 10) AS incident_id,
      season || '_' || trim(regexp_replace(lower(event), '[^a-z0-9]+', '_', 'g'), '_') || '_' ||
      left(sha1(season || '|' || trim(regexp_replace(lower(event), '[^a-z0-9]+', '_', 'g'), '_') || '|' || title), 12) AS doc_id""")


@query("F17_title_key", r"""
    SELECT page_id, regexp_replace(lower(replace(replace(replace(replace(replace(replace(
        t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')),
        '[^a-z0-9]+', '', 'g') AS title_key
    FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def _(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", tx.title_key(title).alias("title_key"))


@query("F18_event_name", r"""
    SELECT doc_id, trim(regexp_replace(replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')),
        'grand prix', ' '), '[^a-z0-9]+', ' ', 'g')) AS name FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.event_name("text").alias("name"))


@query("F19_id_slugs", """
    SELECT p_partkey, replace(lower(p_name), ' ', '_') AS nationality, replace(lower(p_brand || '-' || p_type), '-', '_') AS id FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", tx.nationality_slug("p_name").alias("nationality"),
        tx.id_slug(F.concat_ws("-", "p_brand", "p_type")).alias("id"))


_on_incidents("F20_years_in_sport", lambda: {"years": scoring.years_in_sport("season", F.expr(
    "CASE WHEN CAST(driver AS INT) % 10 = 0 THEN 'unknown' ELSE CAST(1990 + CAST(driver AS INT) % 15 AS STRING) END"))},
    "CASE WHEN CAST(driver AS INT) % 10 <> 0 THEN greatest(season - (1990 + CAST(driver AS INT) % 15), 0) END AS years")

_CLOCK_TEXT = roles.choose(
    CENTS, 6, f"'Incident on lap ' || CAST({CENTS} % 70 + 1 AS STRING)",
    f"CAST({CENTS} % 3 AS STRING) || ':' || lpad(CAST({CENTS} % 60 AS STRING), 2, '0') || ':05'",
    f"CAST({CENTS} % 24 AS STRING) || ':' || lpad(CAST({CENTS} % 60 AS STRING), 2, '0') || ' local'",
    "'seen at 1:02:03 by the marshal'", "'around noon'", "''")
_TIMES = {"row_id": "CAST(o_orderkey AS STRING)", "cents": CENTS, "time": _CLOCK_TEXT, "o_orderdate": "o_orderdate"}
_TIMES_SQL = roles.select_sql(_TIMES, "orders")
_METHOD_SQL = ("CASE cents % 6 WHEN 0 THEN 'lap_hint' WHEN 1 THEN 'session_elapsed' WHEN 2 THEN 'document_clock' "
               "WHEN 3 THEN 'session_elapsed' END")
_CONF_SQL = "CASE cents % 6 WHEN 0 THEN 0.85 WHEN 1 THEN 0.9 WHEN 2 THEN 0.55 WHEN 3 THEN 0.75 END"


@query("F21_parse_time_text", f"""
    WITH t AS ({_TIMES_SQL}) SELECT row_id, {_METHOD_SQL} AS method,
        CASE cents % 6 WHEN 0 THEN 0 WHEN 1 THEN cents % 3 WHEN 2 THEN cents % 24 WHEN 3 THEN 1 END AS hours,
        CASE cents % 6 WHEN 0 THEN 0 WHEN 1 THEN cents % 60 WHEN 2 THEN cents % 60 WHEN 3 THEN 2 END AS minutes,
        CASE cents % 6 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 0 WHEN 3 THEN 3 END AS seconds,
        CASE cents % 6 WHEN 0 THEN cents % 70 + 1 END AS lap_hint, CAST({_CONF_SQL} AS DOUBLE) AS confidence FROM t""")
def _(spark, sf):
    rows = roles.select(table(spark, sf, "orders"), _TIMES).withColumn("p", times.parse_time_text("time"))
    return rows.select("row_id", "p.method", "p.hours", "p.minutes", "p.seconds", "p.lap_hint", "p.confidence")


_DATES = {"row_id": "CAST(o_orderkey AS STRING)", "cents": CENTS, "day": "CAST(o_orderdate AS DATE)",
          "text": (roles.choose(CENTS, 6, "date_format(o_orderdate, 'd MMMM yyyy')", "date_format(o_orderdate, 'dd MMM yyyy')",
                                "date_format(o_orderdate, 'yyyy-MM-dd')", "date_format(o_orderdate, 'd/M/yyyy')", "'soon'", "''"),
                   "''")}


@query("F22_parse_date", f"""
    WITH d AS ({roles.select_sql(_DATES, 'orders')})
    SELECT row_id, CASE WHEN cents % 6 < 4 THEN strftime(day, '%Y-%m-%d') END AS parsed FROM d""")
def _(spark, sf):
    rows = roles.select(table(spark, sf, "orders"), _DATES)
    return rows.select("row_id", F.date_format(times.parse_date("text"), "yyyy-MM-dd").alias("parsed"))


_ELAPSED_SQL = ("CASE cents % 6 WHEN 1 THEN (cents % 3) * 3600 + (cents % 60) * 60 + 5 "
                "WHEN 2 THEN (cents % 24) * 3600 + (cents % 60) * 60 - 40200 WHEN 3 THEN 3723 END")


@query("F23_session_offset", f"""
    WITH t AS (SELECT row_id, cents, {_ELAPSED_SQL} AS s, {_CONF_SQL} AS c FROM ({_TIMES_SQL}))
    SELECT row_id, CAST(CASE WHEN s BETWEEN 0 AND 5400 THEN s END AS DOUBLE) AS "offset",
        round(CAST(c * CASE WHEN s BETWEEN 0 AND 5400 THEN 1 WHEN cents % 6 IN (1, 3) THEN 0.5 WHEN cents % 6 = 2 THEN 0.35
        ELSE 0.25 END AS DOUBLE), 6) AS confidence FROM t""")
def _(spark, sf):
    rows = roles.select(table(spark, sf, "orders"), _TIMES).withColumn("p", times.parse_time_text("time"))
    start = times.add_seconds(F.col("o_orderdate").cast("timestamp"), F.lit(40200))
    rows = rows.withColumn("o", times.session_offset(F.col("p"), start, F.col("o_orderdate").cast("date")))
    return rows.select("row_id", "o.offset", F.round("o.confidence", 6).alias("confidence"))


@query("F24_incident_instant", """
    SELECT event_id, strftime(ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS at FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.date_format(times.add_seconds(F.col("ts"), F.col("value")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


_FLAG_SQL = """CASE WHEN t LIKE '%DOUBLE YELLOW%' THEN 'double_yellow' WHEN t LIKE '%YELLOW%' THEN 'yellow' WHEN t LIKE '%RED%' THEN 'red'
    WHEN t LIKE '%VIRTUAL SAFETY CAR%' OR t LIKE '%VSC%' THEN 'vsc' WHEN t LIKE '%SAFETY CAR%' OR trim(t) = 'SC' THEN 'safety_car'
    WHEN t LIKE '%BLUE%' THEN 'blue' WHEN t LIKE '%GREEN%' THEN 'green' WHEN t LIKE '%CHEQUERED%' THEN 'chequered' ELSE '' END"""
FLAG_SQL = _FLAG_SQL.replace(" t ", " upper(coalesce(flag, '') || ' ' || coalesce(message, '')) ").replace(
    "trim(t)", "trim(upper(coalesce(flag, '') || ' ' || coalesce(message, '')))")
SECTOR_SQL = """CASE WHEN sector IN ('1', '2', '3') THEN sector
    WHEN regexp_matches(upper(message), '\\bSECTOR\\s*1\\b') THEN '1' WHEN regexp_matches(upper(message), '\\bSECTOR\\s*2\\b') THEN '2'
    WHEN regexp_matches(upper(message), '\\bSECTOR\\s*3\\b') THEN '3' WHEN TRY_CAST(sector AS INT) IS NULL THEN ''
    ELSE CAST(least(CAST(floor((CAST(sector AS INT) - 1) / 8.0) AS INT) + 1, 3) AS STRING) END"""
_on_feed("F25_flag_state", lambda: {"state": feeds.flag_state("flag", "message")}, f"{FLAG_SQL} AS state")
_on_feed("F26_track_sector", lambda: {"track_sector": feeds.track_sector("sector", "message")}, f"{SECTOR_SQL} AS track_sector")
_on_feed("F27_safety_car_state", lambda: {"state": feeds.safety_car_state("message")},
         "CASE WHEN message LIKE 'VIRTUAL SAFETY CAR%' THEN 'vsc' WHEN message LIKE 'SAFETY CAR%' THEN 'safety_car' ELSE 'none' END AS state")


def _fault() -> Column:
    drivers = F.array(F.lit("car_4"), F.concat(F.lit("d"), F.col("custkey").cast("string")))
    return scoring.infer_fault("fact", "reason", "decision", drivers)


def _severity() -> Column:
    return scoring.suggest_severity("fact", "reason", "decision", tx.penalty_label("decision"))


FAULT_VALUE_SQL = """CASE WHEN cents % 4 = 0 THEN 'none' WHEN cents % 4 = 1 THEN 'car_' || opponent
    WHEN cents % 4 = 2 OR cents % 9 = 0 THEN 'none'
    WHEN cents % 5 IN (0, 1) THEN 'car_' || car_number WHEN cents % 5 = 3 THEN 'car_' || opponent ELSE 'd' || CAST(custkey AS STRING) END"""
FAULT_SURE_SQL = """CAST(CASE WHEN cents % 4 = 0 THEN 0.88 WHEN cents % 4 = 1 THEN 0.9 WHEN cents % 4 = 2 OR cents % 9 = 0 THEN 0.72
    WHEN cents % 5 IN (0, 1, 3) THEN 0.86 ELSE 0.78 END AS DOUBLE)"""
_on_fields("F28_infer_fault", lambda: {"fault": _fault()["value"], "confidence": _fault()["confidence"]},
           f"{FAULT_VALUE_SQL} AS fault, {FAULT_SURE_SQL} AS confidence")
SEVERITY_VALUE_SQL = """least(5, CASE cents % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 4
    WHEN 6 THEN 4 WHEN 7 THEN 3 ELSE 1 END + CASE WHEN cents % 4 = 2 THEN 1 ELSE 0 END)"""
SEVERITY_SURE_SQL = """round(CAST(least(0.9, CASE cents % 9 WHEN 0 THEN 0.7 WHEN 1 THEN 0.76 WHEN 2 THEN 0.74 WHEN 3 THEN 0.82 WHEN 4 THEN 0.78
    WHEN 5 THEN 0.8 WHEN 6 THEN 0.8 WHEN 7 THEN 0.55 ELSE 0.7 END + CASE WHEN cents % 4 = 2 THEN 0.05 ELSE 0 END) AS DOUBLE), 3)"""
_on_fields("F29_suggest_severity", lambda: {"severity": _severity()["value"], "confidence": _severity()["confidence"]},
           f"{SEVERITY_VALUE_SQL} AS severity, {SEVERITY_SURE_SQL} AS confidence")
_on_incidents("F30_penalty_severity", lambda: {"severity": scoring.penalty_severity("penalty"),
                                       "strict": scoring.penalty_severity("penalty", whole_words=True)},
              "CASE penalty WHEN 'No further action' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Reprimand' THEN 1 WHEN '5s_time_penalty' THEN 1 "
              "WHEN '3_place_grid_drop' THEN 2 WHEN 'Disqualification' THEN 2 END AS severity, "
              "CASE penalty WHEN 'No further action' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Reprimand' THEN 1 WHEN '5s_time_penalty' THEN 1 "
              "WHEN '3_place_grid_drop' THEN 2 WHEN 'Disqualification' THEN 2 END AS strict")
_L, _FL = _number_sql("lap"), _number_sql("full_laps")
_on_incidents("F31_lap_progress", lambda: {
    "left": scoring.lap_remaining("lap", "full_laps"), "done": F.round(scoring.completion("lap", "full_laps"), 6),
    "valid_left": scoring.valid_lap_remaining("lap", "full_laps"), "valid_done": scoring.valid_completion("lap", "full_laps"),
}, f'{_FL} - {_L} AS "left", round({_L} / nullif({_FL}, 0) * 100, 6) AS done, CASE WHEN {_FL} < {_L} THEN 0 ELSE CAST({_FL} - {_L} AS INT) END AS valid_left, '
   f"round({_L} / nullif({_FL}, 0) * 100, 6) AS valid_done")
_on_incidents("F32_gaps", lambda: {
    "same_team": scoring.same_team("driver_team", "opponent_team"),
    "standing_difference": blanks.number("driver_standing") - blanks.number("opponent_standing"),
    "points_difference": blanks.number("driver_points") - blanks.number("opponent_points"),
}, f"coalesce(driver_team = opponent_team, false) AS same_team, {_number_sql('driver_standing')} - {_number_sql('opponent_standing')} AS standing_difference, "
   f"{_number_sql('driver_points')} - {_number_sql('opponent_points')} AS points_difference")
_on_incidents("F33_race_stage", lambda: {"stage": scoring.race_stage("completion_percentage")},
              "CASE WHEN completion_percentage <= 33 THEN 'early' WHEN completion_percentage <= 66 THEN 'middle' "
              "WHEN completion_percentage <= 85 THEN 'late' ELSE 'final_laps' END AS stage")
_on_incidents("F34_round_progress", lambda: {
    "progress": F.round(scoring.round_progress("round", F.col("rounds") - 2), 6),
    "first": F.coalesce(blanks.number("round") == 1, F.lit(False)), "last": scoring.is_last_round("round", "rounds"),
}, 'CASE WHEN round > 10 THEN 1.0 ELSE round(CAST(round / 10.0 AS DOUBLE), 6) END AS progress, coalesce(round = 1, false) AS "first", coalesce(round = 12, false) AS "last"')
_on_incidents("F35_championship_gaps", lambda: {
    "remaining": scoring.points_remaining("round", "rounds", 25),
    "contender": F.coalesce((blanks.number("driver_standing") <= 3) & (300 - blanks.number("driver_points") < 40), F.lit(False)),
    "gap": F.when(F.col("opponent").isNotNull(), F.abs(blanks.number("driver_points") - blanks.number("opponent_points"))),
}, f"CAST((12 - round) * 25 AS DOUBLE) AS remaining, {_number_sql('driver_standing')} <= 3 AND 300 - {_number_sql('driver_points')} < 40 AS contender, "
   f"CASE WHEN opponent IS NOT NULL THEN abs({_number_sql('driver_points')} - {_number_sql('opponent_points')}) END AS gap")
_on_incidents("F36_similarity_key", lambda: {"key": F.concat_ws("|", scoring.similarity_value("penalty"), scoring.similarity_value("opponent"))},
              """coalesce(nullif(lower(trim(penalty)), ''), '__missing__') || '|' || coalesce(nullif(lower(trim(opponent)), ''), '__missing__') AS "key" """)
_on_incidents("F37_clamp_severity", lambda: {"severity": scoring.clamp_severity(F.col("penalty_severity") * 3 - 2)},
              "greatest(0, least(2, penalty_severity * 3 - 2)) AS severity")
_on_incidents("F38_is_warning", lambda: {"warning": scoring.is_warning("penalty", "penalty_severity")},
              "penalty IN ('Warning', 'Reprimand') OR (penalty_severity = 1 AND NOT contains(lower(penalty), 'no_further')) AS warning")
_on_incidents("F39_deviation", lambda: {
    "direction": scoring.label_or_zero(F.lit(1)) - scoring.label_or_zero("penalty_severity"),
    "magnitude": F.abs(scoring.label_or_zero("opponent_points") - scoring.label_or_zero("penalty_severity")),
}, f"1 - penalty_severity AS direction, abs(CAST(coalesce({_number_sql('opponent_points')}, 0) AS INT) - penalty_severity) AS magnitude")
_on_fields("F40_text_sections", lambda: {"body": F.concat_ws("\n", tx.section("FACT", "fact"), tx.section("OFFENCE", "offence"))},
           "concat_ws(chr(10), CASE WHEN fact <> '' THEN '[FACT] ' || fact END, CASE WHEN offence <> '' THEN '[OFFENCE] ' || offence END) AS body")


@query("F41_truncate", """
    SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text ELSE left(text, 200) || '...' || right(text, 197) END) AS digest FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.truncate("text", 100)).alias("digest"))


query("F42_license_points", f"""
    WITH m AS ({MULTI_SQL}) SELECT incident_id, CASE superlicense_points_added WHEN '1' THEN 1 WHEN '2.0' THEN 2 ELSE 0 END AS points FROM m""")(
    lambda spark, sf: roles.multi_incidents(spark, sf).select(
        "incident_id", scoring.license_points("superlicense_points_added").alias("points")))
query("F43_blank_tests", f"""
    WITH m AS ({MULTI_SQL}) SELECT incident_id, flag IN ('', 'nan') AS flag_blank, flag = '' AS flag_missing,
    trim(sector) = '' AS sector_blank FROM m""")(
    lambda spark, sf: roles.multi_incidents(spark, sf).select(
        "incident_id", blanks.is_blank("flag").alias("flag_blank"), blanks.is_missing("flag").alias("flag_missing"),
        blanks.is_blank("sector").alias("sector_blank")))
_on_incidents("F44_bool_to_int", lambda: {
    "from_bool": blanks.bool_to_int(F.col("penalty_severity") > 0),
    "from_text": blanks.bool_to_int(F.when(F.col("penalty_severity") == 0, "True").when(F.col("penalty_severity") == 1, "False").otherwise("maybe")),
}, "CAST(penalty_severity > 0 AS INT) AS from_bool, CASE penalty_severity WHEN 0 THEN 1 WHEN 1 THEN 0 END AS from_text")


@query("F45_clock_to_seconds", f"""
    WITH t AS ({_TIMES_SQL}) SELECT row_id, CAST((cents % 24) * 3600 + (cents % 60) * 60 AS DOUBLE) AS short,
        CAST((cents % 24) * 3600 + (cents % 60) AS DOUBLE) AS legacy,
        CAST(CASE WHEN cents % 6 = 1 THEN (cents % 3) * 3600 + (cents % 60) * 60 + 5 END AS DOUBLE) AS long FROM t""")
def _(spark, sf):
    rows = roles.select(table(spark, sf, "orders"), _TIMES)
    clock = F.concat_ws(":", (F.col("cents") % 24).cast("string"), (F.col("cents") % 60).cast("string"))
    return rows.select("row_id", times.clock_to_seconds(clock).alias("short"),
                       times.clock_to_seconds(clock, legacy=True).alias("legacy"),
                       F.when(F.col("cents") % 6 != 2, times.clock_to_seconds("time")).alias("long"))


@query("F46_fact_text", f"""
    WITH f AS ({FIELDS_SQL}) SELECT document_id, concat_ws(' ', nullif(fact, ''), nullif(reason, '')) AS body FROM f""")
def _(spark, sf):
    rows = roles.fields(spark, sf)
    return rows.select("document_id", blanks.fact_text(rows).alias("body"))


_on_incidents("F47_rule_values", lambda: {"token": blanks.token("penalty"), "number": blanks.number("full_laps")},
              f'lower(trim(penalty)) AS token, {_FL} AS "number"')


@query("F48_schedule_instant", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 14:10:00' AS start_ts,
        CASE o_orderstatus WHEN 'F' THEN 'Race' WHEN 'O' THEN 'Qualifying' ELSE 'FirstPractice' END AS schedule_key FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders")
    start = times.schedule_instant(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("14:10:00Z"))
    session = F.expr("CASE o_orderstatus WHEN 'F' THEN 'race' WHEN 'O' THEN 'Qualifying' ELSE 'practice' END")
    return rows.select("o_orderkey", F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start_ts"),
                       times.schedule_key(session).alias("schedule_key"))


@query("F49_class_rates", f"""
    WITH i AS ({INCIDENT_SQL}) SELECT circuit, season, round, round(count(*) FILTER (penalty_severity = 2) / count(*), 6) AS major_rate,
        round(count(*) FILTER (penalty_severity = 2) / nullif(count(*) FILTER (penalty_severity = 1), 0), 6) AS ratio
    FROM i WHERE round IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    level = F.col("penalty_severity")
    grain = round_counts(roles.incidents(spark, sf), ["circuit"], {"minor": level == 1, "major": level == 2})
    return grain.select("circuit", "season", "round", F.round(scoring.class_rate(F.col("_major"), F.col("_rows")), 6).alias("major_rate"),
                        F.round(scoring.class_rate(F.col("_major"), F.col("_minor")), 6).alias("ratio"))


@query("F50_positional_pick", f"""
    WITH m AS ({MULTI_SQL}), s AS (SELECT incident_id, CASE WHEN nationalities = '' THEN [] ELSE string_split(nationalities, ',') END AS n FROM m)
    SELECT incident_id, nullif(CASE WHEN len(n) = 1 THEN n[1] ELSE n[2] END, '') AS second, nullif(n[1], '') AS "first" FROM s""")
def _(spark, sf):
    cells = split_keep("nationalities")
    return roles.multi_incidents(spark, sf).select(
        "incident_id", pick(cells, F.lit(1)).alias("second"), pick(cells, F.lit(0)).alias("first"))


_on_feed("F51_nearest_state", lambda: {
    "flag_state": feeds.flag_state(F.lit(None), "message"), "track_sector": feeds.track_sector("sector", F.lit(None)),
}, f"{FLAG_SQL.replace('coalesce(flag, {0})'.format(repr('')), repr(''))} AS flag_state, "
   "CASE WHEN TRY_CAST(sector AS INT) IS NULL THEN '' WHEN sector IN ('1', '3') THEN sector WHEN sector = '9' THEN '2' ELSE '3' END AS track_sector")
_on_fields("F52_event_token", lambda: {"token": tx.event_token("event"), "stem": tx.event_stem("event")},
           "trim(replace(lower(event), 'grand prix', '')) AS token, trim(replace(lower(event), 'grand prix', '')) AS stem")

