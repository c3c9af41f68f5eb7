"""E01-E11 enrichment, M01-M19 learning and N01-N09 rule jobs."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from adjudica.constants import QUALITY_GATES
from adjudica.functions import text as tx
from adjudica.functions.blanks import number
from adjudica.operators import features, fill, learning, match, metrics, points, prior, quality, rules, selection, splits
from adjudica.operators.documents import parse_documents
from adjudica.plans import enrich, jobs
from adjudica.queries import query, roles
from adjudica.queries.aggregates import (
    BREAKDOWN_SQL, GATE_SQL, RULED_SQL, importances, rounded, ruled, summary_sql,
)
from adjudica.queries.joins import (
    LISTED_SQL, NUMBER_SQL, PRED2_SQL, PRED_SQL, SESSION_KEY_SQL, STANDING_SQL, TEAM_SQL, TEXT_ROWS_SQL, document_table, facts, predictions,
    results, roster, season_tables, sessions, standings, tabular_predictions, team_standings, teams,
)
from adjudica.queries.projections import (
    CIRCUIT_SQL, FLAT_SQL, META, META_FROM, INCIDENT_OUT, INCIDENT_OUT_SQL, INCIDENT_ROW_SQL, META_SQL, REVIEW_SQL, SPLITS, SPLIT_SQL,
    circuits, meta, provenance,
)
from adjudica.queries.roles import CENTS, FEED_SQL, FIELDS_SQL, INCIDENT_SQL, LAPS, MESSAGES, MULTI_SQL, POSITIONS, PROBE, choose, table
from adjudica.queries.scalars import FAULT_SURE_SQL, FAULT_VALUE_SQL, FLAG_SQL, SECTOR_SQL, SEVERITY_SURE_SQL, SEVERITY_VALUE_SQL
from adjudica.queries.windows import HISTORY_SQL, POINTS_SQL, PRIMARY_SQL, ruled_sql
from adjudica.rulesets import DEFAULT_RULES, rule
from adjudica.session import new_path
from adjudica.sources import writers


def calendar(spark, sf):
    """Every nation of a season hosts one race."""
    return table(spark, sf, "orders").selectExpr(
        "CAST(year(o_orderdate) AS INT) AS season", "CAST(o_custkey % 25 + 1 AS INT) AS round",
        "'Nation ' || CAST(o_custkey % 25 AS STRING) || ' Grand Prix' AS race_name", "'fetched_' || CAST(o_custkey % 25 AS STRING) AS circuit_id",
        "'land_' || CAST(o_custkey % 25 AS STRING) AS country").distinct()


def processed(spark, sf):
    """Incident rows in the fixed 38 columns, season typed."""
    return quality.conform(roles.multi_incidents(spark, sf)).withColumn("season", F.col("season").cast("int"))


@query("E01_reference_enrichment", f"""WITH m AS ({MULTI_SQL}), t AS ({META_SQL}), {CIRCUIT_SQL}, {STANDING_SQL},
    r AS (SELECT season, count(DISTINCT k) AS rounds FROM sg GROUP BY season),
    e AS (SELECT m.*, nat.k, nat.country FROM m LEFT JOIN t ON m.incident_id = t.incident_id LEFT JOIN nat ON t.event = 'Nation ' || nat.k || ' Grand Prix')
    SELECT incident_id, coalesce(nullif(round, ''), CAST(k + 1 AS STRING), '') AS round, coalesce(country, '') AS country, CAST(r.rounds AS STRING) AS rounds,
        CASE WHEN session = 'Race' AND full_laps = '' AND k IS NOT NULL THEN CAST(50 + k AS STRING) ELSE full_laps END AS full_laps FROM e JOIN r ON e.season = r.season""")
def _(spark, sf):
    drivers, season, by_team = season_tables(spark, sf)
    dims = calendar(spark, sf).select("season", F.concat(F.lit("ring_"), (F.col("round") - 1).cast("string")).alias("circuit"), "round")
    counts = dims.groupBy("season").agg(F.countDistinct("circuit").alias("rounds")).withColumn("num_teams", F.lit(5))
    rows = enrich.enrich_reference(processed(spark, sf), meta(spark, sf), circuits(spark, sf), drivers, teams(spark, sf),
                                   {"calendar": dims, "seasons": counts, "drivers": season, "teams": by_team})
    return rows.select("incident_id", "round", "country", "rounds", "full_laps")


# A car's driver of the round, by number: incidents without a party are those of their document's car.
_WITH_CAR = {**META, "car_number": "CAST(o_custkey % 99 + 1 AS STRING)"}
_RACED = {"season": "CAST(year(o_orderdate) AS INT)", "round": "CAST(o_custkey % 25 + 1 AS INT)", "number": "CAST(o_custkey % 99 + 1 AS STRING)",
          "driver_id": "'Nation-' || CAST(o_custkey % 7 AS STRING)", "seq": "o_orderkey"}


@query("E02_standings_enrichment", f"""WITH m0 AS ({MULTI_SQL}), t AS ({roles.select_sql(_WITH_CAR, META_FROM)}), {STANDING_SQL},
    ra AS (SELECT season, round, number, arg_max(replace(lower(driver_id), '-', '_'), seq) AS driver FROM ({roles.select_sql(_RACED, 'orders')}) GROUP BY ALL),
    ev AS (SELECT incident_id, car_number, CASE WHEN event <> '' THEN CAST(regexp_extract(event, '([0-9]+)', 1) AS INT) + 1 END AS r FROM t),
    m AS (SELECT m0.* REPLACE (CASE WHEN trim(m0.drivers) = '' AND ra.driver IS NOT NULL THEN ra.driver ELSE m0.drivers END AS drivers), ev.r FROM m0 LEFT JOIN ev ON m0.incident_id = ev.incident_id
        LEFT JOIN ra ON m0.season = ra.season AND ev.r = ra.round AND ev.car_number = ra.number),
    l AS (SELECT *, list_transform(string_split(drivers, ','), lambda v: trim(v)) AS ds FROM m WHERE drivers <> ''),
    x AS (SELECT incident_id, season, r, unnest(ds) AS driver, unnest(range(len(ds))) AS pos FROM l),
    d AS (SELECT *, CASE WHEN starts_with(driver, 'nation_') THEN CAST(split_part(driver, '_', 2) AS INT) END AS k FROM x),
    q AS (SELECT d.incident_id, d.pos, st.position, st.points, CASE WHEN st.k IS NULL THEN NULL ELSE {TEAM_SQL.format('st.k')} END AS team, tst.position AS tp
        FROM d LEFT JOIN st ON d.season = st.season AND d.r = st.round + 1 AND d.k = st.k
        LEFT JOIN tst ON st.season = tst.season AND st.round = tst.round AND st.k % 5 = tst.t),
    cells AS (SELECT incident_id, string_agg(coalesce(CAST(position AS STRING), ''), ',' ORDER BY pos) AS ds, string_agg(coalesce(CAST(points AS STRING), ''), ',' ORDER BY pos) AS pt,
        string_agg(coalesce(team, ''), ',' ORDER BY pos) AS tm, string_agg(coalesce(CAST(tp AS STRING), ''), ',' ORDER BY pos) AS cs, count(position) AS hits FROM q GROUP BY 1)
    SELECT m.incident_id, m.drivers, CASE WHEN hits > 0 THEN ds ELSE m.driver_standings END AS driver_standings, CASE WHEN hits > 0 THEN pt ELSE m.driver_points END AS driver_points,
        CASE WHEN hits > 0 THEN tm ELSE m.respective_teams END AS respective_teams, CASE WHEN hits > 0 THEN cs ELSE '' END AS construct_standings,
        CAST(CASE WHEN hits > 0 THEN 5 ELSE 0 END AS BIGINT) AS recorded
    FROM m LEFT JOIN cells ON m.incident_id = cells.incident_id""")
def _(spark, sf):
    raced = roles.select(table(spark, sf, "orders"), _RACED)
    side = roles.select(table(spark, sf, "orders").where("o_totalprice >= 30000"), _WITH_CAR)
    noted = enrich.note_standings(processed(spark, sf), side, calendar(spark, sf), standings(spark, sf), team_standings(spark, sf), raced, teams(spark, sf))
    fields = ("driver_standings", "driver_points", "respective_teams", "construct_standings", "construct_points")
    recorded = F.size(F.filter(enrich.NEW, lambda r: r["field"].isin(*fields))).cast("long").alias("recorded")
    return noted.select("incident_id", "drivers", "driver_standings", "driver_points", "respective_teams", "construct_standings", recorded)


# A fifth of the rows have no round: the local calendar knows the first half of the year, the fetched one the next three months.
_STAMP = {"incident_id": "CAST(o_orderkey AS STRING)", "event": "'Round ' || CAST(month(o_orderdate) AS STRING)", "month": "CAST(month(o_orderdate) AS INT)",
          "season": "CAST(year(o_orderdate) AS INT)", "session": choose(CENTS, 3, "'race'", "'Race'", "'practice'"),
          "round": choose(CENTS, 5, "''", *["CAST(month(o_orderdate) AS STRING)"] * 4), "cents": CENTS,
          "time": choose(CENTS, 4, "'14:00 local'", "'0:45:10'", "'lap 7'", "''"),
          "date": ("date_format(o_orderdate, 'd MMMM yyyy')", "''"), "day": "CAST(o_orderdate AS DATE)"}
_START = {"season": _STAMP["season"], "round": "CAST(month(o_orderdate) AS INT)", "session": "'race'",
          "start_ts": ("timestampadd(MINUTE, 810, date_trunc('DAY', o_orderdate))", "date_trunc('day', o_orderdate) + INTERVAL 810 MINUTE")}


@query("E03_timestamp_enrichment", f"""WITH i AS ({roles.select_sql(_STAMP, 'orders')}), s AS (SELECT season, round, max(start_ts) AS st FROM ({roles.select_sql(_START, 'orders')}) GROUP BY ALL),
    j AS (SELECT i.*, CASE WHEN lower(session) = 'race' THEN epoch(day) + 50400 - epoch(st) END AS off FROM i LEFT JOIN s ON i.season = s.season AND (i.round <> '' OR i.month <= 9) AND i.month = s.round)
    SELECT incident_id, CASE cents % 4 WHEN 0 THEN 'document_clock' WHEN 1 THEN 'session_elapsed' WHEN 2 THEN 'lap_hint' ELSE 'unparsed' END AS time_parse_method,
        CAST(CASE cents % 4 WHEN 0 THEN CASE WHEN off BETWEEN 0 AND 5400 THEN off END WHEN 1 THEN 2710 END AS DOUBLE) AS session_offset_seconds,
        round(CAST(CASE cents % 4 WHEN 0 THEN 0.55 * CASE WHEN off IS NULL THEN 0.25 WHEN off BETWEEN 0 AND 5400 THEN 1 ELSE 0.35 END WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 * 0.25 ELSE 0 END AS DOUBLE), 6) AS confidence,
        CASE cents % 4 WHEN 2 THEN 7 END AS lap_hint,
        CASE WHEN cents % 4 = 0 AND off BETWEEN 0 AND 5400 THEN strftime(day, '%Y-%m-%d') || ' 14:00:00' END AS incident_time_local FROM j""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    rows = roles.select(orders, _STAMP)
    schedule = roles.select(orders, _START).groupBy("season", "round", "session").agg(F.max("start_ts").alias("start_ts"))
    rounds = rows.select("season", "event", F.col("month").alias("round")).distinct()
    out = enrich.enrich_timestamps(rows.select("incident_id", "season", "session", "round"), rows.select("incident_id", "event", "time", "date"),
                                   schedule, rounds.where("round <= 6"), rounds.where("round BETWEEN 4 AND 9"))
    return out.select("incident_id", "time_parse_method", "session_offset_seconds", F.round("time_parse_confidence", 6).alias("confidence"),
                      "lap_hint", "incident_time_local")


# Purchases are the incidents of the feed jobs; their session runs within the day.
_HAPPENED = {"incident_id": "CAST(event_id AS STRING)", "event_id": "event_id", "season": "2024", "ts": "ts", "event_type": "event_type",
             "event": "'Land' || lpad(CAST(day(ts) AS STRING), 2, '0') || ' Grand Prix'",
             "session": choose("event_id", 3, "'race'", "'qualifying'", "'practice'"), "round": "CAST(day(ts) AS STRING)",
             "car_number": choose("event_id", 3, "'44'", "''", "'n/a'"),
             "drivers": choose("event_id", 4, "'nation_' || CAST(user_id % 25 AS STRING)", "'nation_' || CAST(user_id % 25 AS STRING) || ',n' || CAST(event_id % 25 AS STRING)",
                               "'car_3,nation_' || CAST(event_id % 25 AS STRING)", "'ghost,x_' || CAST(user_id % 25 AS STRING)"),
             "lap": choose("event_id", 6, "'5'", *["''"] * 5), "flag": choose("event_id", 8, "'blue'", *["''"] * 7),
             "lap_hint": choose("event_id", 10, "9", *["NULL"] * 9),
             "offset": ("CAST(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(timestampadd(HOUR, 6 * CAST(event_id % 3 AS INT), date_trunc('DAY', CAST(ts AS TIMESTAMP)))) AS DOUBLE) / 1000000",
                        "CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) - 21600000000 * (event_id % 3) AS DOUBLE) / 1000000")}


def happened(spark, sf):
    rows = roles.select(table(spark, sf, "events").where(F.col("event_type") == PROBE), _HAPPENED)
    incidents = quality.conform(rows).withColumn("season", F.col("season").cast("int"))
    side = rows.select("incident_id", "event", "car_number", F.lit("").alias("time"), F.col("offset").alias("session_offset_seconds"), "lap_hint")
    return incidents, side


_HAPPENED_SQL = f"""hp AS (SELECT *, CAST(day(ts) AS INT) * 10 + {SESSION_KEY_SQL} AS session_key FROM ({roles.select_sql(_HAPPENED, 'events')}) WHERE event_type = '{PROBE}')"""


def _nearest_sql(kind: str, tolerance: int, columns: str, keys: str = "hp.session_key = fe.session_key") -> str:
    return f"""SELECT hp.event_id, {columns} FROM hp LEFT JOIN fe ON fe.event_type = '{kind}' AND {keys}
        AND abs(epoch_us(hp.ts) - epoch_us(fe.ts)) <= {tolerance}000000 GROUP BY hp.event_id"""


_MIN = "arg_min({0}, abs(epoch_us(hp.ts) - epoch_us(fe.ts)))"


@query("E04_race_feed_enrichment", f"""WITH {NUMBER_SQL}, {_HAPPENED_SQL},
    la AS (SELECT hp.event_id, arg_max(fe.lap_number, fe.ts) AS lap FROM hp LEFT JOIN fe ON fe.event_type = '{LAPS}' AND hp.session_key = fe.session_key AND fe.ts <= hp.ts GROUP BY 1),
    ml AS (SELECT session_key, max(lap_number) AS top FROM fe WHERE event_type = '{LAPS}' GROUP BY 1),
    rc AS ({_nearest_sql(MESSAGES, 1800, f"{_MIN.format('struct_pack(f := fe.flag, m := fe.message, s := fe.sector)')} AS b")}),
    rf AS (SELECT event_id, b IS NOT NULL AS hit, b.f AS flag, b.m AS message, b.s AS sector FROM rc),
    st AS (SELECT event_id, CASE WHEN hit THEN {FLAG_SQL} ELSE '' END AS flag, CASE WHEN hit THEN {SECTOR_SQL} ELSE '' END AS sector FROM rf),
    near AS (SELECT n.event_id, n.pos, arg_min(f.position, abs(epoch_us(n.ts) - epoch_us(f.ts))) AS position FROM numbered n LEFT JOIN fe f ON f.event_type = '{POSITIONS}'
        AND f.position IS NOT NULL AND n.session_key = f.session_key AND n.driver_number = f.driver_number AND abs(epoch_us(n.ts) - epoch_us(f.ts)) <= 1800000000
        WHERE n.event_type = '{PROBE}' GROUP BY ALL),
    po AS (SELECT event_id, string_agg(coalesce(CAST(position AS STRING), ''), ',' ORDER BY pos) AS cells, count(position) AS hits FROM near GROUP BY 1)
    SELECT incident_id, CASE WHEN hp.lap <> '' THEN hp.lap WHEN lap_hint IS NOT NULL THEN CAST(lap_hint AS STRING) ELSE coalesce(CAST(la.lap AS STRING), '') END AS lap,
        coalesce(CAST(top AS STRING), '') AS full_laps, CASE WHEN hp.flag <> '' THEN hp.flag ELSE st.flag END AS flag, st.sector,
        CASE WHEN hits > 0 THEN cells ELSE '' END AS positions
    FROM hp JOIN la ON hp.event_id = la.event_id JOIN st ON hp.event_id = st.event_id LEFT JOIN ml ON hp.session_key = ml.session_key LEFT JOIN po ON hp.event_id = po.event_id""")
def _(spark, sf):
    incidents, side = happened(spark, sf)
    rows, _ = enrich.enrich_feed(
        incidents, side, sessions(spark, sf), roles.feed(spark, sf, LAPS).select("session_key", "lap_number", F.col("ts").alias("date_start")),
        roles.feed(spark, sf, MESSAGES).select("session_key", F.col("ts").alias("date"), "flag", "message", "sector", F.col("event_id").alias("seq")),
        roles.feed(spark, sf, POSITIONS).select("session_key", "driver_number", "position", F.col("ts").alias("date"), F.col("event_id").alias("seq")),
        match.number_keys(results(spark, sf), roster(spark, sf), ["session_key"]), tolerance=1800)
    return rows.select("incident_id", "lap", "full_laps", "flag", "sector", F.col(f"`{enrich.POSITIONS}`").alias("positions"))


@query("E05_session_frame_enrichment", f"""WITH fe AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'race' WHEN 1 THEN 'qualifying' ELSE 'practice' END AS s,
        CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) - 21600000000 * (event_id % 3) AS DOUBLE) / 1000000 AS tm FROM ({FEED_SQL})),
    hp AS (SELECT *, CAST(day(ts) AS INT) AS day, CASE WHEN "offset" >= 0 THEN "offset" END AS att FROM ({roles.select_sql(_HAPPENED, 'events')}) WHERE event_type = '{PROBE}'),
    la AS (SELECT hp.event_id, max(fe.lap_number) AS lap FROM hp LEFT JOIN fe ON fe.event_type = '{LAPS}' AND hp.day = fe.day AND hp.session = fe.s AND fe.tm <= hp.att GROUP BY 1),
    ml AS (SELECT day, s, max(lap_number) AS top FROM fe WHERE event_type = '{LAPS}' GROUP BY 1, 2),
    rc AS (SELECT hp.event_id, arg_min(fe.message, abs(fe.tm - hp.att)) AS m FROM hp LEFT JOIN fe ON fe.event_type = '{MESSAGES}' AND hp.day = fe.day AND hp.session = fe.s
        AND abs(fe.tm - hp.att) <= 1800 GROUP BY 1),
    sc AS (SELECT day, s, bool_or(contains(message, 'VIRTUAL')) AS v, bool_or(contains(message, 'SAFETY CAR') AND NOT contains(message, 'VIRTUAL')) AS c FROM fe WHERE event_type = '{MESSAGES}' GROUP BY 1, 2),
    w AS (SELECT day, s, arg_max(value, tm) > 20 AS rain FROM fe WHERE event_type = 'signup' GROUP BY 1, 2)
    SELECT incident_id, CASE WHEN hp.lap <> '' THEN hp.lap WHEN lap_hint IS NOT NULL THEN CAST(lap_hint AS STRING) ELSE coalesce(CAST(la.lap AS STRING), '') END AS lap,
        coalesce(CAST(top AS STRING), '') AS full_laps, CASE WHEN rain IS NULL THEN '' WHEN rain THEN 'rain' ELSE 'sunny' END AS weather_conditions,
        CASE WHEN att IS NULL THEN CASE WHEN c THEN 'safety_car' WHEN v THEN 'vsc' WHEN c IS NOT NULL THEN 'none' ELSE '' END WHEN m IS NULL THEN ''
            WHEN contains(m, 'VIRTUAL') THEN 'vsc' WHEN contains(m, 'SAFETY CAR') THEN 'safety_car' ELSE 'none' END AS safety_car
    FROM hp JOIN la ON hp.event_id = la.event_id JOIN rc ON hp.event_id = rc.event_id LEFT JOIN ml ON hp.day = ml.day AND hp.session = ml.s
    LEFT JOIN sc ON hp.day = sc.day AND hp.session = sc.s LEFT JOIN w ON hp.day = w.day AND hp.session = w.s""")
def _(spark, sf):
    incidents, side = happened(spark, sf)

    def frame(kind, *columns):
        rows = roles.feed(spark, sf, kind).withColumn("Time", F.col("seconds") - 21600 * (F.col("session_key") % 10))
        session = F.expr("CASE session_key % 10 WHEN 0 THEN 'race' WHEN 1 THEN 'qualifying' ELSE 'practice' END")
        return rows.select(F.lit(2024).alias("season"), F.col("day").alias("round"), session.alias("session"), "Time", *columns)

    laps = frame(LAPS, F.col("driver_number").alias("DriverNumber"), F.col("lap_number").alias("LapNumber"), F.col("position").alias("Position"))
    messages = frame(MESSAGES, F.col("message").alias("Message"), F.col("flag").alias("Flag"), F.col("sector").alias("Sector"), F.col("event_id").alias("seq"))
    weather = frame("signup", (F.col("value") > 20).alias("Rainfall"), F.lit("Dry").alias("TrackStatus"))
    numbers = match.number_keys(results(spark, sf), None, ["session_key"]).select(
        F.lit(2024).alias("_year"), F.floor(F.col("session_key") / 10).cast("int").alias("_round"), "key", "number").distinct()
    rows, _ = enrich.enrich_session_frames(incidents, side, laps, messages, weather, numbers, tolerance=1800)
    return rows.select("incident_id", "lap", "full_laps", "weather_conditions", "safety_car")


@query("E06_license_point_enrichment", f"""WITH {POINTS_SQL}, b AS (SELECT x.incident_id, string_agg(CASE WHEN held.points IS NULL THEN '' ELSE CAST(CAST(held.points AS BIGINT) AS STRING) END, ',' ORDER BY pos) AS v
        FROM x LEFT JOIN held ON x.incident_id = held.incident_id AND x.driver = held.driver GROUP BY x.incident_id)
    SELECT m.incident_id, coalesce(v, superlicense_points_before_incident) AS superlicense_points_before_incident FROM m LEFT JOIN b ON m.incident_id = b.incident_id""")
def _(spark, sf):
    dates = roles.multi_incidents(spark, sf).select("incident_id", "date")
    rows, _ = enrich.enrich_points(processed(spark, sf), dates)
    return rows.select("incident_id", "superlicense_points_before_incident")


@query("E07_text_field_enrichment", f"""WITH f AS ({FIELDS_SQL}), s AS (SELECT document_id AS incident_id, cents % 7 = 0 AS known, {FAULT_VALUE_SQL} AS fault, {FAULT_SURE_SQL} AS sure,
        {SEVERITY_VALUE_SQL} AS severity, {SEVERITY_SURE_SQL} AS severity_confidence FROM f)
    SELECT incident_id, CASE WHEN known THEN 'x' WHEN sure >= 0.7 THEN fault ELSE '' END AS driver_at_fault, fault AS driver_at_fault_suggestion,
        sure AS driver_at_fault_confidence, severity AS severity_suggestion, severity_confidence FROM s""")
def _(spark, sf):
    rows = roles.fields(spark, sf)
    docs = rows.select("document_id", F.struct("fact", "reason", "decision").alias("parsed_fields"))
    incidents = rows.select(
        F.col("document_id").alias("incident_id"), F.concat(F.lit("car_4,d"), F.col("custkey").cast("string")).alias("drivers"),
        F.when(F.col("cents") % 7 == 0, "x").otherwise("").alias("driver_at_fault"), tx.penalty_label("decision").alias("penalty"), F.lit("").alias("severity"))
    side = rows.select(F.col("document_id").alias("incident_id"), "document_id")
    filled, _, suggestions = enrich.enrich_text(incidents, side, docs)
    return filled.select("incident_id", "driver_at_fault").join(suggestions, "incident_id")


@query("E08_validate_and_export", f"""WITH {REVIEW_SQL}, v AS (SELECT incident_id, review_reasons, len(list_filter(list_transform(string_split(drivers, ','), lambda v: trim(v)), lambda v: v <> '')) AS n,
        TRY_CAST(lap AS INT) AS l, TRY_CAST(full_laps AS INT) AS f FROM rv)
    SELECT incident_id, CASE WHEN n > 0 THEN CAST(n AS STRING) ELSE '' END AS num_drivers, CASE WHEN f < l THEN '0' ELSE coalesce(CAST(f - l AS STRING), '') END AS lap_remaining,
        round(CAST(l AS DOUBLE) / nullif(f, 0) * 100, 6) AS completion, nullif(review_reasons, '') AS review_reasons FROM v""")
def _(spark, sf):
    export = jobs.validate_export(roles.multi_incidents(spark, sf), meta(spark, sf))
    rows = export.processed.select("incident_id", "num_drivers", "lap_remaining", F.round(number("completion_percentage"), 6).alias("completion"))
    return rows.join(export.review.select("incident_id", "review_reasons"), "incident_id", "left")


@query("E09_incident_build", f"WITH {PRIMARY_SQL}, {CIRCUIT_SQL}, {INCIDENT_ROW_SQL} SELECT {INCIDENT_OUT_SQL} FROM rows")
def _(spark, sf):
    return jobs.build_incidents(roles.documents(spark, sf), circuits(spark, sf)).select(*INCIDENT_OUT)


@query("E10_document_parse", f"""WITH f AS ({FIELDS_SQL}) SELECT document_id, {roles.KIND_SQL} AS document_type, document_no, date, '18:21 ' || season || ' ' || grand_prix AS time, incident_time, grand_prix, car_number, driver_name,
    competitor, {roles.DOC_SESSION_SQL} AS session, fact, offence, decision, reason, {roles.OPPONENTS_SQL} AS opponents, CASE WHEN cents % 5 IN (0, 1) THEN CAST(cents % 20 + 1 AS STRING) ELSE '' END AS turn_number,
    {roles.LABEL_SQL} AS penalty, CASE cents % 9 WHEN 4 THEN '2' WHEN 5 THEN '1' ELSE '' END AS superlicense_points_added, offence AS mentioned_article, {roles.FAULT_SQL} AS driver_at_fault,
    round(1 - (CAST(fact = '' AS INT) + CAST(({roles.KIND_SQL}) = 'decision' AND decision = '' AS INT)) / CASE WHEN ({roles.KIND_SQL}) = 'decision' THEN 3 ELSE 2 END, 3) AS parse_confidence FROM f""")
def _(spark, sf):
    docs = parse_documents(roles.documents(spark, sf))
    return docs.select("document_id", "document_type", "parse_confidence", "parsed_fields.*").withColumn(
        "opponents", F.array_join("opponent_car_numbers", ",")).drop("opponent_car_numbers")


@query("E11_enrichment_quality_report", f"""{GATE_SQL}, gates AS (""" + " UNION ALL ".join(
    f"SELECT '{gate}' AS gate, CAST(g{i} AS DOUBLE) AS actual, g{i} {'>' if strict else '>='} {target} AS passed FROM {'p' if i == 4 else 'g'}"
    for i, (gate, _, target, strict) in enumerate(QUALITY_GATES)) + f"""), t AS ({META_SQL})
    SELECT gates.*, (SELECT count(*) FROM m) AS row_count, (SELECT count(*) FILTER (passed) FROM gates) AS gates_passed, (SELECT count(*) FROM gates) AS gates_total,
        (SELECT round(avg(CAST(time_parse_method IS NOT NULL AS INT)), 4) FROM t) AS parsed_rate, (SELECT round(avg(CAST(session_offset_seconds IS NOT NULL AS INT)), 4) FROM t) AS offset_rate FROM gates""")
def _(spark, sf):
    rows, side = roles.multi_incidents(spark, sf), meta(spark, sf)
    rate = fill.provenance_rate(rows, fill.latest_provenance(provenance(spark, sf)), "lap", "timestamp", "round_used")
    report = jobs.quality_report(rows, points.incidents_with_prior_points(rows), rate, side, quality.review_queue(rows, side))
    return report.select("gate", "actual", "passed", "row_count", "gates_passed", "gates_total", "parsed_rate", "offset_rate")


_ENCODED = ("lap", "full_laps", "completion_percentage", "session", "incident_type", "driver", "opponent")


def _code_sql(column: str, source: str = "i") -> str:
    return f"""code_{column} AS (SELECT {column} AS v, dense_rank() OVER (ORDER BY {column}) - 1 AS code FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL AND split = 'train'))"""


@query("M01_encode_splits", f"""WITH i AS (SELECT *, {SPLIT_SQL} AS split FROM ({INCIDENT_SQL})), {_code_sql('session')}, {_code_sql('incident_type')}, {_code_sql('driver')}, {_code_sql('opponent')},
    fills AS (SELECT median(CAST(lap AS DOUBLE)) AS lap, median(TRY_CAST(full_laps AS DOUBLE)) AS fl, median(completion_percentage) AS cp FROM i WHERE split = 'train'),
    md AS (SELECT opponent AS v FROM i WHERE split = 'train' AND opponent IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT row_id, split, CAST(coalesce(a.code, -1) AS DOUBLE) AS cat__session, CAST(coalesce(b.code, -1) AS DOUBLE) AS cat__incident_type, CAST(coalesce(c.code, -1) AS DOUBLE) AS cat__driver,
        CAST(coalesce(d.code, -1) AS DOUBLE) AS cat__opponent, CAST(i.lap AS DOUBLE) AS num__lap, coalesce(TRY_CAST(full_laps AS DOUBLE), fills.fl) AS num__full_laps,
        completion_percentage AS num__completion_percentage
    FROM i CROSS JOIN fills LEFT JOIN code_session a ON i.session = a.v LEFT JOIN code_incident_type b ON i.incident_type = b.v LEFT JOIN code_driver c ON i.driver = c.v
    LEFT JOIN code_opponent d ON coalesce(i.opponent, (SELECT v FROM md)) = d.v""")
def _(spark, sf):
    rows, _ = jobs.encoded(roles.incidents(spark, sf), SPLITS, _ENCODED)
    return rows.drop("penalty", "incident_id", "session", "season", "penalty_severity")


_LABEL_SQL = """CASE penalty WHEN 'No further action' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Reprimand' THEN 1 WHEN '5s_time_penalty' THEN 1
    WHEN '3_place_grid_drop' THEN 2 WHEN 'Disqualification' THEN 2 END"""


@query("M02_prepare_job", f"""WITH {FLAT_SQL}, fl AS (SELECT incident_id || '_' || driver AS row_id, driver, session, {SPLIT_SQL} AS split, {_LABEL_SQL} AS severity,
        CASE WHEN len(pts) = 0 THEN NULL WHEN len(pts) = 1 THEN pts[1] ELSE pts[pos] END AS p, TRY_CAST(lap AS DOUBLE) AS l FROM flat WHERE penalty <> ''),
    {_code_sql('driver', 'fl')}, {_code_sql('session', 'fl')}
    SELECT row_id, split, severity AS penalty_severity, CAST(coalesce(a.code, -1) AS DOUBLE) AS cat__driver, CAST(coalesce(b.code, -1) AS DOUBLE) AS cat__session, l AS num__lap
    FROM fl LEFT JOIN code_driver a ON fl.driver = a.v LEFT JOIN code_session b ON fl.session = b.v""")
def _(spark, sf):
    rows, _ = jobs.prepare(roles.multi_incidents(spark, sf), SPLITS)
    return rows.select("row_id", "split", "penalty_severity", "cat__driver", "cat__session", "num__lap")


@query("M03_feature_job", f"""WITH {FLAT_SQL}, fl AS (SELECT incident_id || '_' || driver AS row_id, driver, season, TRY_CAST(nullif(round, '') AS INT) AS rnd, incident_type, session, {_LABEL_SQL} AS severity FROM flat WHERE penalty <> ''),
    g AS (SELECT driver, season, rnd, count(*) AS n, count(*) FILTER (severity > 0) AS pen FROM fl WHERE rnd IS NOT NULL GROUP BY ALL),
    h AS (SELECT a.driver, a.season, a.rnd, sum(b.n) AS n, sum(b.pen) AS pen FROM g a JOIN g b ON a.driver = b.driver AND b.season * 100 + b.rnd < a.season * 100 + a.rnd GROUP BY ALL),
    k AS (SELECT incident_type AS t, session AS s, season, rnd, count(*) AS n FROM fl WHERE rnd IS NOT NULL GROUP BY ALL),
    pr AS (SELECT a.t, a.s, a.season, a.rnd, sum(b.n) AS n FROM k a JOIN k b ON a.t = b.t AND a.s = b.s AND b.season * 100 + b.rnd < a.season * 100 + a.rnd GROUP BY ALL)
    SELECT row_id, CASE WHEN fl.rnd IS NOT NULL THEN CAST(coalesce(h.n, 0) AS DOUBLE) END AS career_incidents, CASE WHEN fl.rnd IS NOT NULL THEN CAST(coalesce(h.pen, 0) AS DOUBLE) END AS career_penalties,
        CASE WHEN fl.rnd IS NOT NULL THEN CAST(coalesce(pr.n, 0) AS DOUBLE) END AS precedent_count
    FROM fl LEFT JOIN h ON fl.driver = h.driver AND fl.season = h.season AND fl.rnd = h.rnd
    LEFT JOIN pr ON fl.incident_type = pr.t AND fl.session = pr.s AND fl.season = pr.season AND fl.rnd = pr.rnd""")
def _(spark, sf):
    rows = jobs.labelled_rows(roles.multi_incidents(spark, sf)).withColumn("round", number("round").cast("int"))
    return jobs.engineered(rows).select("row_id", "career_incidents", "career_penalties", "precedent_count")


@query("M04_baselines", f"""WITH i AS (SELECT *, {SPLIT_SQL} AS split FROM ({INCIDENT_SQL})), c AS (SELECT session, penalty_severity AS v, count(*) AS n FROM i WHERE split = 'train' GROUP BY ALL),
    md AS (SELECT session, arg_min(v, -n * 10 + v) AS v FROM c GROUP BY 1)
    SELECT row_id, (SELECT arg_min(v, -n * 10 + v) FROM (SELECT v, sum(n) AS n FROM c GROUP BY v)) AS pred_majority, md.v AS pred_session_stratified FROM i JOIN md ON i.session = md.session WHERE split = 'validation'""")
def _(spark, sf):
    rows = splits.temporal_split(roles.incidents(spark, sf), SPLITS)
    out = learning.baselines(rows.where("split = 'train'"), rows.where("split = 'validation'"))
    return out.select("row_id", "pred_majority", "pred_session_stratified")


def coded(spark, sf):
    rows, _ = jobs.encoded(jobs.engineered(roles.incidents(spark, sf)), SPLITS, (
        "session", "incident_type", "lap", "completion_percentage", "driver_standing", "career_incidents", "career_penalties", "precedent_major_penalty_rate"))
    return rows


def _parts(rows):
    return rows.where("split = 'train'"), rows.where("split = 'validation'")


# A label that a right model must return: an exact function of one of its features.
_TAUGHT_SQL = f"""taught AS (SELECT row_id, CASE session WHEN 'Race' THEN 0 WHEN 'Qualifying' THEN 1 ELSE 2 END AS label, {SPLIT_SQL} AS split FROM ({INCIDENT_SQL}))"""


def taught(spark, sf):
    label = F.when(F.col("session") == "Race", 0).when(F.col("session") == "Qualifying", 1).otherwise(2)
    rows, _ = jobs.encoded(jobs.engineered(roles.incidents(spark, sf).withColumn("penalty_severity", label)), SPLITS, (
        "session", "incident_type", "lap", "completion_percentage", "driver_standing", "career_incidents"))
    return rows


def judged(scored, pred):
    """Predictions, whether they are the likeliest class, and the sum of the probabilities."""
    likeliest = learning.argmax([F.col(c) for c in learning.PROBABILITIES])
    return scored.select("row_id", "penalty_severity", pred, (F.col(pred) == likeliest).alias("is_argmax"),
                         F.round(sum(F.col(c) for c in learning.PROBABILITIES), 6).alias("total"))


@query("M05_tabular_classifier", f"WITH {_TAUGHT_SQL} SELECT row_id, label AS penalty_severity, label AS pred_tabular, true AS is_argmax, 1e0 AS total FROM taught WHERE split = 'validation'")
def _(spark, sf):
    train, validation = _parts(taught(spark, sf))
    return judged(learning.score(learning.fit_tabular(train), validation, "pred_tabular"), "pred_tabular")


@query("M06_correlation_prune", """SELECT 'price2' AS dropped, 'price' AS kept FROM lineitem HAVING abs(corr(l_extendedprice, l_extendedprice * 2 + 1)) > 0.95
    UNION ALL SELECT 'neg', 'qty' FROM lineitem HAVING abs(corr(l_quantity, -l_quantity)) > 0.95""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem")
    columns = {"qty": F.col("l_quantity"), "price": F.col("l_extendedprice"), "price2": F.col("l_extendedprice") * 2 + 1,
               "disc": F.col("l_discount"), "neg": -F.col("l_quantity"), "one": F.lit(1.0)}
    pairs = [(r.left, r.right, r.corr) for r in selection.correlations(rows, columns).collect()]
    scores = {c: 1.0 for c in columns}
    _, dropped = selection.correlation_prune(pairs, scores, list(columns), list(columns))
    return spark.createDataFrame(dropped, "dropped string, kept string")


@query("M07_importance_prune", "SELECT * FROM (VALUES ('cat__0_flat', 0e0), ('cat__0_level', 0e0)) AS t(feature, gain)")
def _(spark, sf):
    """Two of ten columns never change: they are what the bottom fifth must be."""
    train, _ = _parts(taught(spark, sf))
    rows = train.withColumns({"cat__0_flat": F.lit(1.0), "cat__0_level": F.lit(7.0), "num__kind": F.col("penalty_severity").cast("double"),
                              "num__twice": 2.0 * F.col("penalty_severity")})
    return learning.prune_by_importance(rows)[1]


@query("M08_ablation")
def _(spark, sf):
    return learning.ablation(splits.temporal_split(jobs.engineered(roles.incidents(spark, sf)), SPLITS))


@query("M09_text_dataset", f"WITH {TEXT_ROWS_SQL} SELECT row_id, {SPLIT_SQL} AS split, md5(text) AS digest FROM joined WHERE drop_reason IS NULL AND penalty <> ''")
def _(spark, sf):
    rows, _ = text_dataset(spark, sf)
    return rows.select("row_id", "split", F.md5("text").alias("digest"))


def text_dataset(spark, sf):
    return jobs.text_dataset(roles.multi_incidents(spark, sf), meta(spark, sf).drop("event"), document_table(spark, sf), SPLITS)


# The decision phrase of a document settles its class, and a hash-free split by its cents keeps every phrase on both sides.
_PHRASE_SQL = f"""f AS ({FIELDS_SQL}), phrases AS (SELECT document_id AS row_id, decision AS text, CASE WHEN cents % 9 < 3 THEN 0 WHEN cents % 9 < 6 THEN 1 ELSE 2 END AS label,
    CASE WHEN (cents // 9) % 4 = 0 THEN 'validation' ELSE 'train' END AS split FROM f WHERE decision <> '')"""


def labelled_texts(spark, sf):
    """Decision phrases with the class they stand for."""
    nine = F.col("cents") % 9
    return roles.fields(spark, sf).where("decision <> ''").select(
        F.col("document_id").alias("row_id"), F.col("decision").alias("text"), F.when(nine < 3, 0).when(nine < 6, 1).otherwise(2).alias("penalty_severity"),
        F.when(F.floor(F.col("cents") / 9) % 4 == 0, "validation").otherwise("train").alias("split"))


def two_views(spark, sf):
    """The same documents as words and as numbers, one of which says nothing."""
    nine = F.col("cents") % 9
    numbers = roles.fields(spark, sf).select(F.col("document_id").alias("row_id"), nine.cast("double").alias("num__kind"), (F.col("custkey") % 7).cast("double").alias("num__noise"))
    return labelled_texts(spark, sf).join(numbers, "row_id")


@query("M10_text_classifier", f"WITH {_PHRASE_SQL} SELECT row_id, label AS penalty_severity, label AS pred_nlp, true AS is_argmax, 1e0 AS total FROM phrases WHERE split = 'validation'")
def _(spark, sf):
    train, validation = _parts(labelled_texts(spark, sf))
    return judged(learning.score(learning.fit_text(train), validation, "pred_nlp"), "pred_nlp")


_FUSED_SQL = f"""a AS ({PRED_SQL}), b AS ({PRED2_SQL}), f AS (SELECT a.row_id, a.penalty_severity, [a.proba_no_penalty, a.proba_minor, a.proba_major] AS n, [b.proba_no_penalty, b.proba_minor, b.proba_major] AS t,
        [(a.proba_no_penalty + b.proba_no_penalty) / 2, (a.proba_minor + b.proba_minor) / 2, (a.proba_major + b.proba_major) / 2] AS m FROM a JOIN b ON a.row_id = b.row_id),
    fu AS (SELECT row_id, penalty_severity, list_position(n, list_max(n)) - 1 AS pred_nlp, list_position(t, list_max(t)) - 1 AS pred_tabular, list_position(m, list_max(m)) - 1 AS pred_fused FROM f)"""


def fused(spark, sf):
    return learning.fuse_mean(learning.merge_modalities(predictions(spark, sf), tabular_predictions(spark, sf)))


@query("M11_mean_fusion", f"WITH {_FUSED_SQL} SELECT * FROM fu")
def _(spark, sf):
    return fused(spark, sf).select("row_id", "penalty_severity", "pred_nlp", "pred_tabular", "pred_fused")


@query("M12_stacked_fusion", f"WITH {_PHRASE_SQL} SELECT row_id, label AS penalty_severity, label AS pred_stacked FROM phrases WHERE split = 'validation'")
def _(spark, sf):
    train, validation = _parts(two_views(spark, sf))
    stacked = learning.cross_fitted_stack(train, validation, learning.fit_text, learning.fit_tabular, folds=2)
    return stacked.select("row_id", "penalty_severity", "pred_stacked")


@query("M13_modality_comparison", f"""WITH {_FUSED_SQL}, s AS (SELECT 'nlp_only' AS modality, {summary_sql('penalty_severity', 'pred_nlp')} FROM fu
        UNION ALL SELECT 'tabular_only', {summary_sql('penalty_severity', 'pred_tabular')} FROM fu UNION ALL SELECT 'fused', {summary_sql('penalty_severity', 'pred_fused')} FROM fu)
    SELECT *, macro_f1 >= (SELECT max(macro_f1) FROM s WHERE modality <> 'fused') AS beats_best FROM s""")
def _(spark, sf):
    return rounded(learning.compare_modalities(fused(spark, sf))).drop("best_single", "best_single_f1")


@query("M14_saved_model_evaluation", f"WITH {_TAUGHT_SQL} SELECT count(*) AS n, 1e0 AS accuracy, 1e0 AS macro_f1, 1e0 AS weighted_f1, true AS sure FROM taught WHERE split = 'test'")
def _(spark, sf):
    rows = taught(spark, sf)
    path = new_path(spark, "model")
    learning.fit_tabular(rows.where("split = 'train'")).write().overwrite().save(path)
    scored = learning.score(PipelineModel.load(path), rows.where("split = 'test'"), "pred")
    # The true class is the likeliest everywhere, so the mean log loss is below that of an even guess.
    result = metrics.summary(scored, learning.LABEL, "pred", probabilities=learning.PROBABILITIES)
    return rounded(result.withColumn("sure", F.col("log_loss") < math.log(3)).drop("log_loss"))


@query("M15_sanity_checks", """WITH imp AS (SELECT 'cat__incident_type_' || lower(p_type) || '_' || p_brand AS feature, CAST(sum(p_size) AS DOUBLE) AS gain FROM part GROUP BY 1),
    top AS (SELECT feature, row_number() OVER (ORDER BY gain DESC, feature) AS rn FROM imp)
    SELECT bool_or(contains(feature, 'incident_type')) FILTER (rn <= 10) AS domain_in_top, bool_or(contains(feature, 'career_')) FILTER (rn <= 15) AS engineered_in_top FROM top""")
def _(spark, sf):
    features.assert_no_leakage(features.feature_columns(roles.incidents(spark, sf)))
    return selection.sanity_checks(importances(spark, sf))


@query("M16_text_evaluation", f"WITH {_PHRASE_SQL} SELECT count(*) AS n, 1e0 AS accuracy, 1e0 AS macro_f1, 1e0 AS weighted_f1, 0 AS errors FROM phrases WHERE split = 'validation'")
def _(spark, sf):
    train, validation = _parts(labelled_texts(spark, sf))
    scored = learning.score(learning.fit_text(train), validation, "pred_nlp")
    wrong = learning.errors(scored, "pred_nlp").agg(F.count(F.lit(1)).alias("errors"))
    return metrics.summary(scored, learning.LABEL, "pred_nlp").withColumn("errors", wrong.scalar())


_SELECT = ("session", "lap", "full_laps", "completion_percentage", "driver_standing", "opponent_points", "opponent", "rounds")


@query("M16_paired_modalities", f"""WITH {_FUSED_SQL}, g AS (SELECT penalty_severity AS l, pred_nlp = penalty_severity AS a, pred_tabular = penalty_severity AS b FROM fu)
    SELECT coalesce(CAST(l AS STRING), 'all') AS label, count(*) AS n, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS left_only,
        count(*) FILTER (b AND NOT a) AS right_only, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a <> b) AS discordant FROM g GROUP BY ROLLUP (l)""")
def _(spark, sf):
    rows = fused(spark, sf)
    return learning.paired(rows, rows, "pred_nlp", "pred_tabular")


@query("M17_raw_selection", f"WITH i AS ({INCIDENT_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN avg(CASE WHEN trim(coalesce(CAST({c} AS STRING), '')) = '' THEN 1.0 ELSE 0 END) > 0.4 THEN 'missing' ELSE 'kept' END AS status FROM i"
    for c in _SELECT))
def _(spark, sf):
    _, report = selection.prune_raw(roles.incidents(spark, sf), list(_SELECT))
    return report.select("column", "status")


@query("M18_text_preparation", f"WITH {TEXT_ROWS_SQL} SELECT {SPLIT_SQL} AS split, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM joined WHERE drop_reason IS NULL AND penalty <> '' GROUP BY 1")
def _(spark, sf):
    rows, _ = text_dataset(spark, sf)
    path = new_path(spark, "text-splits")
    rows.write.partitionBy("split").json(path)
    stored = spark.read.schema("row_id string, text string, split string").json(path)
    return stored.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))


@query("M19_score_for_stacking", f"WITH {_TAUGHT_SQL} SELECT row_id, label AS penalty_severity, label AS pred, true AS is_argmax, 1e0 AS total, split FROM taught WHERE split IN ('train', 'validation')")
def _(spark, sf):
    rows = taught(spark, sf)
    train, validation = _parts(rows)
    path = new_path(spark, "stack-model")
    learning.fit_tabular(train).write().overwrite().save(path)
    model = PipelineModel.load(path)
    return judged(learning.score(model, train, "pred"), "pred").withColumn("split", F.lit("train")).unionByName(
        judged(learning.score(model, validation, "pred"), "pred").withColumn("split", F.lit("validation")))


_LEAVES = {
    "implicit": ({"incident_type": " Collision "}, "incident_type = 'collision'"),
    "number_eq": ({"penalty_severity": 2}, "penalty_severity = 2"),
    "eq": ({"session": {"eq": "RACE"}}, "session = 'Race'"),
    "in_list": ({"incident_type": {"in": ["collision", "other"]}}, "incident_type IN ('collision', 'other')"),
    "plain_list": ({"incident_type": ["pit_lane"]}, "incident_type = 'pit_lane'"),
    "contains": ({"penalty": {"contains": "PENALTY"}}, "contains(lower(penalty), 'penalty')"),
    "gte": ({"full_laps": {"gte": 53}}, "coalesce(TRY_CAST(full_laps AS DOUBLE) >= 53, false)"),
    "lt": ({"round": {"lt": 6}}, "coalesce(round < 6, false)"),
    "fact": ({"fact_contains_any": ["Racing Incident", "pit lane"]}, "contains(lower(fact), 'racing incident') OR contains(lower(fact), 'pit lane')"),
    "session_in": ({"session_in": ["Practice 2", "Race"]}, "session IN ('Practice 1', 'Race')"),
    "missing_number": ({"absent": {"lt": 3}}, "false"),
    "fallback": ({"default": True}, "true"),
}


@query("N01_condition_leaves", f"WITH i AS ({INCIDENT_SQL}) SELECT row_id, {', '.join(f'({sql}) AS {chr(34)}{n}{chr(34)}' for n, (_, sql) in _LEAVES.items())} FROM i")
def _(spark, sf):
    rows = roles.incidents(spark, sf)
    return rows.select("row_id", *[rules.compile_conditions(rows, c).alias(n) for n, (c, _) in _LEAVES.items()])


@query("N02_condition_trees", f"""WITH i AS ({INCIDENT_SQL}) SELECT row_id, session = 'Race' AND (incident_type = 'collision' OR penalty_severity = 2) AS mixed,
    (coalesce(round < 4, false) AND incident_type = 'other') OR coalesce(round >= 10, false) AS nested, true AS empty FROM i""")
def _(spark, sf):
    rows = roles.incidents(spark, sf)
    mixed = {"session": "race", "or": [{"incident_type": "collision"}, {"penalty_severity": 2}]}
    nested = {"or": [{"and": [{"round": {"lt": 4}}, {"incident_type": "other"}]}, {"round": {"gte": 10}}]}
    return rows.select("row_id", *[rules.compile_conditions(rows, c).alias(n) for n, c in (("mixed", mixed), ("nested", nested), ("empty", {}))])


@query("N03_first_match", f"WITH {RULED_SQL} SELECT row_id, detail AS normative_penalty_detail, ruled AS normative_penalty_severity FROM dev")
def _(spark, sf):
    rows = rules.apply_rules(prior.escalation_counters(roles.incidents(spark, sf)))
    return rows.select("row_id", "normative_penalty_detail", "normative_penalty_severity")


_RUNNING_RULES = (
    rule("note", 1, {"session_in": ["race"]}, "warning", 1, proceed=True),
    rule("repeat", 2, {"penalty_severity": 2}, "5s", 1, proceed=True),
    rule("crash", 3, {"incident_type": "collision"}, "10s", 2),
    rule("late", 4, {"round": {"gte": 9}}, "reprimand", 1, proceed=True),
    rule("rest", 99, {"default": True}, "manual_review", 0),
)


@query("N04_continue_after_match", f"WITH i AS ({INCIDENT_SQL}) SELECT row_id, CASE WHEN incident_type = 'collision' THEN 'crash' ELSE 'rest' END AS normative_rule_id FROM i")
def _(spark, sf):
    return rules.apply_rules(roles.incidents(spark, sf), _RUNNING_RULES).select("row_id", "normative_rule_id")


@query("N05_rules_over_table", f"""WITH {HISTORY_SQL}, fx AS (SELECT i.* EXCLUDE (fact), trim(i.fact || ' ' || CASE WHEN o_totalprice >= 100000 THEN 'noted in ' || o_orderpriority ELSE '' END) AS fact
        FROM i JOIN orders ON i.row_id = CAST(o_orderkey AS STRING))
    SELECT fx.row_id, fx.fact, {ruled_sql("CASE WHEN fx.round IS NOT NULL THEN coalesce(h.track5, 0) END").replace('incident_type', 'fx.incident_type')} AS normative_penalty_detail
    FROM fx LEFT JOIN h ON fx.driver = h.driver AND fx.season = h.season AND fx.round = h.round""")
def _(spark, sf):
    return rules.predict(roles.incidents(spark, sf), facts(spark, sf)).select("row_id", "fact", "normative_penalty_detail")


@query("N06_rule_checks", f"WITH {RULED_SQL} SELECT detail AS normative_penalty_detail, ruled AS normative_penalty_severity, count(*) AS rows FROM dev GROUP BY ALL")
def _(spark, sf):
    rules.check_rules(DEFAULT_RULES)
    return ruled(spark, sf).groupBy("normative_penalty_detail", "normative_penalty_severity").agg(F.count(F.lit(1)).alias("rows"))


@query("N07_rule_comparison", f"WITH {RULED_SQL} {BREAKDOWN_SQL}")
def _(spark, sf):
    rows = prior.history_features(roles.incidents(spark, sf))
    return rounded(jobs.compare_outcomes(rows)["breakdowns"])


@query("N08_predict_then_compare", f"""WITH {RULED_SQL} SELECT count(*) AS row_count, round(avg(CAST(dir = 0 AS INT)), 6) AS agreement_rate,
    round(avg(CAST(detail = 'manual_review' AS INT)), 6) AS manual_review_rate FROM dev""")
def _(spark, sf):
    overall = jobs.compare_outcomes(roles.incidents(spark, sf))["overall"]
    path = writers.write_json(overall, new_path(spark, "comparison"))
    return rounded(spark.read.schema("row_count bigint, agreement_rate double, manual_review_rate double").json(path))


_INVENTORY_SQL = ", ".join(f"({i}, '{r['id']}', {r['priority']})" for i, r in enumerate(rules.ordered(DEFAULT_RULES)))


@query("N09_rule_inventory", f"""WITH {RULED_SQL}, known(ordinal, rule_id, priority) AS (VALUES {_INVENTORY_SQL}),
    hit AS (SELECT CASE WHEN incident_type = 'collision' THEN CASE detail WHEN '5s' THEN 'collision_avoidable_advantage' WHEN 'no_action' THEN 'collision_racing_no_fault' ELSE 'collision_unclassified' END
        WHEN incident_type = 'track_limits' THEN CASE detail WHEN 'warning' THEN 'track_limits_first_offence' WHEN '5s' THEN 'track_limits_repeat' ELSE 'default_unmatched' END
        WHEN incident_type = 'unsafe_release' THEN CASE WHEN session IN ('Race', 'Qualifying') THEN 'unsafe_release_pit' ELSE 'unsafe_release_general' END
        WHEN incident_type = 'pit_lane' THEN CASE WHEN contains(lower(fact), 'speeding') THEN 'pit_lane_speeding' ELSE 'pit_lane_general' END ELSE 'other_unclassified' END AS rule_id FROM dev)
    SELECT ordinal, known.rule_id, priority, count(hit.rule_id) AS hits, '{rules.content_hash(DEFAULT_RULES)}' AS content_hash FROM known LEFT JOIN hit ON known.rule_id = hit.rule_id GROUP BY ALL""")
def _(spark, sf):
    return rules.rule_inventory(ruled(spark, sf)).select("ordinal", "rule_id", "priority", "hits", "content_hash")
