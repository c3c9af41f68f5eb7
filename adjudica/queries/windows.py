"""Strictly-prior windows, rolling points, primary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adjudica.operators import points, prior, rules
from adjudica.operators.documents import primary_documents
from adjudica.queries import query, roles
from adjudica.queries.roles import FIELDS_SQL, INCIDENT_SQL, MULTI_SQL

# Distinct prior rounds of a driver, ranked backwards from each row's own round.
_GRAIN = f"""i AS ({INCIDENT_SQL}), g AS (
    SELECT driver, season, round, count(*) AS n, count(*) FILTER (penalty_severity > 0) AS pen,
        count(*) FILTER (penalty_severity = 2) AS major,
        count(*) FILTER (incident_type = 'track_limits') AS track, count(*) FILTER (incident_type = 'collision') AS coll,
        count(*) FILTER (penalty IN ('Warning', 'Reprimand') OR (penalty_severity = 1 AND NOT contains(lower(penalty), 'no_further'))) AS warn
    FROM i WHERE round IS NOT NULL GROUP BY ALL),
    p AS (SELECT a.driver, a.season, a.round, b.season AS s, b.round AS r, b.n, b.pen, b.major, b.track, b.coll, b.warn,
        row_number() OVER (PARTITION BY a.driver, a.season, a.round ORDER BY b.season DESC, b.round DESC) AS back
    FROM g a JOIN g b ON a.driver = b.driver AND (b.season < a.season OR (b.season = a.season AND b.round < a.round)))"""


def _history(name: str, columns: list[str], sql: str) -> None:
    """Rows with history columns against a self-join over earlier rounds."""
    known = "CASE WHEN i.round IS NOT NULL THEN {} END"
    body = ", ".join(f"{known.format(expr)} AS {column}" for column, expr in zip(columns, sql.split(";")))

    @query(name, f"""WITH {_GRAIN}, h AS (SELECT driver, season, round, {_AGGREGATES} FROM p GROUP BY ALL)
        SELECT i.row_id, {body} FROM i LEFT JOIN h ON i.driver = h.driver AND i.season = h.season AND i.round = h.round""")
    def _(spark, sf):
        rows = prior.history_features(roles.incidents(spark, sf))
        return rows.select("row_id", *[F.round(c, 6).alias(c) for c in columns])


_AGGREGATES = """sum(n) AS inc, sum(pen) AS pen, sum(major) AS major, count(*) AS rounds,
    sum(n) FILTER (back <= 3) AS inc3, sum(pen) FILTER (back <= 3) AS pen3, sum(n) FILTER (back <= 5) AS inc5,
    sum(pen) FILTER (back <= 5) AS pen5, arg_min(s, back) AS last_s, arg_min(r, back) AS last_r,
    arg_min(s, back) FILTER (pen > 0) AS pen_s, arg_min(r, back) FILTER (pen > 0) AS pen_r,
    sum(track) FILTER (back <= 5) AS track5, sum(coll) FILTER (back <= 5) AS coll5, sum(warn) FILTER (back <= 10) AS warn10"""


def _zero(column: str) -> str:
    return f"CAST(coalesce({column}, 0) AS DOUBLE)"


_history("W02_career_counters", ["career_incidents", "career_penalties", "career_major_penalties"],
         ";".join(_zero(c) for c in ("h.inc", "h.pen", "h.major")))
_history("W03_rates_per_100_rounds", ["career_incidents_per_100_races", "career_penalties_per_100_races"],
         "round(CAST(h.inc / h.rounds * 100 AS DOUBLE), 6);round(CAST(h.pen / h.rounds * 100 AS DOUBLE), 6)")
_history("W04_last_n_distinct_rounds", ["incidents_last_3_races", "penalties_last_3_races", "incidents_last_5_races", "penalties_last_5_races"],
         ";".join(_zero(c) for c in ("h.inc3", "h.pen3", "h.inc5", "h.pen5")))
_history("W05_rounds_since", ["races_since_last_penalty", "races_since_last_incident"],
         "CASE WHEN h.pen_s = i.season THEN CAST(i.round - h.pen_r - 1 AS DOUBLE) END;"
         "CASE WHEN h.last_s = i.season THEN CAST(i.round - h.last_r - 1 AS DOUBLE) END")

_PRECEDENT = f"""WITH i AS ({INCIDENT_SQL}), k AS (SELECT season, round, incident_type AS t, session AS s, count(*) AS n,
        count(*) FILTER (penalty_severity = 0) AS c0, count(*) FILTER (penalty_severity = 1) AS c1, count(*) FILTER (penalty_severity = 2) AS c2
    FROM i WHERE round IS NOT NULL GROUP BY ALL),
    own AS (SELECT a.season, a.round, a.t, a.s, sum(b.n) AS n, sum(b.c0) AS c0, sum(b.c1) AS c1, sum(b.c2) AS c2 FROM k a JOIN k b
        ON a.t = b.t AND a.s = b.s AND b.season * 100 + b.round < a.season * 100 + a.round GROUP BY ALL),
    r AS (SELECT season, round, sum(n) AS n, sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2 FROM k GROUP BY ALL),
    allr AS (SELECT a.season, a.round, sum(b.n) AS n, sum(b.c0) AS c0, sum(b.c1) AS c1, sum(b.c2) AS c2 FROM r a JOIN r b
        ON b.season * 100 + b.round < a.season * 100 + a.round GROUP BY ALL)
    SELECT row_id, CASE WHEN i.round IS NOT NULL THEN CAST(coalesce(own.n, 0) AS DOUBLE) END AS precedent_count,
        round(CASE WHEN own.n >= 3 THEN own.c0 / own.n ELSE allr.c0 / allr.n END, 6) AS precedent_no_penalty_rate,
        round(CASE WHEN own.n >= 3 THEN own.c1 / own.n ELSE allr.c1 / allr.n END, 6) AS precedent_minor_penalty_rate,
        round(CASE WHEN own.n >= 3 THEN own.c2 / own.n ELSE allr.c2 / allr.n END, 6) AS precedent_major_penalty_rate
    FROM i LEFT JOIN own ON i.season = own.season AND i.round = own.round AND i.incident_type = own.t AND i.session = own.s
    LEFT JOIN allr ON i.season = allr.season AND i.round = allr.round"""


@query("W06_precedent_rates", _PRECEDENT)
def _(spark, sf):
    rows = prior.precedent_features(roles.incidents(spark, sf))
    rates = [c for c in rows.columns if c.startswith("precedent_")]
    return rows.select("row_id", *[F.round(c, 6).alias(c) for c in rates])


ESCALATION = ("driver_track_limits_last_5_races", "driver_collisions_last_5_races", "driver_penalties_last_5_races",
              "driver_warnings_last_10_races")


@query("W07_escalation_counters", f"""WITH {_GRAIN}, h AS (SELECT driver, season, round, {_AGGREGATES} FROM p GROUP BY ALL)
    SELECT row_id, {", ".join(f"CASE WHEN i.round IS NOT NULL THEN {_zero(c)} END AS {n}"
                              for n, c in zip(ESCALATION, ("h.track5", "h.coll5", "h.pen5", "h.warn10")))}
    FROM i LEFT JOIN h ON i.driver = h.driver AND i.season = h.season AND i.round = h.round""")
def _(spark, sf):
    return prior.escalation_counters(roles.incidents(spark, sf)).select("row_id", *ESCALATION)


# Exploded named drivers with the points credited to the first named one.
POINTS_SQL = f"""m AS ({MULTI_SQL}), l AS (
    SELECT incident_id, season, coalesce(TRY_CAST(nullif(round, '') AS INT), 999) AS r, coalesce(date, DATE '9999-12-31') AS d,
        CASE superlicense_points_added WHEN '1' THEN 1 WHEN '2.0' THEN 2 ELSE 0 END AS pts,
        list_transform(string_split(drivers, ','), lambda x: trim(x)) AS ds FROM m WHERE drivers <> ''),
    x AS (SELECT incident_id, season, r, d, pts, list_filter(ds, lambda x: NOT starts_with(x, 'car_'))[1] AS primary_driver,
        unnest(ds) AS driver, unnest(range(len(ds))) AS pos FROM l),
    u AS (SELECT DISTINCT incident_id, season, r, d, driver, CASE WHEN driver = primary_driver THEN pts ELSE 0 END AS pts
        FROM x WHERE NOT starts_with(driver, 'car_')),
    held AS (SELECT incident_id, driver, coalesce(sum(pts) OVER (PARTITION BY season, driver ORDER BY r, d, incident_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS points FROM u)"""


@query("W08_rolling_license_points", f"""WITH {POINTS_SQL}
    SELECT x.incident_id, string_agg(CASE WHEN held.points IS NULL THEN '' ELSE CAST(CAST(held.points AS BIGINT) AS STRING) END, ',' ORDER BY pos)
        AS superlicense_points_before_incident
    FROM x LEFT JOIN held ON x.incident_id = held.incident_id AND x.driver = held.driver GROUP BY x.incident_id""")
def _(spark, sf):
    return points.points_before(roles.multi_incidents(spark, sf))


@query("W09_incidents_with_prior_points", f"WITH {POINTS_SQL} SELECT DISTINCT incident_id FROM held WHERE points > 0")
def _(spark, sf):
    return points.incidents_with_prior_points(roles.multi_incidents(spark, sf))


def parsed(spark, sf) -> DataFrame:
    """Documents with the parsed fields the later steps read, taken from the role columns."""
    rows = roles.fields(spark, sf)
    from adjudica.functions import text as tx
    return rows.select(
        "document_id", "seq", "season", "event", "title", tx.document_type("title").alias("document_type"),
        F.struct("car_number", tx.document_session("session_text").alias("session"), "fact", "offence", "decision", "reason")
        .alias("parsed_fields"))


PRIMARY_SQL = f"""f AS ({FIELDS_SQL}), q AS (SELECT *, {roles.KIND_SQL} AS kind, {roles.DOC_SESSION_SQL} AS session FROM f),
    e AS (SELECT * FROM q WHERE (kind = 'summons' AND decision = '') OR (kind IN ('decision', 'offence', 'infringement') AND (fact <> '' OR decision <> ''))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY season, car_number, session, lower(fact)
        ORDER BY CASE WHEN contains(lower(title), 'correction') THEN 0 ELSE 1 END,
        CASE kind WHEN 'decision' THEN 0 WHEN 'summons' THEN 2 ELSE 1 END, seq) AS rn FROM e)"""


@query("W01_primary_documents", f"WITH {PRIMARY_SQL} SELECT document_id FROM ranked WHERE rn = 1")
def _(spark, sf):
    return primary_documents(parsed(spark, sf)).select("document_id")


_RULED = """CASE WHEN incident_type = 'collision' THEN CASE WHEN contains(lower(fact), 'gained an advantage') AND session IN ('Race', 'Qualifying') THEN '5s'
        WHEN contains(lower(fact), 'racing incident') THEN 'no_action' ELSE 'manual_review' END
    WHEN incident_type = 'track_limits' THEN CASE WHEN {track} < 2 THEN 'warning' WHEN {track} >= 2 THEN '5s' ELSE 'manual_review' END
    WHEN incident_type = 'unsafe_release' THEN '10s' WHEN incident_type = 'pit_lane' THEN 'reprimand' ELSE 'manual_review' END"""


def rule_severity(detail: str) -> str:
    return f"CASE {detail} WHEN 'no_action' THEN 0 WHEN 'manual_review' THEN 0 ELSE 1 END"


def ruled_sql(track: str) -> str:
    return _RULED.format(track=track)


@query("W10_rule_outcome_escalation", f"""WITH {_GRAIN}, h AS (SELECT driver, season, round, {_AGGREGATES} FROM p GROUP BY ALL),
    one AS (SELECT i.*, {ruled_sql("CASE WHEN i.round IS NOT NULL THEN coalesce(h.track5, 0) END")} AS detail
        FROM i LEFT JOIN h ON i.driver = h.driver AND i.season = h.season AND i.round = h.round),
    g2 AS (SELECT driver, season, round, count(*) FILTER ({rule_severity('detail')} > 0) AS pen,
        count(*) FILTER (detail IN ('warning', 'reprimand')) AS warn FROM one WHERE round IS NOT NULL GROUP BY ALL),
    p2 AS (SELECT a.driver, a.season, a.round, b.pen, b.warn, row_number() OVER (PARTITION BY a.driver, a.season, a.round
        ORDER BY b.season DESC, b.round DESC) AS back FROM g2 a JOIN g2 b ON a.driver = b.driver
        AND (b.season < a.season OR (b.season = a.season AND b.round < a.round))),
    h2 AS (SELECT driver, season, round, sum(pen) FILTER (back <= 5) AS pen5, sum(warn) FILTER (back <= 10) AS warn10 FROM p2 GROUP BY ALL)
    SELECT one.row_id, CASE WHEN one.round IS NOT NULL THEN {_zero('h2.pen5')} END AS driver_penalties_last_5_races,
        CASE WHEN one.round IS NOT NULL THEN {_zero('h2.warn10')} END AS driver_warnings_last_10_races,
        one.detail AS normative_penalty_detail
    FROM one LEFT JOIN h2 ON one.driver = h2.driver AND one.season = h2.season AND one.round = h2.round""")
def _(spark, sf):
    rows = rules.predict(roles.incidents(spark, sf), mode="rules")
    return rows.select("row_id", "driver_penalties_last_5_races", "driver_warnings_last_10_races", "normative_penalty_detail")


HISTORY_SQL = f"{_GRAIN}, h AS (SELECT driver, season, round, {_AGGREGATES} FROM p GROUP BY ALL)"
