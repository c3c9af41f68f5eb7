"""Lookups, ranked matches and as-of joins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from adjudica.constants import SEVERITY_NAMES
from adjudica.functions import text as tx
from adjudica.functions.multi import split_drop
from adjudica.operators import features, learning, lookup, match, metrics, rules, textset
from adjudica.operators.asof import asof_backward, asof_nearest, max_until
from adjudica.operators.fill import latest_provenance, provenance_rate
from adjudica.operators.flatten import flatten_incidents
from adjudica.operators.running import running
from adjudica.queries import query, roles
from adjudica.queries.projections import (
    CIRCUIT_SQL, FLAT_SQL, META_SQL, PROVENANCE_SQL, _typed, circuits, meta, provenance, text_sql,
)
from adjudica.queries.roles import CENTS, FEED_SQL, FIELDS_SQL, INCIDENT_SQL, LAPS, MESSAGES, MULTI_SQL, POSITIONS, PROBE, choose, table

_NATION = "o_custkey % 25"


@query("J01_incident_meta", f"""WITH m AS ({MULTI_SQL}), t AS ({META_SQL}) SELECT m.incident_id, document_id, parse_confidence FROM m LEFT JOIN t ON m.incident_id = t.incident_id""")
def _(spark, sf):
    return lookup.with_meta(roles.multi_incidents(spark, sf), meta(spark, sf)).select("incident_id", "document_id", "parse_confidence")


@query("J02_event_circuit", f"""WITH f AS ({FIELDS_SQL}), {CIRCUIT_SQL} SELECT document_id,
    coalesce(circuit, 'nation_' || CAST(custkey % 25 AS STRING)) AS circuit FROM f LEFT JOIN nat ON custkey % 25 = k""")
def _(spark, sf):
    return lookup.resolve_circuit(roles.fields(spark, sf), circuits(spark, sf)).select("document_id", "circuit")


_EVENTS = {"season": "CAST(year(o_orderdate) AS INT)", "event": choose(
    CENTS, 5, f"'Nation ' || CAST({_NATION} AS STRING) || ' Grand Prix'", f"'NATION ' || CAST({_NATION} AS STRING) || ' grand prix '",
    f"CAST({_NATION} AS STRING) || ' Grand Prix'", "'Atlantis Grand Prix'", "''")}
_CALENDAR = {"season": "CAST(year(o_orderdate) AS INT)", "circuit": f"'ring_' || CAST({_NATION} AS STRING)",
             "round": f"CAST({_NATION} + 1 AS INT)", "race_name": f"'Nation ' || CAST({_NATION} AS STRING) || ' Grand Prix'"}
_LOCAL_SQL = f"""ev AS (SELECT DISTINCT * FROM ({roles.select_sql(_EVENTS, 'orders')})), cal AS (SELECT DISTINCT * FROM ({roles.select_sql(_CALENDAR, 'orders')})), {CIRCUIT_SQL},
    loc AS (SELECT ev.season, event, coalesce(min(k) FILTER (event = 'Nation ' || k || ' Grand Prix'),
        min(k) FILTER (contains(lower('Nation ' || k || ' Grand Prix'), trim(replace(lower(event), 'grand prix', ''))))) AS k
    FROM ev CROSS JOIN nat WHERE event <> '' GROUP BY ALL)"""


def _events(spark, sf):
    return roles.select(table(spark, sf, "orders"), _EVENTS)


def _calendar(spark, sf):
    return roles.select(table(spark, sf, "orders"), _CALENDAR).distinct()


@query("J03_event_to_local_round", f"""WITH {_LOCAL_SQL} SELECT loc.season, event, circuit, round FROM loc
    LEFT JOIN cal ON loc.season = cal.season AND cal.circuit = 'ring_' || loc.k WHERE loc.k IS NOT NULL""")
def _(spark, sf):
    return match.local_rounds(_events(spark, sf), circuits(spark, sf), _calendar(spark, sf).select("season", "circuit", "round")).select(
        "season", "event", F.col("circuit"), "round")


_PART_EVENT = {"season": "p_size", "event": choose(
    "p_partkey", 7, "p_name", "upper(p_name) || ' GRAND PRIX'", "'Formula 1 ' || replace(p_name, 'e', 'é') || ' Grand Prix!'",
    "split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 1) || ' arena'", "'the ' || p_name || ' open'", "'Grand Prix'")}
_NORM = r"trim(regexp_replace(replace(regexp_replace(lower(strip_accents({0})), '\bformula\s*(1|one)\b', ' ', 'g'), 'grand prix', ' '), '[^a-z0-9]+', ' ', 'g'))"
_RANKED_SQL = f"""e AS (SELECT DISTINCT season, event, {_NORM.format('event')} AS t FROM ({roles.select_sql(_PART_EVENT, 'part')}) WHERE event <> ''),
    c AS (SELECT season, name, CAST(dense_rank() OVER (PARTITION BY season ORDER BY name) AS INT) AS round FROM (SELECT DISTINCT p_size AS season, p_name AS name FROM part)),
    pair AS (SELECT e.season, event, round, CASE WHEN lower(event) = name THEN 1 WHEN t = '' THEN NULL WHEN t = name THEN 2
            WHEN contains(t, name) OR contains(name, t) THEN 4 END AS rank,
        t <> '' AND len(list_intersect(string_split(t, ' '), string_split(name, ' '))) > 0 AS shared FROM e JOIN c ON e.season = c.season),
    best AS (SELECT season, event, coalesce(arg_min(round, rank * 1000 + round) FILTER (rank IS NOT NULL),
        CASE WHEN count(*) FILTER (shared) = 1 THEN min(round) FILTER (shared) END) AS round FROM pair GROUP BY ALL)"""


@query("J04_ranked_event_match", f"WITH {_RANKED_SQL} SELECT season, event, round FROM best")
def _(spark, sf):
    part = table(spark, sf, "part")
    # Few names per size: the rank of a name is the number of smaller ones plus one.
    names = part.select(F.col("p_size").alias("season"), F.col("p_name").alias("race_name")).distinct()
    ranked = running(names.withColumn("_cell", F.left("race_name", F.lit(2))), ["season"], ["_cell"], [F.col("race_name")], F.lit(1), "n")
    calendar = ranked.select("season", "race_name", (F.col("n") + 1).cast("int").alias("round"))
    return match.ranked_rounds(roles.select(part, _PART_EVENT), calendar)


@query("J05_corner_sector", f"""WITH f AS ({FIELDS_SQL}), {CIRCUIT_SQL} SELECT document_id, CASE WHEN k IS NOT NULL AND cents % 5 IN (0, 1)
    THEN CAST(CAST(floor((cents % 20) / 7) AS INT) + 1 AS STRING) ELSE '' END AS sector FROM f LEFT JOIN nat ON custkey % 25 = k""")
def _(spark, sf):
    ring = circuits(spark, sf)
    rows = lookup.resolve_circuit(roles.fields(spark, sf).withColumn("turn_number", tx.turn_number("fact")), ring)
    return lookup.corner_sector(rows, ring).select("document_id", "sector")


# Standings: nations score one point per order of the month; regions act as constructors.
_STANDING_GRAIN = {"season": "CAST(year(o_orderdate) AS INT)", "round": "CAST(month(o_orderdate) AS INT)", "k": f"CAST({_NATION} AS INT)"}
STANDING_SQL = f"""sg AS (SELECT season, round, k, count(*) AS points FROM ({roles.select_sql(_STANDING_GRAIN, 'orders')}) GROUP BY ALL),
    st AS (SELECT *, row_number() OVER (PARTITION BY season, round ORDER BY points DESC, k) AS position FROM sg),
    tg AS (SELECT season, round, k % 5 AS t, count(*) AS points FROM ({roles.select_sql(_STANDING_GRAIN, 'orders')}) GROUP BY ALL),
    tst AS (SELECT *, row_number() OVER (PARTITION BY season, round ORDER BY points DESC, t) AS position FROM tg)"""


def standings(spark, sf):
    """(season, round, driver) standings; every fifth driver is known only by code."""
    grain = roles.select(table(spark, sf, "orders"), _STANDING_GRAIN)
    order = Window.partitionBy("season", "round").orderBy(F.col("points").desc(), "k")
    rows = grain.groupBy("season", "round", "k").agg(F.count(F.lit(1)).alias("points")).withColumn("position", F.row_number().over(order))
    return rows.select("season", "round", F.col("position").alias("ordinal"), F.expr(
        "CASE WHEN k % 5 = 0 THEN 'alias-' || CAST(k AS STRING) ELSE 'nation-' || CAST(k AS STRING) END AS driver_id"),
        F.expr("'Family ' || CAST(k AS STRING) AS family_name"),
        F.expr("CASE WHEN k % 5 = 0 THEN CAST(k AS STRING) ELSE 'N' || CAST(k AS STRING) END AS code"),
        F.expr("'Land ' || CAST(k AS STRING) AS nationality"), F.col("position").cast("string").alias("position"),
        F.col("points").cast("string").alias("points"), F.expr("'old-' || CAST(k % 5 AS STRING) AS constructor_id"))


def team_standings(spark, sf):
    grain = roles.select(table(spark, sf, "orders"), _STANDING_GRAIN).withColumn("t", F.col("k") % 5)
    order = Window.partitionBy("season", "round").orderBy(F.col("points").desc(), "t")
    rows = grain.groupBy("season", "round", "t").agg(F.count(F.lit(1)).alias("points")).withColumn("position", F.row_number().over(order))
    return rows.select("season", "round", F.col("position").alias("ordinal"), F.expr("'old-' || CAST(t AS STRING) AS constructor_id"),
                       F.col("position").cast("string").alias("position"), F.col("points").cast("string").alias("points"))


def teams(spark, sf):
    """Regions as teams, each with two legacy ids; region 4 is not known."""
    return table(spark, sf, "region").where("r_regionkey < 4").selectExpr(
        "'team_' || CAST(r_regionkey AS STRING) AS team_id", "r_regionkey AS ordinal",
        "array('old_' || CAST(r_regionkey AS STRING), 'older_' || CAST(r_regionkey AS STRING)) AS legacy_ids")


LISTED_SQL = f"""m AS ({MULTI_SQL}), l AS (SELECT *, list_transform(string_split(drivers, ','), lambda v: trim(v)) AS ds FROM m WHERE drivers <> ''),
    x AS (SELECT *, unnest(ds) AS driver, unnest(range(len(ds))) AS pos, TRY_CAST(nullif(round, '') AS INT) AS rnd FROM l),
    d AS (SELECT *, CASE WHEN starts_with(driver, 'nation_') THEN CAST(split_part(driver, '_', 2) AS INT) END AS k FROM x)"""
TEAM_SQL = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} % 5 < 4 THEN 'team_' || ({0} % 5) ELSE 'old_4' END"


@query("J06_season_driver_fields", f"""WITH {LISTED_SQL}, {STANDING_SQL},
    s AS (SELECT season, k, sum(points) AS pts, row_number() OVER (PARTITION BY season ORDER BY sum(points) DESC, k) AS pos FROM sg GROUP BY season, k),
    ts AS (SELECT season, t, sum(points) AS pts, row_number() OVER (PARTITION BY season ORDER BY sum(points) DESC, t) AS pos FROM tg GROUP BY season, t)
    SELECT incident_id, string_agg(CASE WHEN d.k IS NULL OR d.k % 7 = 0 THEN '' ELSE 'land_' || d.k END, ',' ORDER BY d.pos) AS nationalities,
        string_agg(coalesce(CAST(s.pos AS STRING), ''), ',' ORDER BY d.pos) AS driver_standings,
        string_agg(coalesce(CAST(CAST(s.pts AS BIGINT) AS STRING), ''), ',' ORDER BY d.pos) AS driver_points,
        string_agg(coalesce({TEAM_SQL.format('s.k')}, ''), ',' ORDER BY d.pos) AS respective_teams,
        string_agg(CASE WHEN d.k IS NULL OR d.k % 7 = 0 THEN '' ELSE CAST(greatest(d.season - (1980 + d.k), 0) AS STRING) END, ',' ORDER BY d.pos) AS years_in_sport,
        string_agg(coalesce(CAST(ts.pos AS STRING), ''), ',' ORDER BY d.pos) AS construct_standings
    FROM d LEFT JOIN s ON d.season = s.season AND d.k = s.k LEFT JOIN ts ON d.season = ts.season AND s.k % 5 = ts.t GROUP BY incident_id""")
def _(spark, sf):
    drivers, season, team_rows = season_tables(spark, sf)
    fields = lookup.season_driver_fields(roles.multi_incidents(spark, sf), drivers, season, team_rows, teams(spark, sf))
    return fields.select("incident_id", "nationalities", "driver_standings", "driver_points", "respective_teams", "years_in_sport",
                         "construct_standings")


def season_tables(spark, sf):
    """Driver profiles, season driver standings and season team standings."""
    drivers = table(spark, sf, "nation").where("n_nationkey % 7 <> 0").selectExpr(
        "'nation_' || CAST(n_nationkey AS STRING) AS driver", "'Land ' || CAST(n_nationkey AS STRING) AS nationality",
        "CAST(1980 + n_nationkey AS STRING) AS debut")
    grain = roles.select(table(spark, sf, "orders"), _STANDING_GRAIN)
    season = grain.groupBy("season", "k").agg(F.count(F.lit(1)).alias("points"))
    order = Window.partitionBy("season").orderBy(F.col("points").desc(), "k")
    season = season.withColumn("position", F.row_number().over(order)).select(
        "season", F.expr("'nation_' || CAST(k AS STRING) AS driver"), "position", "points", F.expr("'old_' || CAST(k % 5 AS STRING) AS team"))
    by_team = grain.groupBy("season", (F.col("k") % 5).alias("t")).agg(F.count(F.lit(1)).alias("points"))
    order = Window.partitionBy("season").orderBy(F.col("points").desc(), "t")
    by_team = by_team.withColumn("position", F.row_number().over(order)).select(
        "season", F.expr("CASE WHEN t < 4 THEN 'team_' || CAST(t AS STRING) ELSE 'old_4' END AS team"), "position", "points")
    return drivers, season, by_team


def _listed(spark, sf):
    rows = roles.multi_incidents(spark, sf).select(
        "incident_id", "season", F.col("round").try_cast("int").alias("round"), F.posexplode(split_drop("drivers")).alias("pos", "driver"))
    return rows


@query("J07_prior_round_standings", f"""WITH {LISTED_SQL}, {STANDING_SQL}
    SELECT incident_id, d.pos, driver, CAST(st.position AS STRING) AS standing, CAST(st.points AS STRING) AS points
    FROM d LEFT JOIN st ON d.season = st.season AND d.rnd = st.round + 1 AND d.k = st.k""")
def _(spark, sf):
    rows = lookup.prior_round_standings(_listed(spark, sf), standings(spark, sf))
    return rows.select("incident_id", "pos", "driver", F.col("standing.position").alias("standing"), F.col("standing.points").alias("points"))


_TEAM = {"o_orderkey": "o_orderkey", "team_id": choose(CENTS, 4, "'team_' || CAST(o_custkey % 5 AS STRING)", "'old_' || CAST(o_custkey % 5 AS STRING)",
                                                      "'older_' || CAST(o_custkey % 5 AS STRING)", "'unknown'")}


@query("J08_legacy_team_ids", f"""WITH t AS ({roles.select_sql(_TEAM, 'orders')}) SELECT o_orderkey, team_id,
    CASE WHEN team_id <> 'unknown' AND split_part(team_id, '_', 2) <> '4' THEN 'team_' || split_part(team_id, '_', 2) ELSE team_id END AS canonical FROM t""")
def _(spark, sf):
    return lookup.resolve_teams(roles.select(table(spark, sf, "orders"), _TEAM), teams(spark, sf)).select("o_orderkey", "team_id", "canonical")


_BY_CAR = {"incident_id": "CAST(o_orderkey AS STRING)", "season": "CAST(year(o_orderdate) AS INT)", "round": "CAST(month(o_orderdate) AS INT)",
           "car_number": "CAST(o_custkey % 99 + 1 AS STRING)", "drivers": choose(CENTS, 3, "''", "'someone'", "' '")}
_RESULTS = {"season": _BY_CAR["season"], "round": _BY_CAR["round"], "number": "CAST((o_custkey * 3) % 99 + 1 AS STRING)",
            "driver_id": "'Driver-' || CAST(o_custkey AS STRING)", "seq": "o_orderkey"}


@query("J09_driver_from_car_number", f"""WITH i AS ({roles.select_sql(_BY_CAR, 'orders')}), r AS ({roles.select_sql(_RESULTS, 'orders')}),
    b AS (SELECT season, round, number, arg_max(replace(lower(driver_id), '-', '_'), seq) AS driver FROM r GROUP BY ALL)
    SELECT incident_id, CASE WHEN trim(drivers) = '' AND driver IS NOT NULL THEN driver ELSE drivers END AS drivers
    FROM i LEFT JOIN b ON i.season = b.season AND i.round = b.round AND i.car_number = b.number""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return lookup.drivers_from_car(roles.select(orders, _BY_CAR), roles.select(orders, _RESULTS)).select("incident_id", "drivers")


_DAY2 = "lpad(CAST({} AS STRING), 2, '0')"
_WANTED = {"event_id": "event_id", "season": "2024", "ts": "ts", "day": "CAST(day(ts) AS INT)",
           "event": "CASE event_id % 5 " + " ".join(
               f"WHEN {i} THEN {v}" for i, v in enumerate((
                   f"'Land' || {_DAY2.format('day(ts)')} || ' Grand Prix'", f"'Grand Prix of CITY' || {_DAY2.format('day(ts)')}",
                   f"'track' || {_DAY2.format('day(ts)')}", "'Nowhere Grand Prix'"))) + " ELSE '' END",
           "session": choose("user_id", 5, "'race'", "'Qualifying'", "'practice'", "'sprint'", "'Race'")}


def wanted_sessions(spark, sf):
    return roles.select(table(spark, sf, "events"), _WANTED)


def sessions(spark, sf):
    """One meeting per day with a race, a qualifying and a practice session."""
    days = roles.feed(spark, sf).select("day", "session_key").distinct()
    return days.selectExpr(
        "2024 AS season", "day AS meeting_key", "session_key", "session_key AS seq",
        "CASE session_key % 10 WHEN 0 THEN 'Race' WHEN 1 THEN 'Qualifying' ELSE 'Practice' END AS session_type",
        "CASE session_key % 10 WHEN 0 THEN 'Race' WHEN 1 THEN 'Qualifying' ELSE 'Practice ' || CAST(day % 2 + 1 AS STRING) END AS session_name",
        "'Land' || lpad(CAST(day AS STRING), 2, '0') AS country_name", "'City' || lpad(CAST(day AS STRING), 2, '0') AS location",
        "'Track' || lpad(CAST(day AS STRING), 2, '0') AS circuit_short_name",
        "make_timestamp(2024, 1, day, 6 * (CAST(session_key AS INT) % 10), 0, 0) AS date_start")


SESSION_KEY_SQL = "CASE lower(session) WHEN 'race' THEN 0 WHEN 'qualifying' THEN 1 WHEN 'practice' THEN 2 END"


@query("J10_session_match", f"""WITH w AS (SELECT DISTINCT season, event, session, day FROM ({roles.select_sql(_WANTED, 'events')})),
    s AS (SELECT DISTINCT session_key FROM ({FEED_SQL}))
    SELECT season, event, session, day AS meeting_key, day * 10 + {SESSION_KEY_SQL} AS session_key FROM w
    WHERE event NOT IN ('', 'Nowhere Grand Prix') AND day * 10 + {SESSION_KEY_SQL} IN (SELECT session_key FROM s)""")
def _(spark, sf):
    return match.session_keys(wanted_sessions(spark, sf), sessions(spark, sf)).select("season", "event", "session", "meeting_key", "session_key")


_LISTED_EVENT = {"event_id": "event_id", "session_key": roles.FEED["session_key"], "ts": "ts", "event_type": "event_type",
                 "car_number": choose("event_id", 3, "'44'", "''", "'n/a'"),
                 "drivers": choose("event_id", 4, "'nation_' || CAST(user_id % 25 AS STRING)", "'nation_' || CAST(user_id % 25 AS STRING) || ',n' || CAST(event_id % 25 AS STRING)",
                                   "'car_3,nation_' || CAST(event_id % 25 AS STRING)", "'ghost,x_' || CAST(user_id % 25 AS STRING)")}


def roster(spark, sf):
    """Drivers seen in a session's position feed."""
    seen = roles.feed(spark, sf, POSITIONS).groupBy("session_key", "driver_number").agg(F.min("event_id").alias("seq"))
    return seen.selectExpr("session_key", "driver_number", "seq", "'Nation ' || CAST(driver_number AS STRING) AS full_name",
                           "'N' || CAST(driver_number AS STRING) AS name_acronym")


def results(spark, sf):
    """Race sessions also have results that give another number to some drivers."""
    return roles.feed(spark, sf, LAPS).where("session_key % 10 = 0").selectExpr(
        "session_key", "'Nation-' || CAST(driver_number AS STRING) AS driver_id", "CAST(driver_number + 100 AS STRING) AS number", "event_id AS seq")


NUMBER_SQL = f"""fe AS ({FEED_SQL}), ros AS (SELECT DISTINCT session_key, driver_number AS k FROM fe WHERE event_type = '{POSITIONS}'),
    res AS (SELECT DISTINCT session_key, driver_number AS k FROM fe WHERE event_type = '{LAPS}' AND session_key % 10 = 0),
    keyed AS (SELECT session_key, 'nation_' || k AS key, 100 + k AS n, 0 AS p FROM res UNION ALL SELECT session_key, unnest(['nation_' || k, CAST(k AS STRING), 'n' || k]), k, 1 FROM ros),
    num AS (SELECT session_key, key, arg_min(n, p) AS n FROM keyed GROUP BY ALL),
    le AS (SELECT *, string_split(drivers, ',') AS ds FROM ({roles.select_sql(_LISTED_EVENT, 'events')})),
    lx AS (SELECT *, unnest(ds) AS driver, unnest(range(len(ds))) AS pos FROM le),
    numbered AS (SELECT lx.*, CASE WHEN starts_with(driver, 'car_') THEN NULL WHEN pos = 0 AND car_number = '44' THEN 44 ELSE coalesce(a.n, b.n) END AS driver_number
        FROM lx LEFT JOIN num a ON lx.session_key = a.session_key AND lx.driver = a.key
        LEFT JOIN num b ON lx.session_key = b.session_key AND split_part(lx.driver, '_', -1) = b.key)"""


@query("J11_driver_numbers", f"WITH {NUMBER_SQL} SELECT event_id, pos, driver, driver_number FROM numbered")
def _(spark, sf):
    numbers = match.number_keys(results(spark, sf), roster(spark, sf), ["session_key"])
    listed = roles.select(table(spark, sf, "events"), _LISTED_EVENT)
    rows = listed.select("event_id", "session_key", "car_number", F.posexplode(split_drop("drivers")).alias("pos", "driver"))
    return match.driver_numbers(rows, numbers, ["session_key"]).select("event_id", "pos", "driver", "driver_number")


def _us(a: str, b: str) -> str:
    return f"(epoch_us({a}) - epoch_us({b}))"


@query("J12_asof_backward", f"""WITH fe AS ({FEED_SQL}) SELECT p.event_id, arg_max(l.lap_number, l.ts) AS lap_number,
    round(min({_us('p.ts', 'l.ts')}) / 1000000.0, 6) AS error_seconds FROM fe p LEFT JOIN fe l
    ON l.event_type = '{LAPS}' AND p.session_key = l.session_key AND l.ts <= p.ts WHERE p.event_type = '{PROBE}' GROUP BY p.event_id""")
def _(spark, sf):
    rows = asof_backward(roles.feed(spark, sf, PROBE), roles.feed(spark, sf, LAPS), ["session_key"], "ts", "ts", ["lap_number"], "event_id")
    return rows.select("event_id", "match.lap_number", F.round("match.error_seconds", 6).alias("error_seconds"))


@query("J13_asof_nearest", f"""WITH fe AS ({FEED_SQL}) SELECT p.event_id, arg_min(l.message, abs({_us('p.ts', 'l.ts')})) AS message,
    round(min(abs({_us('p.ts', 'l.ts')})) / 1000000.0, 6) AS error_seconds FROM fe p LEFT JOIN fe l
    ON l.event_type = '{MESSAGES}' AND p.session_key = l.session_key AND abs({_us('p.ts', 'l.ts')}) <= 1800000000 WHERE p.event_type = '{PROBE}' GROUP BY p.event_id""")
def _(spark, sf):
    rows = asof_nearest(roles.feed(spark, sf, PROBE), roles.feed(spark, sf, MESSAGES), ["session_key"], "ts", "ts", ["message"], 1800, "event_id")
    return rows.select("event_id", "match.message", F.round("match.error_seconds", 6).alias("error_seconds"))


@query("J14_keyed_asof_nearest", f"""WITH {NUMBER_SQL}, near AS (SELECT n.event_id, n.pos, arg_min(f.position, abs({_us('n.ts', 'f.ts')})) AS position
        FROM numbered n LEFT JOIN fe f ON f.event_type = '{POSITIONS}' AND f.position IS NOT NULL AND n.session_key = f.session_key
            AND n.driver_number = f.driver_number AND abs({_us('n.ts', 'f.ts')}) <= 7200000000 WHERE n.event_type = '{PROBE}' GROUP BY ALL)
    SELECT event_id, string_agg(coalesce(CAST(position AS STRING), ''), ',' ORDER BY pos) AS positions FROM near GROUP BY event_id""")
def _(spark, sf):
    numbers = match.number_keys(results(spark, sf), roster(spark, sf), ["session_key"])
    listed = roles.select(table(spark, sf, "events"), _LISTED_EVENT).where(F.col("event_type") == PROBE)
    rows = listed.select("event_id", "session_key", "car_number", "ts", F.posexplode(split_drop("drivers")).alias("pos", "driver"))
    rows = match.driver_numbers(rows, numbers, ["session_key"])
    feed = roles.feed(spark, sf, POSITIONS).where("position IS NOT NULL")
    near = asof_nearest(rows, feed, ["session_key", "driver_number"], "ts", "ts", ["position"], 7200, "event_id")
    return lookup.regroup(near.withColumn("positions", F.col("match.position")), "event_id", "positions")


@query("J15_highest_until", f"""WITH fe AS ({FEED_SQL}) SELECT p.event_id, max(l.lap_number) AS highest FROM fe p LEFT JOIN fe l
    ON l.event_type = '{LAPS}' AND p.session_key = l.session_key AND l.seconds <= p.seconds WHERE p.event_type = '{PROBE}' GROUP BY p.event_id""")
def _(spark, sf):
    rows = max_until(roles.feed(spark, sf, PROBE), roles.feed(spark, sf, LAPS), ["session_key"], "seconds", "seconds", "lap_number")
    return rows.select("event_id", "highest")


@query("J16_leader_points_join", f"""WITH i AS ({INCIDENT_SQL}), lead AS (SELECT season, round,
        arg_min(CAST(driver_points AS DOUBLE), CAST(driver_standing AS INT) * 1000 - CAST(driver_points AS INT)) AS leader_points FROM i WHERE round IS NOT NULL GROUP BY ALL)
    SELECT row_id, leader_points FROM i LEFT JOIN lead ON i.season = lead.season AND i.round = lead.round""")
def _(spark, sf):
    rows = roles.incidents(spark, sf)
    return rows.join(features.leader_points(rows), ["season", "round"], "left").select("row_id", "leader_points")


# Two models have scored two overlapping sets of orders; where one is judged alone, it has scored all of them.
_PRED = {"row_id": "CAST(o_orderkey AS STRING)", "penalty_severity": roles.INCIDENT["penalty_severity"], "pred": f"CAST({CENTS} % 11 % 3 AS INT)",
         "proba_no_penalty": f"CAST({CENTS} % 10 AS DOUBLE) / 20", "proba_minor": f"CAST({CENTS} % 7 AS DOUBLE) / 20",
         "proba_major": f"CAST({CENTS} % 4 AS DOUBLE) / 20"}
_PRED2 = {**_PRED, "proba_no_penalty": _PRED["proba_major"], "proba_major": _PRED["proba_no_penalty"]}
ALL_PRED_SQL = roles.select_sql(_PRED, "orders")
PRED_SQL = roles.select_sql(_PRED, "orders WHERE o_totalprice >= 100000")
PRED2_SQL = roles.select_sql(_PRED2, "orders WHERE o_totalprice < 300000")
_PROBA = tuple(f"proba_{n}" for n in SEVERITY_NAMES.values())


def all_predictions(spark, sf):
    return roles.select(table(spark, sf, "orders"), _PRED)


def predictions(spark, sf):
    return roles.select(table(spark, sf, "orders").where("o_totalprice >= 100000"), _PRED)


def tabular_predictions(spark, sf):
    return roles.select(table(spark, sf, "orders").where("o_totalprice < 300000"), _PRED2)


@query("J17_prediction_join", f"WITH i AS ({INCIDENT_SQL}), p AS ({PRED_SQL}) SELECT i.row_id, pred FROM i JOIN p ON i.row_id = p.row_id")
def _(spark, sf):
    return roles.incidents(spark, sf).join(predictions(spark, sf).select("row_id", "pred"), "row_id").select("row_id", "pred")


@query("J18_modality_join", f"""WITH a AS ({PRED_SQL}), b AS ({PRED2_SQL}) SELECT a.row_id, a.penalty_severity,
    {", ".join(f"a.{c} AS nlp_{c}, b.{c} AS tab_{c}" for c in _PROBA)} FROM a JOIN b ON a.row_id = b.row_id""")
def _(spark, sf):
    return learning.assert_overlap(learning.merge_modalities(predictions(spark, sf), tabular_predictions(spark, sf)))


@query("J19_fact_text_join", f"""WITH i AS ({INCIDENT_SQL}), f AS (SELECT CAST(o_orderkey AS STRING) AS incident_id, 'noted in ' || o_orderpriority AS fact FROM orders WHERE o_totalprice >= 100000)
    SELECT row_id, trim(i.fact || ' ' || coalesce(f.fact, '')) AS fact FROM i LEFT JOIN f ON i.incident_id = f.incident_id""")
def _(spark, sf):
    return rules.attach_facts(roles.incidents(spark, sf), facts(spark, sf)).select("row_id", "fact")


def facts(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice >= 100000").selectExpr(
        "CAST(o_orderkey AS STRING) AS incident_id", "'noted in ' || o_orderpriority AS fact")


# Parsed documents exist for all but cheap orders, so every loss reason occurs.
DOC_TABLE_SQL = f"docs AS (SELECT * FROM ({FIELDS_SQL}) WHERE seq IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 60000))"
TEXT_ROWS_SQL = f"""{FLAT_SQL}, t AS ({META_SQL}), {DOC_TABLE_SQL}, tx AS (SELECT document_id AS did, {text_sql(False)} AS text FROM docs),
    joined AS (SELECT flat.incident_id || '_' || driver AS row_id, flat.season, flat.penalty, CASE WHEN t.incident_id IS NULL THEN 'missing_meta'
        WHEN t.document_id = '' THEN 'missing_document_id' WHEN tx.did IS NULL THEN 'missing_document' END AS drop_reason, tx.text
    FROM flat LEFT JOIN t ON flat.incident_id = t.incident_id LEFT JOIN tx ON t.document_id = tx.did)"""


def document_table(spark, sf):
    kept = table(spark, sf, "orders").where("o_totalprice >= 60000").select(F.col("o_orderkey").alias("seq"))
    return _typed(spark, sf).join(kept, "seq", "left_semi")


@query("J20_text_loss_reasons", f"WITH {TEXT_ROWS_SQL} SELECT row_id, drop_reason, md5(CASE WHEN drop_reason IS NULL THEN text END) AS digest FROM joined")
def _(spark, sf):
    rows = flatten_incidents(roles.multi_incidents(spark, sf))
    built = textset.text_rows(rows, meta(spark, sf).drop("event"), document_table(spark, sf))
    return built.select("row_id", "drop_reason", F.md5("text").alias("digest"))


@query("J21_lost_incidents", f"WITH {FLAT_SQL} SELECT incident_id FROM m WHERE incident_id NOT IN (SELECT incident_id FROM flat)")
def _(spark, sf):
    rows = roles.multi_incidents(spark, sf)
    return rows.join(flatten_incidents(rows), "incident_id", "left_anti").select("incident_id")


@query("J22_provenance_presence", f"""WITH {PROVENANCE_SQL} SELECT round(count(*) FILTER (rec.source = 'timestamp' AND detail IS NOT NULL) / count(*), 4) AS rate
    FROM m LEFT JOIN rec ON m.incident_id = rec.incident_id AND rec.field = 'lap' WHERE round <> ''""")
def _(spark, sf):
    return provenance_rate(roles.multi_incidents(spark, sf), latest_provenance(provenance(spark, sf)), "lap", "timestamp", "round_used")


@query("J23_mode_with_fallback", f"""WITH i AS ({INCIDENT_SQL}), c AS (SELECT circuit, penalty_severity AS v, count(*) AS n FROM i WHERE season <= 1998 AND circuit <> 'circuit_3' GROUP BY ALL),
    modes AS (SELECT circuit, arg_min(v, -n * 10 + v) AS v FROM c GROUP BY circuit), top AS (SELECT arg_min(v, -n * 10 + v) AS v FROM (SELECT v, sum(n) AS n FROM c GROUP BY v))
    SELECT row_id, coalesce(modes.v, (SELECT v FROM top)) AS pred FROM i LEFT JOIN modes ON i.circuit = modes.circuit""")
def _(spark, sf):
    rows = roles.incidents(spark, sf)
    train = rows.where("season <= 1998 AND circuit <> 'circuit_3'")
    overall = metrics.group_modes(train, None, "penalty_severity")
    return lookup.mode_lookup(rows, metrics.group_modes(train, "circuit", "penalty_severity"), overall.scalar(), "circuit", "pred").select("row_id", "pred")


@query("J24_round_cascade", f"""WITH {_LOCAL_SQL}, o AS (SELECT o_orderkey, o_totalprice >= 200000 AS own, {", ".join(f"{e} AS {n}" for n, e in _EVENTS.items())},
        CAST(month(o_orderdate) AS INT) AS m, {_NATION} AS nk FROM orders)
    SELECT o_orderkey, CASE WHEN own THEN m WHEN o.event = '' THEN NULL WHEN loc.k IS NOT NULL THEN loc.k + 1
        WHEN contains(o.event, 'Atlantis') THEN NULL WHEN contains(lower(o.event), 'nation') THEN o.nk + 1 ELSE fb.r END AS round
    FROM o LEFT JOIN loc ON o.season = loc.season AND o.event = loc.event
    LEFT JOIN (SELECT ev.season, ev.event, min(cal.round) AS r FROM ev JOIN cal ON ev.season = cal.season
        AND contains(lower(cal.race_name), ' ' || trim(replace(lower(ev.event), 'grand prix', ''))) GROUP BY ALL) fb ON o.season = fb.season AND o.event = fb.event""")
def _(spark, sf):
    calendar = _calendar(spark, sf)
    rows = roles.select(table(spark, sf, "orders"), {
        "o_orderkey": "o_orderkey", **_EVENTS, "round": "CASE WHEN o_totalprice >= 200000 THEN CAST(month(o_orderdate) AS STRING) ELSE '' END"})
    local = match.local_rounds(rows, circuits(spark, sf), calendar.select("season", "circuit", "round"))
    fetched = match.ranked_rounds(rows, calendar.select("season", "round", "race_name"))
    return lookup.resolve_round(rows, local, fetched).select("o_orderkey", "round")

