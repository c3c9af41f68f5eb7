"""The library's inputs, derived from the given tables.

Each role is a set of column expressions that both engines understand; a pair gives the Spark
and the DuckDB spelling where they differ. Roles read whole tables, row by row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


Exprs = Mapping[str, str | tuple[str, str]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _side(expr: str | tuple[str, str], i: int) -> str:
    return expr if isinstance(expr, str) else expr[i]


def select(df: DataFrame, exprs: Exprs) -> DataFrame:
    return df.select(*[F.expr(_side(e, 0)).alias(n) for n, e in exprs.items()])


def select_sql(exprs: Exprs, source: str) -> str:
    columns = ", ".join(f'{_side(e, 1)} AS "{n}"' for n, e in exprs.items())
    return f"SELECT {columns} FROM {source}"


def choose(key: str, n: int, *values: str) -> str:
    """CASE over key modulo the number of values; each value is an SQL expression."""
    assert len(values) == n
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {key} % {n} {arms} ELSE {values[-1]} END"


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_DATE = ("date_format(o_orderdate, 'd MMMM yyyy')", "strftime(o_orderdate, '%-d %B %Y')")

# Driver-grain incidents: one per order, the customer is the driver.
INCIDENT: Exprs = {
    "row_id": "CAST(o_orderkey AS STRING)",
    "incident_id": "CAST(o_orderkey AS STRING)",
    "driver": "CAST(o_custkey AS STRING)",
    "season": "CAST(year(o_orderdate) AS INT)",
    "round": "CASE WHEN o_totalprice >= 9000 THEN CAST(month(o_orderdate) AS INT) END",
    "rounds": "12",
    "incident_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'collision' WHEN '2-HIGH' THEN 'track_limits' "
                     "WHEN '3-MEDIUM' THEN 'unsafe_release' WHEN '4-NOT SPECIFIED' THEN 'other' ELSE 'pit_lane' END",
    "session": "CASE o_orderstatus WHEN 'F' THEN 'Race' WHEN 'O' THEN 'Qualifying' ELSE 'Practice 1' END",
    "circuit": "'circuit_' || CAST(o_custkey % 25 AS STRING)",
    "penalty": choose(CENTS, 7, "'No further action'", "'Warning'", "'Reprimand'", "'5s_time_penalty'",
                      "'3_place_grid_drop'", "''", "'Disqualification'"),
    "penalty_severity": f"CAST({CENTS} % 3 AS INT)",
    "fact": choose(CENTS, 4, "'The driver left the track and gained an advantage'", "'Racing incident'",
                   "'Speeding in the pit lane'", "''"),
    "lap": f"CAST({CENTS} % 61 AS STRING)",
    "full_laps": choose(CENTS, 5, "'60'", "'53'", "'0'", "''", "'abc'"),
    "driver_standing": f"CAST({CENTS} % 20 + 1 AS STRING)",
    "driver_points": f"CAST({CENTS} % 301 AS STRING)",
    "driver_construct_standing": f"CAST({CENTS} % 10 + 1 AS STRING)",
    "opponent": choose(CENTS, 3, "NULL", "'rival'", "'other'"),
    "opponent_standing": choose(CENTS, 3, "NULL", "'4'", "'9'"),
    "opponent_points": choose(CENTS, 3, "NULL", "'100'", "'x'"),
    "driver_team": f"'team_' || CAST({CENTS} % 4 AS STRING)",
    "opponent_team": choose(CENTS, 3, "NULL", "'team_1'", "'team_2'"),
    "completion_percentage": f"CAST({CENTS} % 101 AS DOUBLE)",
}
INCIDENT_SQL = select_sql(INCIDENT, "orders")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "orders"), INCIDENT)


# Incidents with comma-separated cells: none to three parties, some cells of another length.
_A, _B, _C = ("'nation_' || CAST(o_custkey % 25 AS STRING)",
              "'nation_' || CAST((o_custkey * 7 + 3) % 25 AS STRING)",
              "'car_' || CAST(o_custkey % 40 AS STRING)")
_N = "CAST(o_orderkey % 97 AS STRING)"
MULTI: Exprs = {
    "incident_id": f"CAST(year(o_orderdate) AS STRING) || '_race_' || lpad(CAST(o_orderkey AS STRING), 10, '0')",
    "season": "CAST(year(o_orderdate) AS INT)",
    "round": "CASE WHEN o_totalprice >= 9000 THEN CAST(month(o_orderdate) AS STRING) ELSE '' END",
    "session": INCIDENT["session"],
    "date": ("CASE WHEN o_totalprice >= 20000 THEN CAST(o_orderdate AS DATE) END",) * 2,
    "drivers": choose(CENTS, 6, "''", _A, f"{_A} || ',' || {_B}", f"{_A} || ', ' || {_C}",
                      f"{_A} || ',' || {_B} || ',' || {_C}", f"{_C} || ',' || {_A}"),
    "nationalities": choose(CENTS, 6, "''", "'x'", "'x,y'", "'x,'", "'x,y,z'", "',y'"),
    "respective_teams": choose(CENTS, 6, "''", "'t1'", "'t1,t2'", "'t1'", "'t1,t2,t3'", "'t1,t1'"),
    "driver_standings": choose(CENTS, 6, "''", "'1'", "'1,2'", "'3,4'", "'1,2,3'", "'8,9'"),
    "driver_points": choose(CENTS, 6, "''", _N, f"{_N} || ',5'", "''", f"'7,' || {_N} || ',9'", f"'1,' || {_N}"),
    "superlicense_points_added": choose(CENTS, 5, "'0'", "'1'", "'2.0'", "''", "'nan'"),
    "superlicense_points_before_incident": choose(CENTS, 4, "''", "'0'", "'2'", "'1'"),
    "penalty": INCIDENT["penalty"],
    "lap": INCIDENT["lap"],
    "full_laps": INCIDENT["full_laps"],
    "num_drivers": "''",
    "lap_remaining": "''",
    "completion_percentage": "''",
    "flag": choose(CENTS, 3, "'yellow'", "''", "'nan'"),
    "sector": choose(CENTS, 4, "'1'", "'2'", "''", "' '"),
    "positions_of_involved parties": choose(CENTS, 3, "'1,2'", "','", "''"),
    "severity": choose(CENTS, 3, "'2'", "''", "''"),
    "driver_at_fault": choose(CENTS, 5, "'none'", "''", "''", "'car_1'", "' '"),
    "incident_type": INCIDENT["incident_type"],
    "circuit": INCIDENT["circuit"],
}
MULTI_SQL = select_sql(MULTI, "orders")


def multi_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "orders"), MULTI)


# Decision documents: the fields, and the text that carries them.
_CAR = "CAST(o_custkey % 99 + 1 AS STRING)"
_OPP = "CAST((o_custkey * 7) % 99 + 1 AS STRING)"
_TURN = f"CAST({CENTS} % 20 + 1 AS STRING)"
FACT = choose(CENTS, 5, f"'Incident between car ' || {_CAR} || ' and Car ' || {_OPP} || ' in turn ' || {_TURN} || '.'",
              f"'Car ' || {_CAR} || ' left the track at Turn ' || {_TURN}", "'Speeding in the pit lane.'",
              f"'Impeding of car ' || {_OPP}", "''")
OFFENCE = choose(CENTS, 3, "'Breach of Article ' || CAST(o_custkey % 40 AS STRING)", "'Dangerous driving'", "''")
DECISION = choose(CENTS, 9, "'No further action.'", "'Reprimand (driving).'", "'Warning.'", "'The car is disqualified.'",
                  "'Drop of 3 place grid positions, 2 penalty points.'", "'5 second time penalty, 1 penalty point.'",
                  "'Drive through.'", "'Fine of 5000 Euro'", "''")
REASON = choose(CENTS, 4, "'The Stewards found that no driver was wholly or predominantly to blame.'",
                f"'The driver of car ' || {_OPP} || ' was wholly to blame.'",
                "'Considered a racing incident with dangerous speed.'", "'The driver caused a collision.'")
SESSION = choose(CENTS, 8, "'Race'", "'Qualifying'", "'Sprint Qualifying'", "'Free Practice 1'", "'Practice 2'",
                 "'Sprint'", "'Race restart'", "'Testing'")
TITLE = choose(CENTS, 7, f"'Doc 7 - Decision - Car ' || {_CAR}", "'Doc_7_-_Infringement.pdf'", f"'Offence Car ' || {_CAR}",
               "'Summons - Championship Points correction'", "'Final Race Classification'",
               "'Decision - Provisional Starting Grid'", "'Decision - Starting Grid - Correction'")
_NAME = "'Driver ' || chr(CAST(65 + o_custkey % 26 AS INT)) || ' Name' || CAST(o_custkey AS STRING)"


def _line(label: str, value: str) -> str:
    return f"CASE WHEN {value} = '' THEN '' ELSE '{label}' || chr(10) || {value} || chr(10) END"


def _raw_text(side: int) -> str:
    return " || ".join([
        "'From' || chr(10) || 'The Stewards' || chr(10)",
        _line("Document", "CAST(o_orderkey % 90 + 1 AS STRING)"), _line("Date", _DATE[side]), _line("Time", "'18:21'"),
        "CAST(year(o_orderdate) AS STRING) || ' NATION ' || CAST(o_custkey % 25 AS STRING) || ' GRAND PRIX' || chr(10)",
        f"'No / Driver' || chr(10) || {_CAR} || ' - ' || {_NAME} || chr(10)",
        _line("Competitor", "'Team ' || CAST(o_custkey % 10 AS STRING)"),
        _line("Time", "CASE WHEN o_custkey % 2 = 0 THEN '17:52' ELSE '0:45:10' END"), _line("Session", SESSION),
        _line("Fact", FACT), _line("Offence", OFFENCE), _line("Decision", DECISION),
        f"'Reason' || chr(10) || {REASON} || chr(10) || 'Competitors are reminded of their right to appeal.'"])


DOCUMENT: Exprs = {
    "document_id": "'doc_' || CAST(o_orderkey AS STRING)",
    "seq": "o_orderkey",
    "season": "CAST(year(o_orderdate) AS INT)",
    "event": "'Nation ' || CAST(o_custkey % 25 AS STRING) || ' Grand Prix'",
    "title": TITLE,
    "raw_text": (_raw_text(0), _raw_text(1)),
}
# What the parser must find, straight from the tables.
FIELDS: Exprs = {
    "document_id": DOCUMENT["document_id"], "seq": "o_orderkey", "season": DOCUMENT["season"],
    "event": DOCUMENT["event"], "title": TITLE, "cents": CENTS, "custkey": "o_custkey",
    "document_no": "CAST(o_orderkey % 90 + 1 AS STRING)", "date": _DATE,
    "grand_prix": "'NATION ' || CAST(o_custkey % 25 AS STRING) || ' GRAND PRIX'",
    "car_number": _CAR, "driver_name": _NAME, "competitor": "'Team ' || CAST(o_custkey % 10 AS STRING)",
    "incident_time": "CASE WHEN o_custkey % 2 = 0 THEN '17:52' ELSE '0:45:10' END",
    "session_text": SESSION, "fact": FACT, "offence": OFFENCE, "decision": DECISION, "reason": REASON,
    "opponent": _OPP,
}
FIELDS_SQL = select_sql(FIELDS, "orders")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "orders"), DOCUMENT)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "orders"), FIELDS)


# Expected normalisations of the fixed phrases above.
KIND_SQL = ("CASE cents % 7 WHEN 0 THEN 'decision' WHEN 1 THEN 'infringement' WHEN 2 THEN 'offence' "
            "WHEN 3 THEN 'summons' WHEN 4 THEN 'unknown' ELSE 'decision' END")
DOC_SESSION_SQL = ("CASE cents % 8 WHEN 0 THEN 'race' WHEN 1 THEN 'qualifying' WHEN 2 THEN 'qualifying' "
                   "WHEN 3 THEN 'practice' WHEN 4 THEN 'practice' WHEN 5 THEN 'sprint' WHEN 6 THEN 'race' ELSE 'testing' END")
LABEL_SQL = ("CASE cents % 9 WHEN 0 THEN 'no_further_action' WHEN 1 THEN 'reprimand' WHEN 2 THEN 'warning' "
             "WHEN 3 THEN 'disqualification' WHEN 4 THEN '3_place_grid_drop' WHEN 5 THEN '5s_time_penalty' "
             "WHEN 6 THEN 'drive_through' WHEN 7 THEN 'fine_of_5000_euro' ELSE '' END")
FAULT_SQL = "CASE cents % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'car_' || opponent ELSE '' END"
TYPE_SQL = ("CASE WHEN cents % 5 = 0 THEN 'collision' WHEN cents % 5 = 1 THEN 'track_limits' "
            "WHEN cents % 5 = 2 THEN 'pit_lane' WHEN cents % 5 = 3 THEN 'blocking' "
            "WHEN cents % 3 = 1 THEN 'driving_standards' ELSE 'other' END")
OPPONENTS_SQL = ("CASE WHEN cents % 5 IN (0, 3) AND opponent <> car_number THEN opponent ELSE '' END")

# Time-stamped feeds: events by type; a day is a meeting with three sessions.
_DAY = "CAST(day(ts) AS INT)"
_PART = "CAST(event_id % 3 AS INT)"
FEED: Exprs = {
    "event_id": "event_id", "event_type": "event_type", "ts": "ts", "user_id": "user_id", "value": "value",
    "day": _DAY, "session_key": f"{_DAY} * 10 + {_PART}",
    "driver_number": "CAST(user_id % 25 AS INT)",
    "lap_number": "CAST(event_id % 60 + 1 AS INT)",
    "position": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 20 + 1 AS INT) END",
    "flag": choose("event_id", 5, "'YELLOW'", "NULL", "'RED'", "'GREEN'", "NULL"),
    "message": choose("event_id", 7, "'YELLOW IN TRACK SECTOR 17'", "'VIRTUAL SAFETY CAR DEPLOYED'",
                      "'SAFETY CAR IN THIS LAP'", "'Sector 2 clear'", "''", "'CHEQUERED FLAG'", "'BLUE FLAG'"),
    "sector": choose("event_id", 6, "'1'", "'17'", "NULL", "'3'", "'9'", "'x'"),
    "seconds": ("CAST(unix_micros(CAST(ts AS TIMESTAMP)) % 86400000000 AS DOUBLE) / 1000000",
                "CAST(epoch_us(ts) % 86400000000 AS DOUBLE) / 1000000"),
}
FEED_SQL = select_sql(FEED, "events")


def feed(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    rows = select(table(spark, sf_dir, "events"), FEED)
    return rows.where(F.col("event_type").isin(*kinds)) if kinds else rows


# Which event type plays which feed.
PROBE, LAPS, MESSAGES, POSITIONS, SPARE = "purchase", "view", "error", "click", "signup"
