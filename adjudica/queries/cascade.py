"""The enrichment stages as one job: incidents of the event table, all lookups from the tables they are about."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from adjudica.functions.blanks import or_empty
from adjudica.operators import match
from adjudica.plans import enrich
from adjudica.queries import query, roles
from adjudica.queries.joins import NUMBER_SQL, TEAM_SQL, results, roster, sessions, teams
from adjudica.queries.roles import LAPS, MESSAGES, POSITIONS, PROBE, choose, table
from adjudica.queries.scalars import FLAG_SQL, SECTOR_SQL

_DAY = "CAST(day(ts) AS INT)"
_DAY2 = "lpad(CAST(day(ts) AS STRING), 2, '0')"
_OFFSET = "CAST(event_id % 5400 AS INT)"
_CLOCK = (f"CAST({_OFFSET} DIV 3600 AS STRING) || ':' || lpad(CAST({_OFFSET} DIV 60 % 60 AS STRING), 2, '0') || ':' || lpad(CAST({_OFFSET} % 60 AS STRING), 2, '0')",
          f"CAST({_OFFSET} // 3600 AS STRING) || ':' || lpad(CAST({_OFFSET} // 60 % 60 AS STRING), 2, '0') || ':' || lpad(CAST({_OFFSET} % 60 AS STRING), 2, '0')")
# Purchases are the incidents. Some have no event, no round, no party, no time or no date.
CASE = {
    "incident_id": "CAST(event_id AS STRING)", "event_id": "event_id", "event_type": "event_type", "season": "2024", "day": _DAY,
    "part": "CAST(event_id % 3 AS INT)", "kind": "CAST(event_id % 4 AS INT)", "seconds": _OFFSET,
    "event": f"CASE WHEN event_id % 7 = 3 THEN '' ELSE 'Land' || {_DAY2} || ' Grand Prix' END",
    "session": choose("event_id", 3, "'race'", "'qualifying'", "'practice'"),
    "round": f"CASE WHEN event_id % 5 = 0 THEN CAST({_DAY} AS STRING) ELSE '' END",
    "drivers": choose("CAST(user_id + event_id AS BIGINT)", 4, "'nation_' || CAST(user_id % 25 AS STRING)",
                      "'nation_' || CAST(user_id % 25 AS STRING) || ',nation_' || CAST(event_id % 25 AS STRING)", "'car_3,nation_' || CAST(event_id % 25 AS STRING)", "''"),
    "car_number": choose("event_id", 3, "'44'", "''", "'7'"),
    "superlicense_points_added": choose("event_id", 5, "'0'", "'1'", "'2'", "''", "'1'"),
    "lap": choose("event_id", 6, "'5'", *["''"] * 5), "flag": choose("event_id", 8, "'blue'", *["''"] * 7),
    "driver_at_fault": choose("event_id", 10, "'x'", *["''"] * 9),
    "document_id": "CASE WHEN event_id % 9 = 0 THEN '' ELSE 'doc_' || CAST(event_id AS STRING) END",
    "time": tuple(choose("event_id", 4, c, c, "'lap 7'", "''") for c in _CLOCK),
    "date": ("CASE WHEN event_id % 11 = 0 THEN '' ELSE date_format(ts, 'd MMMM yyyy') END", "CASE WHEN event_id % 11 = 0 THEN '' ELSE strftime(ts, '%-d %B %Y') END"),
}
_MESSAGE = "The Stewards found that no driver was wholly or predominantly to blame."
_BLAME = "The driver of car 12 was wholly to blame."


def incidents(spark, sf):
    return roles.select(table(spark, sf, "events").where(F.col("event_type") == PROBE), CASE)


def documents(rows):
    """Two of three incidents have a document that names somebody or nobody."""
    reason = F.when(F.col("event_id") % 3 == 0, _MESSAGE).when(F.col("event_id") % 3 == 1, _BLAME)
    said = rows.where("document_id <> ''").select("document_id", F.lit("").alias("fact"), reason.alias("reason"), F.lit("").alias("decision"))
    return said.where("reason IS NOT NULL").select("document_id", F.struct("fact", "reason", "decision").alias("parsed_fields"))


def sources(spark, sf, rows):
    """Circuits of four days in five, standings by the events of a day, one result list a day."""
    feed = roles.feed(spark, sf)
    days = feed.select("day").distinct()
    name = F.concat(F.lit("Land"), F.lpad(F.col("day").cast("string"), 2, "0"), F.lit(" Grand Prix"))
    two = F.lpad(F.col("day").cast("string"), 2, "0")
    season = F.lit(2024).alias("season")
    circuits = days.where("day % 5 <> 0").select(
        name.alias("event_name"), F.concat(F.lit("ring_"), two).alias("circuit"), F.concat(F.lit("land_"), two).alias("country"),
        (F.col("day") + 1950).alias("first_season"), (F.col("day") + 50).alias("total_laps"), F.col("day").alias("ordinal"))
    local = days.where("day % 5 <> 0").select(season, F.concat(F.lit("ring_"), two).alias("circuit"), F.col("day").alias("round"), name.alias("event"))
    drivers = table(spark, sf, "nation").where("n_nationkey % 7 <> 0").selectExpr(
        "'nation_' || CAST(n_nationkey AS STRING) AS driver", "'Land ' || CAST(n_nationkey AS STRING) AS nationality", "CAST(1980 + n_nationkey AS STRING) AS debut")

    def ranked(group, *keys):
        order = Window.partitionBy(*keys).orderBy(F.col("points").desc(), group)
        return feed.select("day", F.col("driver_number").alias("k"), (F.col("driver_number") % 5).alias("t")).groupBy(*keys, group).agg(
            F.count("*").alias("points")).withColumn("position", F.row_number().over(order))

    team = F.concat(F.lit("old-"), F.col("t").cast("string"))
    by_season = ranked("k", F.lit(1).alias("one")).select(
        season, F.concat(F.lit("nation_"), F.col("k").cast("string")).alias("driver"), "position", "points",
        F.concat(F.lit("old_"), (F.col("k") % 5).cast("string")).alias("team"))
    teams_of_season = ranked("t", F.lit(1).alias("one")).select(
        season, F.expr("CASE WHEN t < 4 THEN 'team_' || CAST(t AS STRING) ELSE 'old_4' END AS team"), "position", "points")
    standings = ranked("k", "day").select(
        season, F.col("day").alias("round"), F.col("position").alias("ordinal"), F.concat(F.lit("nation-"), F.col("k").cast("string")).alias("driver_id"),
        F.concat(F.lit("Family "), F.col("k").cast("string")).alias("family_name"), F.concat(F.lit("N"), F.col("k").cast("string")).alias("code"),
        F.concat(F.lit("Land "), F.col("k").cast("string")).alias("nationality"), F.col("position").cast("string").alias("position"),
        F.col("points").cast("string").alias("points"), F.concat(F.lit("old-"), (F.col("k") % 5).cast("string")).alias("constructor_id"))
    team_standings = ranked("t", "day").select(
        season, F.col("day").alias("round"), F.col("position").alias("ordinal"), team.alias("constructor_id"),
        F.col("position").cast("string").alias("position"), F.col("points").cast("string").alias("points"))
    raced = days.select(season, F.col("day").alias("round"), F.explode(F.expr(
        "filter(array(named_struct('number', '44', 'k', day % 25), named_struct('number', if(day % 2 = 0, '7', ''), 'k', (day + 1) % 25)), x -> x.number <> '')")).alias("r"))
    raced = raced.select("season", "round", "r.number", F.concat(F.lit("Nation-"), F.col("r.k").cast("string")).alias("driver_id"), F.lit(1).alias("seq"))

    def of(kind):
        return feed.where(F.col("event_type") == kind)

    def frame(kind, *columns):
        session = F.expr("CASE session_key % 10 WHEN 0 THEN 'race' WHEN 1 THEN 'qualifying' ELSE 'practice' END")
        return of(kind).withColumn("Time", F.col("seconds") - 21600 * (F.col("session_key") % 10)).select(
            season, F.col("day").alias("round"), session.alias("session"), "Time", *columns)

    return enrich.Sources(
        circuits=circuits, drivers=drivers, teams=teams(spark, sf),
        seasons={"calendar": local, "seasons": local.groupBy("season").agg(F.countDistinct("circuit").alias("rounds")).withColumn("num_teams", F.lit(5)),
                 "drivers": by_season, "teams": teams_of_season},
        calendar=days.select(season, F.col("day").alias("round"), name.alias("race_name"), F.concat(F.lit("fetched_"), two).alias("circuit_id"),
                             F.concat(F.lit("country_"), two).alias("country")),
        standings=standings, team_standings=team_standings, results=raced,
        schedule=days.select(season, F.col("day").alias("round"), F.explode(F.expr("array('race', 'qualifying', 'practice')")).alias("session"),
                             F.expr("make_timestamp(2024, 1, day, 0, 0, 0)").alias("start_ts")),
        local_rounds=local.select("season", "event", "round"), sessions=sessions(spark, sf),
        feed={"laps": of(LAPS).select("session_key", "lap_number", F.col("ts").alias("date_start"), F.col("event_id").alias("seq")),
              "messages": of(MESSAGES).select("session_key", F.col("ts").alias("date"), "flag", "message", "sector", F.col("event_id").alias("seq")),
              "positions": of(POSITIONS).select("session_key", "driver_number", "position", F.col("ts").alias("date"), F.col("event_id").alias("seq"))},
        frames={"laps": frame(LAPS, F.col("driver_number").alias("DriverNumber"), F.col("lap_number").alias("LapNumber"), F.col("position").alias("Position"),
                              F.col("event_id").alias("seq")),
                "messages": frame(MESSAGES, F.col("message").alias("Message"), F.col("flag").alias("Flag"), F.col("sector").alias("Sector"), F.col("event_id").alias("seq")),
                "weather": frame("signup", (F.col("value") > 20).alias("Rainfall"), F.lit("Dry").alias("TrackStatus"))},
        feed_numbers=match.number_keys(results(spark, sf), roster(spark, sf), ["session_key"]),
        frame_numbers=match.number_keys(results(spark, sf), None, ["session_key"]).select(
            season.alias("_year"), F.floor(F.col("session_key") / 10).cast("int").alias("_round"), "key", "number").distinct(),
        documents=documents(rows))


def corpus(spark, sf):
    rows = incidents(spark, sf)
    side = rows.select("incident_id", "event", "car_number", "document_id", "time", "date")
    return enrich.enrich_all(rows, side, sources(spark, sf, rows), tolerance=1800)


def _nearest(kind: str, columns: str, keys: str, condition: str = "true") -> str:
    return f"""SELECT e2.event_id, {columns} FROM e2 LEFT JOIN fe ON fe.event_type = '{kind}' AND {keys} AND {condition}
        AND abs(fe.seconds - 21600 * (fe.session_key % 10) - e2.att) <= 1800 GROUP BY e2.event_id"""


_FAR = "abs(fe.seconds - 21600 * (fe.session_key % 10) - e2.att)"
_CELL = "string_agg(coalesce(CAST({0} AS STRING), ''), ',' ORDER BY pos)"
CASCADE_SQL = f"""WITH {NUMBER_SQL.split("    le AS")[0].rstrip().rstrip(",")},
    inc AS (SELECT *, event <> '' AND day % 5 <> 0 AS known FROM ({roles.select_sql(CASE, 'events')}) WHERE event_type = '{PROBE}'),
    nt AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 7 <> 0),
    ss AS (SELECT driver_number AS k, count(*) AS points, row_number() OVER (ORDER BY count(*) DESC, driver_number) AS position FROM fe GROUP BY 1),
    ts AS (SELECT driver_number % 5 AS t, count(*) AS points, row_number() OVER (ORDER BY count(*) DESC, driver_number % 5) AS position FROM fe GROUP BY 1),
    st AS (SELECT day, driver_number AS k, count(*) AS points, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, driver_number) AS position FROM fe GROUP BY 1, 2),
    tst AS (SELECT day, driver_number % 5 AS t, count(*) AS points, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, driver_number % 5) AS position FROM fe GROUP BY 1, 2),
    x1 AS (SELECT event_id, unnest(string_split(drivers, ',')) AS driver, unnest(range(len(string_split(drivers, ',')))) AS pos FROM inc WHERE drivers <> ''),
    y1 AS (SELECT *, CASE WHEN starts_with(driver, 'nation_') THEN CAST(split_part(driver, '_', 2) AS INT) END AS k FROM x1),
    c1 AS (SELECT event_id, {_CELL.format("'land_' || nt.k")} AS nationalities, {_CELL.format('2024 - 1980 - nt.k')} AS years_in_sport,
        {_CELL.format('ss.position')} AS driver_standings, {_CELL.format(TEAM_SQL.format('ss.k'))} AS respective_teams, {_CELL.format('ts.position')} AS construct_standings
        FROM y1 LEFT JOIN nt ON y1.k = nt.k LEFT JOIN ss ON y1.k = ss.k LEFT JOIN ts ON ss.k % 5 = ts.t GROUP BY 1),
    e1 AS (SELECT inc.*, CASE WHEN round <> '' THEN round WHEN known THEN CAST(day AS STRING) ELSE '' END AS r1,
        CASE WHEN known THEN 'ring_' || lpad(CAST(day AS STRING), 2, '0') ELSE '' END AS circuit1, CASE WHEN known THEN 'land_' || lpad(CAST(day AS STRING), 2, '0') ELSE '' END AS country1,
        CASE WHEN known AND session = 'race' THEN CAST(50 + day AS STRING) ELSE '' END AS full1,
        CASE WHEN drivers <> '' OR event = '' THEN drivers WHEN car_number = '44' THEN 'nation_' || day % 25 WHEN car_number = '7' AND day % 2 = 0 THEN 'nation_' || (day + 1) % 25 ELSE '' END AS d2,
        CASE WHEN kind < 2 THEN seconds END AS att FROM inc),
    x2 AS (SELECT event_id, day, part, event, car_number, att, unnest(string_split(d2, ',')) AS driver, unnest(range(len(string_split(d2, ',')))) AS pos FROM e1 WHERE d2 <> ''),
    y2 AS (SELECT *, CASE WHEN starts_with(driver, 'nation_') THEN CAST(split_part(driver, '_', 2) AS INT) END AS k FROM x2),
    c2 AS (SELECT event_id, count(st.k) AS hits, {_CELL.format("'land_' || st.k")} AS nationalities, {_CELL.format('st.position')} AS driver_standings, {_CELL.format('st.points')} AS driver_points,
        {_CELL.format(TEAM_SQL.format('st.k'))} AS respective_teams, {_CELL.format('tst.position')} AS construct_standings, {_CELL.format('tst.points')} AS construct_points
        FROM y2 LEFT JOIN st ON y2.event <> '' AND st.day = y2.day - 1 AND st.k = y2.k LEFT JOIN tst ON tst.day = st.day AND tst.t = st.k % 5 GROUP BY 1),
    top AS (SELECT day, string_agg('nation_' || k, ',' ORDER BY position) AS best FROM st WHERE position <= 4 GROUP BY 1),
    e2 AS (SELECT e1.*, CASE WHEN r1 = '' AND event <> '' THEN CAST(day AS STRING) ELSE r1 END AS r2,
        CASE WHEN circuit1 = '' AND event <> '' THEN 'fetched_' || lpad(CAST(day AS STRING), 2, '0') ELSE circuit1 END AS circuit2,
        CASE WHEN country1 = '' AND event <> '' THEN 'country_' || lpad(CAST(day AS STRING), 2, '0') ELSE country1 END AS country2,
        CASE WHEN event <> '' THEN day * 10 + part END AS session_key FROM e1),
    la AS (SELECT e2.event_id, arg_max(fe.lap_number, fe.seconds) AS lap FROM e2 JOIN fe ON fe.event_type = '{LAPS}' AND fe.session_key = e2.session_key
        AND fe.seconds <= 21600 * e2.part + e2.att GROUP BY 1),
    ml AS (SELECT session_key, max(lap_number) AS top FROM fe WHERE event_type = '{LAPS}' GROUP BY 1),
    m4 AS ({_nearest(MESSAGES, f"arg_min(struct_pack(f := fe.flag, m := fe.message, s := fe.sector), {_FAR}) AS b", "fe.session_key = e2.session_key")}),
    s4 AS (SELECT event_id, CASE WHEN hit THEN {FLAG_SQL} ELSE '' END AS flag, CASE WHEN hit THEN {SECTOR_SQL} ELSE '' END AS sector
        FROM (SELECT event_id, b IS NOT NULL AS hit, b.f AS flag, b.m AS message, b.s AS sector FROM m4)),
    n4 AS (SELECT x2.*, x2.day * 10 + x2.part AS session_key, CASE WHEN starts_with(driver, 'car_') THEN NULL WHEN pos = 0 AND car_number <> '' THEN CAST(car_number AS INT) ELSE coalesce(a.n, b.n) END AS number
        FROM x2 LEFT JOIN num a ON x2.day * 10 + x2.part = a.session_key AND x2.driver = a.key LEFT JOIN num b ON x2.day * 10 + x2.part = b.session_key AND split_part(x2.driver, '_', -1) = b.key
        WHERE x2.event <> ''),
    p4 AS (SELECT e2.event_id, e2.pos, arg_min(fe.position, {_FAR}) AS position FROM n4 e2 LEFT JOIN fe ON fe.event_type = '{POSITIONS}' AND fe.position IS NOT NULL
        AND fe.session_key = e2.session_key AND fe.driver_number = e2.number AND {_FAR} <= 1800 GROUP BY ALL),
    q4 AS (SELECT event_id, {_CELL.format('position')} AS cells, count(position) AS hits FROM p4 GROUP BY 1),
    e4 AS (SELECT e2.*, CASE WHEN e2.lap <> '' THEN e2.lap WHEN session_key IS NULL THEN '' WHEN kind = 2 THEN '7' ELSE coalesce(CAST(la.lap AS STRING), '') END AS lap4,
        CASE WHEN full1 <> '' THEN full1 ELSE coalesce(CAST(ml.top AS STRING), '') END AS full4, CASE WHEN e2.flag <> '' THEN e2.flag ELSE s4.flag END AS flag4, s4.sector AS sector4,
        CASE WHEN q4.hits > 0 THEN q4.cells ELSE '' END AS pos4, TRY_CAST(nullif(r2, '') AS INT) AS r5
        FROM e2 LEFT JOIN la USING (event_id) LEFT JOIN ml USING (session_key) LEFT JOIN s4 USING (event_id) LEFT JOIN q4 USING (event_id)),
    f5 AS (SELECT *, seconds - 21600 * (session_key % 10) AS tm, session_key % 10 AS part FROM fe),
    l5 AS (SELECT e4.event_id, max(f5.lap_number) AS lap FROM e4 JOIN f5 ON f5.event_type = '{LAPS}' AND f5.day = e4.r5 AND f5.part = e4.part AND f5.tm <= e4.att GROUP BY 1),
    m5 AS (SELECT e4.event_id, arg_min(struct_pack(f := f5.flag, m := f5.message, s := f5.sector), abs(f5.tm - e4.att)) AS b FROM e4 LEFT JOIN f5 ON f5.event_type = '{MESSAGES}'
        AND f5.day = e4.r5 AND f5.part = e4.part AND abs(f5.tm - e4.att) <= 1800 GROUP BY 1),
    s5 AS (SELECT event_id, hit, message AS m, CASE WHEN hit THEN {FLAG_SQL} ELSE '' END AS flag, CASE WHEN hit THEN {SECTOR_SQL} ELSE '' END AS sector
        FROM (SELECT event_id, b IS NOT NULL AS hit, b.f AS flag, b.m AS message, b.s AS sector FROM m5)),
    c5 AS (SELECT day, part, bool_or(contains(message, 'VIRTUAL')) AS v, bool_or(contains(message, 'SAFETY CAR') AND NOT contains(message, 'VIRTUAL')) AS c FROM f5 WHERE event_type = '{MESSAGES}' GROUP BY 1, 2),
    w5 AS (SELECT day, part, arg_max(value, tm) > 20 AS rain FROM f5 WHERE event_type = 'signup' GROUP BY 1, 2),
    num5 AS (SELECT DISTINCT session_key // 10 AS day, 'nation_' || k AS key, 100 + k AS n FROM res),
    n5 AS (SELECT y.*, e4.r5, CASE WHEN starts_with(y.driver, 'car_') THEN NULL WHEN y.pos = 0 AND y.car_number <> '' THEN CAST(y.car_number AS INT) ELSE num5.n END AS number
        FROM x2 y JOIN e4 USING (event_id) LEFT JOIN num5 ON num5.day = e4.r5 AND num5.key = y.driver),
    p5 AS (SELECT n5.event_id, n5.pos, arg_min(f5.position, abs(f5.tm - n5.att)) AS position FROM n5 LEFT JOIN f5 ON f5.event_type = '{LAPS}' AND f5.position IS NOT NULL
        AND f5.day = n5.r5 AND f5.part = n5.part AND f5.driver_number = n5.number AND abs(f5.tm - n5.att) <= 1800 GROUP BY ALL),
    q5 AS (SELECT event_id, {_CELL.format('position')} AS cells, count(position) AS hits FROM p5 GROUP BY 1),
    ml5 AS (SELECT day AS r5, part, max(lap_number) AS top FROM f5 WHERE event_type = '{LAPS}' GROUP BY 1, 2),
    e5 AS (SELECT e4.*, CASE WHEN lap4 <> '' THEN lap4 WHEN kind = 2 THEN '7' ELSE coalesce(CAST(l5.lap AS STRING), '') END AS lap5,
        CASE WHEN full4 <> '' THEN full4 ELSE coalesce(CAST(ml5.top AS STRING), '') END AS full5, CASE WHEN flag4 <> '' THEN flag4 ELSE s5.flag END AS flag5,
        CASE WHEN sector4 <> '' THEN sector4 ELSE s5.sector END AS sector5, CASE WHEN pos4 <> '' THEN pos4 WHEN q5.hits > 0 THEN q5.cells ELSE '' END AS pos5,
        CASE WHEN rain IS NULL THEN '' WHEN rain THEN 'rain' ELSE 'sunny' END AS weather, CASE WHEN rain IS NULL THEN '' WHEN rain THEN 'wet' ELSE 'dry' END AS track,
        CASE WHEN att IS NULL THEN CASE WHEN c THEN 'safety_car' WHEN v THEN 'vsc' WHEN c IS NOT NULL THEN 'none' ELSE '' END WHEN NOT s5.hit THEN ''
            WHEN contains(m, 'VIRTUAL') THEN 'vsc' WHEN contains(m, 'SAFETY CAR') THEN 'safety_car' ELSE 'none' END AS safety
        FROM e4 LEFT JOIN l5 USING (event_id) LEFT JOIN s5 USING (event_id) LEFT JOIN q5 USING (event_id) LEFT JOIN ml5 ON ml5.r5 = e4.r5 AND ml5.part = e4.part
        LEFT JOIN c5 ON c5.day = e4.r5 AND c5.part = e4.part LEFT JOIN w5 ON w5.day = e4.r5 AND w5.part = e4.part),
    u6 AS (SELECT DISTINCT x2.event_id, incident_id, coalesce(r5, 999) AS r, CASE WHEN date = '' THEN DATE '9999-12-31' ELSE make_date(2024, 1, e5.day) END AS d, x2.driver,
        CASE WHEN x2.driver = list_filter(string_split(d2, ','), lambda v: NOT starts_with(v, 'car_'))[1] THEN coalesce(TRY_CAST(nullif(superlicense_points_added, '') AS INT), 0) ELSE 0 END AS pts
        FROM x2 JOIN e5 USING (event_id) WHERE NOT starts_with(x2.driver, 'car_')),
    h6 AS (SELECT event_id, driver, coalesce(sum(pts) OVER (PARTITION BY driver ORDER BY r, d, incident_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS points FROM u6),
    q6 AS (SELECT event_id, {_CELL.format('CAST(points AS BIGINT)')} AS held FROM x2 LEFT JOIN h6 USING (event_id, driver) GROUP BY 1),
    done AS (SELECT e5.*, coalesce(q6.held, '') AS held, CASE WHEN document_id = '' THEN '' WHEN part = 0 THEN 'none' WHEN part = 1 THEN 'car_12' ELSE '' END AS fault,
        CASE WHEN c2.hits > 0 THEN c2.nationalities ELSE coalesce(c1.nationalities, '') END AS nationalities, CASE WHEN c2.hits > 0 THEN c2.driver_standings ELSE coalesce(c1.driver_standings, '') END AS driver_standings,
        CASE WHEN c2.hits > 0 THEN c2.respective_teams ELSE coalesce(c1.respective_teams, '') END AS respective_teams, CASE WHEN c2.hits > 0 THEN c2.construct_standings ELSE coalesce(c1.construct_standings, '') END AS construct_standings,
        coalesce(c1.years_in_sport, '') AS years_in_sport, coalesce(CASE WHEN event <> '' THEN top.best END, (SELECT string_agg('nation_' || k, ',' ORDER BY position) FROM ss WHERE position <= 4)) AS top4,
        coalesce(c2.hits, 0) AS hits, c2.driver_points AS points2, c2.construct_points AS cpoints2, event <> '' AND top.best IS NOT NULL AS top_hit
        FROM e5 LEFT JOIN c1 USING (event_id) LEFT JOIN c2 USING (event_id) LEFT JOIN q6 USING (event_id) LEFT JOIN top ON top.day = e5.day - 1)"""


@query("E01_E07_enrichment_cascade", f"""{CASCADE_SQL} SELECT incident_id, r2 AS round, circuit2 AS circuit, country2 AS country, CASE WHEN known THEN CAST(1950 + day AS STRING) ELSE '' END AS first_season,
    d2 AS drivers, nationalities, driver_standings, respective_teams, construct_standings, years_in_sport, top4 AS current_top_4_drivers, lap5 AS lap, full5 AS full_laps, flag5 AS flag, sector5 AS sector,
    pos5 AS positions, weather AS weather_conditions, track AS track_conditions, safety AS safety_car, held AS superlicense_points_before_incident,
    CASE WHEN driver_at_fault <> '' THEN driver_at_fault ELSE fault END AS driver_at_fault, '5' AS num_teams, CAST((SELECT count(DISTINCT day) FROM fe WHERE day % 5 <> 0) AS STRING) AS rounds FROM done""")
def _(spark, sf):
    rows = corpus(spark, sf).incidents
    names = ("round", "circuit", "country", "first_season", "drivers", "nationalities", "driver_standings", "respective_teams", "construct_standings", "years_in_sport",
             "current_top_4_drivers", "lap", "full_laps", "flag", "sector", "weather_conditions", "track_conditions", "safety_car",
             "superlicense_points_before_incident", "driver_at_fault", "num_teams", "rounds")
    return rows.select("incident_id", *[or_empty(c).alias(c) for c in names], or_empty(F.col(f"`{enrich.POSITIONS}`")).alias("positions"))


def _written(field: str, source: str, stage: int, value: str, when: str) -> str:
    return f"SELECT incident_id, '{field}' AS field, '{source}' AS source, {stage} AS stage, CAST({value} AS STRING) AS value FROM done WHERE {when}"


_RECORDS = [
    _written("round", "standings_feed", 2, "r2", "r1 <> r2"), _written("circuit", "standings_feed", 2, "circuit2", "circuit1 <> circuit2"),
    _written("country", "standings_feed", 2, "country2", "country1 <> country2"),
    *[_written(c, "standings_feed", 2, v, "hits > 0") for c, v in (
        ("nationalities", "nationalities"), ("driver_standings", "driver_standings"), ("driver_points", "points2"), ("respective_teams", "respective_teams"),
        ("construct_standings", "construct_standings"), ("construct_points", "cpoints2"))],
    _written("current_top_4_drivers", "standings_feed", 2, "top4", "top_hit"),
    *[_written(c, "race_feed", 4, f"{v}4", f"{old} = '' AND {v}4 <> ''") for c, v, old in (
        ("lap", "lap", "lap"), ("full_laps", "full", "full1"), ("flag", "flag", "flag"), ("sector", "sector", "''"), (enrich.POSITIONS, "pos", "''"))],
    *[_written(c, "session_frames", 5, f"{v}5", f"{v}4 = '' AND {v}5 <> ''") for c, v in (
        ("lap", "lap"), ("full_laps", "full"), ("flag", "flag"), ("sector", "sector"), (enrich.POSITIONS, "pos"))],
    *[_written(c, "session_frames", 5, v, f"{v} <> ''") for c, v in (("weather_conditions", "weather"), ("track_conditions", "track"), ("safety_car", "safety"))],
    _written("superlicense_points_before_incident", "corpus_rolling", 6, "held", "held <> ''"),
    _written("driver_at_fault", "text_fields", 7, "fault", "fault <> ''"), _written("severity", "text_fields", 7, "1", "true"),
    _written("session_offset_seconds", "timestamp", 8, "CAST(att AS DOUBLE)", "att IS NOT NULL"), _written("lap", "timestamp", 8, "7", "kind = 2"),
]


@query("E01_E07_cascade_provenance", f"""{CASCADE_SQL}, all_records AS ({' UNION ALL '.join(_RECORDS)})
    SELECT incident_id, field, arg_max(source, stage) AS source, arg_max(value, stage) AS value FROM all_records GROUP BY incident_id, field""")
def _(spark, sf):
    return corpus(spark, sf).provenance.select("incident_id", "field", "source", F.col("details")["value"].alias("value"))
