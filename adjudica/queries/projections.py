"""P01-P19 projections and filters, R01-R09 nested data."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.constants import INCIDENT_COLUMNS, TITLE_EXCLUDE, TITLE_INCLUDE
from adjudica.functions import text as tx
from adjudica.functions.blanks import number
from adjudica.functions.multi import join_keep, split_drop, split_keep
from adjudica.functions.scoring import penalty_severity
from adjudica.operators import encode, features, fill, flatten, learning, prior, quality, selection, splits, textset
from adjudica.operators.documents import incident_rows, is_eligible, primary_documents
from adjudica.queries import query, roles
from adjudica.queries.roles import CENTS, FIELDS_SQL, INCIDENT_SQL, MULTI_SQL, choose, table
from adjudica.queries.windows import PRIMARY_SQL, parsed
from adjudica.sources.readers import is_legend

_ID = roles.MULTI["incident_id"]
META: roles.Exprs = {
    "incident_id": _ID,
    "document_id": choose(CENTS, 5, "''", *["'doc_' || CAST(o_orderkey AS STRING)"] * 4),
    "parse_confidence": choose(CENTS, 3, "CAST(1.0 AS DOUBLE)", "CAST(0.667 AS DOUBLE)", "CAST(0.5 AS DOUBLE)"),
    "severity_suggestion": choose(CENTS, 4, "3", "NULL", "1", "2"),
    "driver_at_fault_suggestion": choose(CENTS, 5, "'car_9'", "''", "'none'", "'none'", "NULL"),
    "driver_at_fault_confidence": choose(CENTS, 7, "CAST(0.9 AS DOUBLE)", "CAST(0.65 AS DOUBLE)", "CAST(0 AS DOUBLE)", "NULL",
                                         "CAST(0.72 AS DOUBLE)", "CAST(0.88 AS DOUBLE)", "CAST(0.5 AS DOUBLE)"),
    "time_parse_method": choose(CENTS, 4, "'document_clock'", "'session_elapsed'", "NULL", "'lap_hint'"),
    "session_offset_seconds": choose(CENTS, 4, "CAST(1800 AS DOUBLE)", "NULL", "NULL", "NULL"),
    "event": "'Nation ' || CAST(o_custkey % 25 AS STRING) || ' Grand Prix'",
}
# Incidents of small orders have no meta row.
META_FROM = "orders WHERE o_totalprice >= 30000"
META_SQL = roles.select_sql(META, META_FROM)


def meta(spark, sf):
    return roles.select(table(spark, sf, "orders").where("o_totalprice >= 30000"), META)


def _split_sql(column: str) -> str:
    return f"CASE WHEN trim({column}) = '' THEN [] ELSE list_transform(string_split({column}, ','), lambda v: trim(v)) END"


def _pick_sql(column: str, index: str) -> str:
    return f"nullif(CASE WHEN len({column}) = 0 THEN NULL WHEN len({column}) = 1 THEN {column}[1] ELSE {column}[{index}] END, '')"


_CELLS = {"nationalities": "nat", "respective_teams": "team", "driver_standings": "st", "driver_points": "pts",
          "superlicense_points_before_incident": "lic"}
FLAT_SQL = f"""m AS ({MULTI_SQL}), c AS (SELECT *, {_split_sql('drivers')} AS ds,
        {", ".join(f"{_split_sql(c)} AS {a}" for c, a in _CELLS.items())} FROM m),
    ok AS (SELECT * FROM c WHERE len(ds) > 0 AND {" AND ".join(f"(len({a}) = 0 OR len({a}) = len(ds))" for a in _CELLS.values())}),
    flat AS (SELECT *, unnest(ds) AS driver, unnest(range(1, len(ds) + 1)) AS pos FROM ok)"""


@query("P01_schema_conform", f"WITH m AS ({MULTI_SQL}) SELECT " + ", ".join(
    f"coalesce(CAST(\"{c}\" AS STRING), '') AS \"{c}\"" if c in roles.MULTI else f"'' AS \"{c}\"" for c in INCIDENT_COLUMNS) + " FROM m")
def _(spark, sf):
    return quality.conform(roles.multi_incidents(spark, sf))


@query("P02_title_filter", f"WITH f AS ({FIELDS_SQL}) SELECT document_id, title FROM f WHERE cents % 7 NOT IN (4, 5)")
def _(spark, sf):
    return roles.fields(spark, sf).where(tx.title_included("title", TITLE_INCLUDE, TITLE_EXCLUDE)).select("document_id", "title")


_LEGEND = {"incident_id": choose(CENTS, 11, *["CAST(o_orderkey AS STRING)"] * 10, "' * legend'"),
           "drivers": choose(CENTS, 13, *["'a,b'"] * 12, "'**'")}


@query("P03_legend_filter", f"""WITH m AS ({roles.select_sql(_LEGEND, 'orders')})
    SELECT incident_id, drivers FROM m WHERE incident_id <> ' * legend' AND drivers <> '**'""")
def _(spark, sf):
    return roles.select(table(spark, sf, "orders"), _LEGEND).where(~is_legend())


@query("P04_trainable_filter", f"WITH i AS ({INCIDENT_SQL}) SELECT row_id, penalty FROM i WHERE penalty <> ''")
def _(spark, sf):
    return roles.incidents(spark, sf).where(penalty_severity("penalty").isNotNull()).select("row_id", "penalty")


@query("P05_document_eligibility", f"""WITH f AS ({FIELDS_SQL}) SELECT document_id, (({roles.KIND_SQL}) = 'summons' AND decision = '')
    OR (({roles.KIND_SQL}) IN ('decision', 'offence', 'infringement') AND (fact <> '' OR decision <> '')) AS eligible FROM f""")
def _(spark, sf):
    return roles.fields(spark, sf).select("document_id", is_eligible(
        tx.document_type("title"), F.col("fact"), F.col("decision")).alias("eligible"))


@query("P06_season_threshold", f"WITH i AS ({INCIDENT_SQL}) SELECT row_id, season FROM i WHERE season >= 1998")
def _(spark, sf):
    return roles.incidents(spark, sf).where(F.col("season") >= 1998).select("row_id", "season")


_FEATURES = ("circuit", "session", "incident_type", "driver", "opponent", "driver_team", "opponent_team", "round", "season",
             "rounds", "lap", "full_laps", "completion_percentage", "driver_standing", "driver_construct_standing",
             "opponent_standing", "opponent_points")


@query("P07_leakage_safe_projection", f"WITH i AS ({INCIDENT_SQL}) SELECT row_id, {', '.join(_FEATURES)} FROM i")
def _(spark, sf):
    rows = roles.incidents(spark, sf)
    return rows.select("row_id", *features.feature_columns(rows))


@query("P08_feature_groups", f"""WITH i AS ({INCIDENT_SQL}) SELECT row_id, {', '.join(_FEATURES)},
    CASE WHEN completion_percentage <= 33 THEN 'early' WHEN completion_percentage <= 66 THEN 'middle' WHEN completion_percentage <= 85
        THEN 'late' ELSE 'final_laps' END AS race_stage,
    round(round / 12.0, 6) AS round_progress, coalesce(round = 1, false) AS is_first_round, coalesce(round = 12, false) AS is_last_round FROM i""")
def _(spark, sf):
    rows = features.race_features(roles.incidents(spark, sf))
    rows = prior.history_features(rows).withColumn("round_progress", F.round("round_progress", 6))
    return rows.select("row_id", *features.group_columns(rows, ["race"]))


@query("P09_leakage_assertion", f"WITH i AS ({INCIDENT_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled FROM i" for c in _FEATURES))
def _(spark, sf):
    rows = roles.incidents(spark, sf)
    columns = features.feature_columns(rows)
    features.assert_no_leakage(columns)
    counts = rows.agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "filled")


@query("P10_fill_gaps", f"""WITH m AS ({MULTI_SQL}) SELECT incident_id, CASE WHEN flag IN ('', 'nan') THEN 'green' ELSE flag END AS flag,
    CASE WHEN lap <> '7' THEN lap ELSE sector END AS sector, CASE WHEN trim(sector) = '' THEN lap ELSE sector END AS fallback FROM m""")
def _(spark, sf):
    rows = roles.multi_incidents(spark, sf)
    new = F.when(F.col("lap") != "7", F.col("lap")).otherwise("nan")
    filled = fill.fill_columns(rows.withColumn("fallback", fill.first_filled(F.col("sector"), F.col("lap"))),
                               {"flag": F.lit("green"), "sector": new}, always=("sector",))
    return filled.select("incident_id", "flag", "sector", "fallback")


_SPARSE = ("drivers", "flag", "lap", "sector", "round", "driver_at_fault", "num_drivers", "positions_of_involved parties")


@query("P11_missingness_drop", f"WITH m AS ({MULTI_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN trim(\"{c}\") = '' THEN 1.0 ELSE 0 END) <= 0.4 AS kept FROM m" for c in _SPARSE))
def _(spark, sf):
    kept, dropped = selection.drop_sparse(roles.multi_incidents(spark, sf), _SPARSE)
    return spark.createDataFrame([(c, True) for c in kept] + [(c, False) for c in dropped], "column string, kept boolean")


@query("P12_misclassified_rows", f"""WITH i AS ({INCIDENT_SQL}) SELECT row_id, incident_id, penalty, session, penalty_severity AS actual_severity,
    CAST(CAST(lap AS INT) % 3 AS INT) AS predicted_severity FROM i WHERE penalty_severity <> CAST(lap AS INT) % 3""")
def _(spark, sf):
    return learning.errors(roles.incidents(spark, sf).withColumn("pred", (number("lap") % 3).cast("int")), "pred")


SPLITS = {"train_seasons": [1995, 1996, 1997, 1998], "validation_season": 1999, "test_season": [2000, 2001]}
SPLIT_SQL = "CASE WHEN season <= 1998 THEN 'train' WHEN season = 1999 THEN 'validation' ELSE 'test' END"


@query("P13_temporal_split", f"WITH i AS ({INCIDENT_SQL}) SELECT row_id, {SPLIT_SQL} AS split FROM i")
def _(spark, sf):
    return splits.temporal_split(roles.incidents(spark, sf), SPLITS).select("row_id", "split")


def _typed(spark, sf):
    return roles.fields(spark, sf).withColumns({
        "session": tx.document_session("session_text"), "document_type": tx.document_type("title")})


def text_sql(decision: bool) -> str:
    tail = ", CASE WHEN decision <> '' THEN '[DECISION] ' || decision END, '[REASON] ' || reason" if decision else ""
    return f"""concat_ws(chr(10), '[SESSION] ' || {roles.DOC_SESSION_SQL}, '[EVENT] ' || event, '[DOCTYPE] ' || {roles.KIND_SQL},
        CASE WHEN fact <> '' THEN '[FACT] ' || fact END, CASE WHEN offence <> '' THEN '[OFFENCE] ' || offence END{tail})"""


@query("P14_text_profiles", f"""WITH f AS ({FIELDS_SQL}) SELECT document_id, CASE WHEN fact <> '' THEN '[FACT] ' || fact ELSE '' END AS fact_only,
    {text_sql(False)} AS fact_offence, {text_sql(True)} AS leaky_full FROM f""")
def _(spark, sf):
    return _typed(spark, sf).select(
        "document_id", textset.build_text("fact_only", metadata=False).alias("fact_only"),
        textset.build_text("fact_offence").alias("fact_offence"), textset.build_text("leaky_full").alias("leaky_full"))


@query("P15_text_leakage", f"""WITH f AS ({FIELDS_SQL}) SELECT document_id, false AS safe_profile, true AS full_profile,
    length(decision) >= 12 AS quoted FROM f""")
def _(spark, sf):
    rows = _typed(spark, sf)
    quoted = F.concat(F.lit("see: "), F.col("decision"))
    return rows.select(
        "document_id", textset.leakage(textset.build_text("fact_offence"), "decision", "reason").alias("safe_profile"),
        textset.leakage(textset.build_text("leaky_full"), "decision", "reason").alias("full_profile"),
        textset.leakage(quoted, "decision", F.lit("")).alias("quoted"))


_D = "TRY_CAST({} AS DOUBLE)".format
CHAMPIONSHIP_SQL = f"""lead AS (SELECT season, round, arg_min({_D('driver_points')}, {_D('driver_standing')} * 1000 - {_D('driver_points')}) AS lp
        FROM i WHERE round IS NOT NULL GROUP BY ALL)"""


@query("P16_race_and_championship", f"""WITH i AS ({INCIDENT_SQL}), {CHAMPIONSHIP_SQL}
    SELECT row_id, lp - {_D('driver_points')} AS points_gap_to_leader,
        CASE WHEN opponent IS NOT NULL THEN abs({_D('driver_points')} - {_D('opponent_points')}) END AS points_gap_to_opponent,
        coalesce({_D('driver_standing')} <= 3 AND lp - {_D('driver_points')} < 40, false) AS title_contender,
        {_D('driver_construct_standing')} <= 3 AS construct_title_contender,
        CAST((12 - i.round) * 25 AS DOUBLE) AS points_available_remaining, round(i.round / 12.0, 6) AS round_progress
    FROM i LEFT JOIN lead ON i.season = lead.season AND i.round = lead.round""")
def _(spark, sf):
    rows = features.championship_features(features.race_features(roles.incidents(spark, sf)))
    return rows.select("row_id", "points_gap_to_leader", "points_gap_to_opponent", "title_contender",
                       "construct_title_contender", "points_available_remaining", F.round("round_progress", 6).alias("round_progress"))


_ABSENT = tuple(c for c in INCIDENT_COLUMNS if c not in roles.MULTI)


@query("P17_schema_check", " UNION ALL ".join(f"SELECT '{c}' AS missing_column, count(*) AS rows FROM orders" for c in _ABSENT))
def _(spark, sf):
    rows = roles.multi_incidents(spark, sf)
    missing = F.array(*[F.lit(c) for c in quality.missing_columns(rows)])
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(missing).alias("missing_column"), "rows")


@query("P18_type_coercion", f"""WITH i AS ({INCIDENT_SQL}) SELECT row_id, {_D('lap')} AS x_lap, {_D('full_laps')} AS x_full_laps,
    {_D('opponent_points')} AS x_opponent_points, nullif(opponent, '') AS x_opponent, CAST(coalesce(driver_team = opponent_team, false) AS DOUBLE) AS x_same_team FROM i""")
def _(spark, sf):
    rows = features.relational_features(roles.incidents(spark, sf))
    return encode.coerce_features(rows, ("lap", "full_laps", "opponent_points", "opponent", "same_team"), ["row_id"])


@query("P19_columns_by_parameter", f"""WITH i AS ({INCIDENT_SQL}), k AS (SELECT season, round, circuit AS c, count(*) AS n FROM i
        WHERE round IS NOT NULL GROUP BY ALL), own AS (SELECT a.season, a.round, a.c, sum(b.n) AS n FROM k a JOIN k b
        ON a.c = b.c AND b.season * 100 + b.round < a.season * 100 + a.round GROUP BY ALL)
    SELECT row_id, CASE WHEN i.round IS NOT NULL THEN CAST(coalesce(n, 0) AS DOUBLE) END AS precedent_count
    FROM i LEFT JOIN own ON i.season = own.season AND i.round = own.round AND i.circuit = own.c""")
def _(spark, sf):
    rows = prior.precedent_features(roles.incidents(spark, sf), ("circuit",), "driver_standing", 5)
    return rows.select("row_id", "precedent_count")


_OWN = {"driver_nationality": "nat", "driver_team": "team", "driver_standing": "st", "driver_points": "pts",
        "superlicense_points_before_incident": "lic"}
_OTHER = {"opponent_nationality": "nat", "opponent_team": "team", "opponent_standing": "st", "opponent_points": "pts",
          "opponent_superlicense_points_before": "lic"}


@query("R01_flatten_to_drivers", f"""WITH {FLAT_SQL} SELECT incident_id || '_' || driver AS row_id, driver,
    {", ".join(f"{_pick_sql(a, 'pos')} AS {n}" for n, a in _OWN.items())} FROM flat""")
def _(spark, sf):
    return flatten.flatten_incidents(roles.multi_incidents(spark, sf)).select("row_id", "driver", *_OWN)


@query("R02_opponent_pairing", f"""WITH {FLAT_SQL} SELECT incident_id || '_' || driver AS row_id, CASE WHEN len(ds) = 2 THEN ds[3 - pos] END AS opponent,
    {", ".join(f"CASE WHEN len(ds) = 2 THEN {_pick_sql(a, '3 - pos')} END AS {n}" for n, a in _OTHER.items())} FROM flat""")
def _(spark, sf):
    return flatten.flatten_incidents(roles.multi_incidents(spark, sf)).select("row_id", "opponent", *_OTHER)


@query("R03_misaligned_incidents", f"WITH {FLAT_SQL} SELECT incident_id FROM c WHERE len(ds) > 0 AND incident_id NOT IN (SELECT incident_id FROM ok)")
def _(spark, sf):
    return flatten.misaligned_incidents(roles.multi_incidents(spark, sf))


def _drop_sql(column: str) -> str:
    return f"len(list_filter(list_transform(string_split({column}, ','), lambda v: trim(v)), lambda v: v <> ''))"


@query("R04_alignment_errors", f"""WITH m AS ({MULTI_SQL}), n AS (SELECT incident_id, {_drop_sql('drivers')} AS d, {_drop_sql('nationalities')} AS a,
        {_drop_sql('driver_standings')} AS b, {_drop_sql('driver_points')} AS c, {_drop_sql('superlicense_points_before_incident')} AS e,
        {_drop_sql('respective_teams')} AS t FROM m),
    s AS (SELECT incident_id, len(list_distinct(list_filter([d, a, b, c, e], lambda v: v > 0))) > 1 AS g0,
        len(list_distinct(list_filter([d, t], lambda v: v > 0))) > 1 AS g1 FROM n)
    SELECT incident_id, concat_ws(',', CASE WHEN g0 THEN '0' END, CASE WHEN g1 THEN '1' END) AS groups FROM s WHERE g0 OR g1""")
def _(spark, sf):
    return flatten.alignment_errors(roles.multi_incidents(spark, sf)).select(
        "incident_id", F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups"))


@query("R05_rejoin_cells", f"""WITH m AS ({MULTI_SQL}) SELECT incident_id, array_to_string(list_transform(string_split(drivers, ','), lambda v: trim(v)), ',') AS drivers,
    nationalities FROM m""")
def _(spark, sf):
    blanked = F.transform(split_keep("nationalities"), lambda v: F.when(v != "", v))
    return roles.multi_incidents(spark, sf).select(
        "incident_id", join_keep(split_keep("drivers")).alias("drivers"), join_keep(blanked).alias("nationalities"))


def provenance(spark, sf):
    """Three stages writing lap, flag and sector; later stages win."""
    rows = roles.multi_incidents(spark, sf)
    first = fill.record(rows, "lap", "timestamp", 1, F.col("lap") != "", {"value": F.col("lap"), "round_used": F.col("round")})
    second = fill.record(rows, "lap", "race_feed", 2, number("lap") > 20, {"value": F.col("lap")})
    third = fill.record(rows, "flag", "session_frames", 3, F.col("flag") == "yellow", {"value": F.col("flag"), "message": F.col("sector")})
    return first.unionByName(second).unionByName(third)


PROVENANCE_SQL = f"""m AS ({MULTI_SQL}), rec AS (
    SELECT incident_id, 'lap' AS field, CASE WHEN CAST(lap AS INT) > 20 THEN 'race_feed' ELSE 'timestamp' END AS source, lap AS value,
        CASE WHEN CAST(lap AS INT) <= 20 THEN nullif(round, '') END AS detail FROM m
    UNION ALL SELECT incident_id, 'flag', 'session_frames', flag, nullif(sector, '') FROM m WHERE flag = 'yellow')"""


@query("R06_provenance_last_write", f"WITH {PROVENANCE_SQL} SELECT * FROM rec")
def _(spark, sf):
    latest = fill.latest_provenance(provenance(spark, sf))
    return latest.select("incident_id", "field", "source", F.col("details")["value"].alias("value"),
                         F.coalesce(F.col("details")["round_used"], F.col("details")["message"]).alias("detail"))


def circuits(spark, sf):
    """One circuit per nation outside one region; turns 1 to 20 fall into three sectors."""
    return table(spark, sf, "nation").where("n_regionkey <> 4").selectExpr(
        "n_nationkey AS ordinal", "'ring_' || CAST(n_nationkey AS STRING) AS circuit",
        "'Nation ' || CAST(n_nationkey AS STRING) || ' Grand Prix' AS event_name",
        "'land_' || CAST(n_nationkey AS STRING) AS country", "1950 + n_nationkey AS first_season", "50 + n_nationkey AS total_laps",
        "map_from_entries(transform(sequence(1, 20), t -> struct(CAST(t AS STRING), CAST((t - 1) DIV 7 + 1 AS INT)))) AS corners")


CIRCUIT_SQL = """nat AS (SELECT n_nationkey AS k, 'ring_' || CAST(n_nationkey AS STRING) AS circuit, 'land_' || CAST(n_nationkey AS STRING) AS country,
    CAST(1950 + n_nationkey AS STRING) AS first_season FROM nation WHERE n_regionkey <> 4)"""
_TURN_SQL = "CASE WHEN cents % 5 IN (0, 1) THEN cents % 20 + 1 END"
INCIDENT_ROW_SQL = f"""rows AS (SELECT f.*, coalesce(nat.circuit, 'nation_' || CAST(custkey % 25 AS STRING)) AS circuit, coalesce(country, '') AS country,
        coalesce(first_season, '') AS first_season, CASE WHEN nat.k IS NOT NULL AND {_TURN_SQL} IS NOT NULL
            THEN CAST(CAST(floor(({_TURN_SQL} - 1) / 7) AS INT) + 1 AS STRING) ELSE '' END AS sector,
        regexp_replace(lower(driver_name), '[^a-z0-9]+', '_', 'g') AS slug, {roles.TYPE_SQL} AS incident_type, {roles.FAULT_SQL} AS driver_at_fault,
        {roles.LABEL_SQL} AS penalty, CASE cents % 9 WHEN 4 THEN '2' WHEN 5 THEN '1' ELSE '' END AS points, {roles.OPPONENTS_SQL} AS opp
    FROM ranked f LEFT JOIN nat ON f.custkey % 25 = nat.k WHERE rn = 1)"""
INCIDENT_OUT = ("incident_id", "circuit", "country", "first_season", "season", "session", "incident_type", "sector", "num_drivers", "drivers",
                "respective_teams", "investigation", "driver_at_fault", "penalty", "superlicense_points_added", "mentioned_article", "car_number")
INCIDENT_OUT_SQL = """season || '_' || session || '_' || left(sha1(season || '|' || session || '|' || car_number || '|' ||
        lower(CASE WHEN fact <> '' THEN fact ELSE document_id END)), 10) AS incident_id, circuit, country, first_season, CAST(season AS STRING) AS season, session,
    incident_type, sector, CASE WHEN opp <> '' THEN '2' ELSE '1' END AS num_drivers, slug || CASE WHEN opp <> '' THEN ',car_' || opp ELSE '' END AS drivers,
    lower(replace(competitor, ' ', '_')) AS respective_teams, 'TRUE' AS investigation, driver_at_fault, penalty, points AS superlicense_points_added,
    offence AS mentioned_article, car_number"""


@query("R07_document_to_incident", f"WITH {PRIMARY_SQL}, {CIRCUIT_SQL}, {INCIDENT_ROW_SQL} SELECT {INCIDENT_OUT_SQL} FROM rows")
def _(spark, sf):
    f = F.col("parsed_fields")
    docs = primary_documents(parsed(spark, sf))
    extra = roles.fields(spark, sf).select("document_id", "competitor", "driver_name", "date", F.col("incident_time").alias("time"))
    docs = docs.join(extra, "document_id").withColumn("parsed_fields", F.struct(
        "parsed_fields.*", "competitor", "driver_name", "date", "time", tx.turn_number(f["fact"]).alias("turn_number"),
        tx.opponent_cars(f["fact"], f["car_number"]).alias("opponent_car_numbers"),
        tx.driver_at_fault(f["reason"], f["fact"]).alias("driver_at_fault"), tx.penalty_label(f["decision"]).alias("penalty"),
        tx.penalty_points(f["decision"]).alias("superlicense_points_added"), f["offence"].alias("mentioned_article")))
    docs = docs.withColumn("parse_confidence", F.lit(1.0))
    return incident_rows(docs, circuits(spark, sf)).select(*INCIDENT_OUT)


@query("R08_split_dialects", f"""WITH m AS ({MULTI_SQL}) SELECT incident_id, len({_split_sql('nationalities')}) AS kept, {_drop_sql('nationalities')} AS dropped,
    len({_split_sql('"positions_of_involved parties"')}) AS positions FROM m""")
def _(spark, sf):
    return roles.multi_incidents(spark, sf).select(
        "incident_id", F.size(split_keep("nationalities")).alias("kept"), F.size(split_drop("nationalities")).alias("dropped"),
        F.size(split_keep(F.col("`positions_of_involved parties`"))).alias("positions"))


REVIEW_SQL = f"""m AS ({MULTI_SQL}), t AS ({META_SQL}), rv AS (SELECT m.*, concat_ws('|',
        CASE WHEN coalesce(parse_confidence, 1) < 0.7 THEN 'low_parse_confidence' END,
        CASE WHEN severity = '' THEN CASE WHEN severity_suggestion IS NOT NULL THEN 'severity_suggestion:' || severity_suggestion ELSE 'missing_severity' END END,
        CASE WHEN trim(driver_at_fault) = '' THEN CASE WHEN coalesce(driver_at_fault_suggestion, '') <> '' AND coalesce(driver_at_fault_confidence, 0) > 0
            THEN 'driver_at_fault_suggestion:' || driver_at_fault_suggestion ELSE 'missing_driver_at_fault' END
            WHEN coalesce(nullif(driver_at_fault_confidence, 0), 1) < 0.7 THEN 'low_driver_at_fault_confidence' END,
        CASE WHEN session = 'Race' AND lap = '' THEN 'missing_lap' END, CASE WHEN round = '' THEN 'missing_round' END) AS review_reasons
    FROM m LEFT JOIN t ON m.incident_id = t.incident_id)"""


@query("R09_review_queue", f"WITH {REVIEW_SQL} SELECT incident_id, review_reasons FROM rv WHERE review_reasons <> ''")
def _(spark, sf):
    return quality.review_queue(roles.multi_incidents(spark, sf), meta(spark, sf)).select("incident_id", "review_reasons")
