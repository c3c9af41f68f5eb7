"""A01-A26 aggregates, O01-O06 orders and limits, U01-U05 set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from adjudica.constants import INCIDENT_COLUMNS, QUALITY_GATES
from adjudica.functions import feeds, text as tx
from adjudica.functions.blanks import number
from adjudica.operators import compare, encode, features, fill, learning, lookup, metrics, points, quality, rules, selection, splits, textset
from adjudica.operators.documents import missing_fields
from adjudica.operators.flatten import flatten_incidents, misaligned_incidents
from adjudica.plans.enrich import max_laps
from adjudica.queries import query, roles
from adjudica.queries.joins import TEXT_ROWS_SQL, ALL_PRED_SQL, all_predictions, document_table, predictions, PRED_SQL, provenance as _prov, standings, STANDING_SQL, team_standings
from adjudica.queries.projections import META_SQL, PROVENANCE_SQL, meta
from adjudica.queries.roles import CENTS, FEED_SQL, FIELDS_SQL, INCIDENT_SQL, LAPS, MESSAGES, MULTI_SQL, table
from adjudica.queries.windows import HISTORY_SQL, POINTS_SQL, rule_severity, ruled_sql


def _filled(column: str) -> str:
    return f"(trim(\"{column}\") <> '' AND lower(trim(\"{column}\")) <> 'nan')"


def _text_column(column: str) -> str:
    return f"CAST(\"{column}\" AS STRING)"


@query("A01_fill_rates", f"WITH m AS (SELECT {', '.join(f'{_text_column(c)} AS {chr(34)}{c}{chr(34)}' for c in roles.MULTI)} FROM ({MULTI_SQL})) " + " UNION ALL ".join(
    (f"SELECT '{c}' AS \"column\", round(coalesce(avg(CASE WHEN {_filled(c)} THEN 1.0 ELSE 0 END), 0), 4) AS fill_rate FROM m" if c in roles.MULTI
     else f"SELECT '{c}', 0.0") for c in INCIDENT_COLUMNS))
def _(spark, sf):
    return quality.fill_rates(roles.multi_incidents(spark, sf))


@query("A02_duplicate_keys", "SELECT l_orderkey AS incident_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return quality.duplicates(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "incident_id"))


@query("A03_group_modes", f"""WITH i AS ({INCIDENT_SQL}), c AS (SELECT session, penalty_severity AS v, count(*) AS n FROM i GROUP BY ALL)
    SELECT session, arg_min(v, -n * 10 + v) AS mode FROM c GROUP BY session
    UNION ALL SELECT '<all>', arg_min(v, -n * 10 + v) FROM (SELECT v, sum(n) AS n FROM c GROUP BY v)""")
def _(spark, sf):
    rows = roles.incidents(spark, sf)
    overall = metrics.group_modes(rows, None, "penalty_severity").select(F.lit("<all>").alias("session"), "mode")
    return metrics.group_modes(rows, "session", "penalty_severity").unionByName(overall)


def ruled(spark, sf):
    return compare.add_deviation(rules.predict(roles.incidents(spark, sf)))


RULED_SQL = f"""{HISTORY_SQL}, one AS (SELECT i.*, {ruled_sql("CASE WHEN i.round IS NOT NULL THEN coalesce(h.track5, 0) END")} AS detail
        FROM i LEFT JOIN h ON i.driver = h.driver AND i.season = h.season AND i.round = h.round),
    dev AS (SELECT *, {rule_severity('detail')} AS ruled, {rule_severity('detail')} - penalty_severity AS dir FROM one)"""
_RATES_SQL = """round(avg(CAST(dir = 0 AS INT)), 6) AS agreement_rate, round(1 - avg(CAST(dir = 0 AS INT)), 6) AS disagreement_rate,
    round(avg(dir), 6) AS mean_deviation_direction, round(avg(abs(dir)), 6) AS mean_deviation_magnitude,
    round(avg(CAST(dir < 0 AS INT)), 6) AS actual_harsher_rate, round(avg(CAST(dir > 0 AS INT)), 6) AS rule_harsher_rate,
    round(avg(CAST(detail = 'manual_review' AS INT)), 6) AS manual_review_rate"""


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


BREAKDOWN_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS STRING) AS key, count(*) AS n, {_RATES_SQL} FROM dev GROUP BY {d}"
                                   for d in compare.DIMENSIONS)


@query("A04_deviation_breakdowns", f"WITH {RULED_SQL} {BREAKDOWN_SQL}")
def _(spark, sf):
    return rounded(compare.breakdowns(ruled(spark, sf)))


def kappa_sql(a: str, b: str, where: str = "true") -> str:
    """Cohen's kappa over labels 0-2 as one expression."""
    n = f"nullif(count(*) FILTER ({where}), 0)"
    po = " + ".join(f"count(*) FILTER ({where} AND {a} = {v} AND {b} = {v})" for v in (0, 1, 2))
    pe = " + ".join(f"count(*) FILTER ({where} AND {a} = {v}) * count(*) FILTER ({where} AND {b} = {v})" for v in (0, 1, 2))
    po, pe = f"(({po}) / {n})", f"(({pe}) / ({n} * {n}))"
    return f"round(({po} - {pe}) / nullif(1 - {pe}, 0), 6)"


@query("A05_overall_agreement", f"""WITH {RULED_SQL} SELECT count(*) AS row_count, {_RATES_SQL}, {kappa_sql('penalty_severity', 'ruled')} AS cohens_kappa,
    count(*) FILTER (detail <> 'manual_review') AS matched_row_count,
    round(avg(CAST(dir = 0 AS INT)) FILTER (detail <> 'manual_review'), 6) AS agreement_rate_excl_manual_review,
    {kappa_sql('penalty_severity', 'ruled', "detail <> 'manual_review'")} AS cohens_kappa_excl_manual_review FROM dev""")
def _(spark, sf):
    return rounded(compare.overall(ruled(spark, sf)))


@query("A06_confusion_matrix", f"""WITH {RULED_SQL} SELECT CAST(a AS INT) AS actual, CAST(p AS INT) AS predicted, count(dev.row_id) AS n
    FROM range(3) x(a) CROSS JOIN range(3) y(p) LEFT JOIN dev ON penalty_severity = a AND ruled = p GROUP BY ALL""")
def _(spark, sf):
    return metrics.confusion(ruled(spark, sf), "_actual", "_ruled")


@query("A07_cohens_kappa", f"WITH i AS ({INCIDENT_SQL}) SELECT session, {kappa_sql('penalty_severity', '(CAST(lap AS INT) % 3)')} AS kappa FROM i GROUP BY session")
def _(spark, sf):
    rows = roles.incidents(spark, sf).withColumn("pred", (number("lap") % 3).cast("int"))
    return rows.groupBy("session").agg(F.round(metrics.kappa("penalty_severity", "pred"), 6).alias("kappa"))


def f1_sql(v: int, a: str = "a", p: str = "p") -> str:
    return (f"coalesce(2.0 * count(*) FILTER ({a} = {v} AND {p} = {v}) / nullif(count(*) FILTER ({a} = {v}) + count(*) FILTER ({p} = {v}), 0), 0)")


def summary_sql(a: str = "a", p: str = "p") -> str:
    macro = " + ".join(f1_sql(v, a, p) for v in (0, 1, 2))
    seen = " + ".join(f"CAST(count(*) FILTER ({a} = {v} OR {p} = {v}) > 0 AS INT)" for v in (0, 1, 2))
    weighted = " + ".join(f"{f1_sql(v, a, p)} * count(*) FILTER ({a} = {v})" for v in (0, 1, 2))
    return (f"count(*) AS n, round(avg(CAST({a} = {p} AS INT)), 6) AS accuracy, round(CAST(({macro}) / ({seen}) AS DOUBLE), 6) AS macro_f1, "
            f"round(CAST(({weighted}) / count(*) AS DOUBLE), 6) AS weighted_f1")


@query("A08_classification_metrics", f"""WITH s AS (SELECT penalty_severity AS a, pred AS p,
        CASE penalty_severity WHEN 0 THEN proba_no_penalty WHEN 1 THEN proba_minor ELSE proba_major END AS pr FROM ({ALL_PRED_SQL}))
    SELECT {summary_sql()}, round(avg(-ln(least(greatest(pr, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS log_loss FROM s""")
def _(spark, sf):
    return rounded(metrics.summary(all_predictions(spark, sf), "penalty_severity", "pred", probabilities=learning.PROBABILITIES))


@query("A08_per_class_metrics", f"WITH s AS (SELECT penalty_severity AS a, pred AS p FROM ({ALL_PRED_SQL})) " + " UNION ALL ".join(
    f"""SELECT {v} AS label, round(coalesce(count(*) FILTER (a = {v} AND p = {v}) / nullif(count(*) FILTER (p = {v}), 0), 0), 6) AS precision,
    round(coalesce(count(*) FILTER (a = {v} AND p = {v}) / nullif(count(*) FILTER (a = {v}), 0), 0), 6) AS recall,
    round(CAST({f1_sql(v)} AS DOUBLE), 6) AS f1, count(*) FILTER (a = {v}) AS support FROM s""" for v in (0, 1, 2)))
def _(spark, sf):
    return rounded(metrics.per_class(all_predictions(spark, sf), "penalty_severity", "pred"))


@query("A09_class_weights", f"""WITH i AS ({INCIDENT_SQL}), c AS (SELECT incident_type AS label, count(*) AS n FROM i GROUP BY ALL), t AS (SELECT sum(n) AS n, count(*) AS k FROM c)
    SELECT label, round(t.n / (t.k * c.n), 6) AS present_classes, round(t.n / (3 * c.n), 6) AS fixed_classes FROM c CROSS JOIN t""")
def _(spark, sf):
    rows = roles.incidents(spark, sf).withColumnRenamed("incident_type", "label")
    present = metrics.class_weights(rows, "label").withColumnRenamed("weight", "present_classes")
    fixed = metrics.class_weights(rows, "label", 3).withColumnRenamed("weight", "fixed_classes")
    return rounded(present.join(fixed, "label"))


@query("A10_timestamp_audit", f"""WITH t AS ({META_SQL}) SELECT coalesce(time_parse_method, 'unparsed') AS method, count(*) AS rows,
    round(avg(CAST(session_offset_seconds IS NOT NULL AS INT)), 4) AS offset_rate FROM t GROUP BY 1""")
def _(spark, sf):
    return quality.timestamp_audit(meta(spark, sf))


@query("A11_provenance_summary", f"""WITH {PROVENANCE_SQL} SELECT 'source' AS kind, source AS name, count(*) AS fields_recorded, count(DISTINCT incident_id) AS incidents FROM rec GROUP BY source
    UNION ALL SELECT 'field', field, count(*), count(DISTINCT incident_id) FROM rec GROUP BY field
    UNION ALL SELECT 'total', NULL, count(*), count(DISTINCT incident_id) FROM rec""")
def _(spark, sf):
    return fill.provenance_summary(fill.latest_provenance(_prov(spark, sf)))


AUDIT_SQL = f"""WITH {TEXT_ROWS_SQL}, lab AS (SELECT * FROM c WHERE penalty <> ''), jl AS (SELECT * FROM joined WHERE penalty <> ''),
    per AS (SELECT season, count(*) AS labelled_incident_rows, count(*) FILTER (len(ds) > 0 AND incident_id NOT IN (SELECT incident_id FROM ok)) AS misaligned_skipped FROM lab GROUP BY season),
    cnt AS (SELECT season, count(*) AS flattened_rows, count(*) FILTER (drop_reason IS NULL) AS rows_with_text, count(*) FILTER (drop_reason = 'missing_meta') AS missing_meta,
        count(*) FILTER (drop_reason = 'missing_document_id') AS missing_document_id, count(*) FILTER (drop_reason = 'missing_document') AS missing_document FROM jl GROUP BY season),
    s AS (SELECT per.*, flattened_rows, rows_with_text, missing_meta, missing_document_id, missing_document FROM per JOIN cnt ON per.season = cnt.season)
    SELECT season, CAST(sum(labelled_incident_rows) AS BIGINT) AS labelled_incident_rows, CAST(sum(misaligned_skipped) AS BIGINT) AS misaligned_skipped,
        CAST(sum(flattened_rows) AS BIGINT) AS flattened_rows, CAST(sum(rows_with_text) AS BIGINT) AS rows_with_text, CAST(sum(missing_meta) AS BIGINT) AS missing_meta,
        CAST(sum(missing_document_id) AS BIGINT) AS missing_document_id, CAST(sum(missing_document) AS BIGINT) AS missing_document, CAST(0 AS BIGINT) AS text_build_error,
        round(sum(rows_with_text) / sum(flattened_rows), 4) AS join_rate FROM s GROUP BY ROLLUP (season)"""


@query("A12_join_audit", AUDIT_SQL)
def _(spark, sf):
    labelled = roles.multi_incidents(spark, sf).where("penalty <> ''")
    rows = flatten_incidents(labelled)
    built = textset.text_rows(rows, meta(spark, sf).drop("event"), document_table(spark, sf))
    lost = labelled.join(misaligned_incidents(labelled), "incident_id", "left_semi")
    return textset.audit(labelled, built, lost)


_REC_SQL = PROVENANCE_SQL[PROVENANCE_SQL.index("rec AS"):]
GATE_SQL = f"""WITH {POINTS_SQL}, {_REC_SQL},
    pr AS (SELECT DISTINCT incident_id FROM held WHERE points > 0),
    g AS (SELECT round(avg(CASE WHEN {_filled('lap')} THEN 1.0 ELSE 0 END) FILTER (lower(session) = 'race'), 4) AS g0,
        round(avg(CASE WHEN {_filled('flag')} THEN 1.0 ELSE 0 END) FILTER (lower(session) = 'race'), 4) AS g1,
        round(avg(CASE WHEN {_filled('positions_of_involved parties')} THEN 1.0 ELSE 0 END) FILTER (drivers <> ''), 4) AS g2,
        round(avg(CASE WHEN {_filled('sector')} THEN 1.0 ELSE 0 END), 4) AS g3,
        round(avg(CASE WHEN {_filled('superlicense_points_before_incident')} THEN 1.0 ELSE 0 END) FILTER (incident_id IN (SELECT incident_id FROM pr)), 4) AS g5 FROM m),
    p AS (SELECT round(count(*) FILTER (rec.source = 'timestamp' AND detail IS NOT NULL) / count(*), 4) AS g4 FROM m LEFT JOIN rec
        ON m.incident_id = rec.incident_id AND rec.field = 'lap' WHERE round <> '')"""


@query("A13_quality_gates", f"{GATE_SQL} " + " UNION ALL ".join(
    f"SELECT '{gate}' AS gate, CAST(g{i} AS DOUBLE) AS actual, CAST({target} AS DOUBLE) AS target, g{i} {'>' if strict else '>='} {target} AS passed FROM {'p' if i == 4 else 'g'}"
    for i, (gate, _, target, strict) in enumerate(QUALITY_GATES)))
def _(spark, sf):
    rows = roles.multi_incidents(spark, sf)
    rate = fill.provenance_rate(rows, fill.latest_provenance(_prov(spark, sf)), "lap", "timestamp", "round_used")
    return quality.evaluate_gates(quality.gate_metrics(rows, points.incidents_with_prior_points(rows), rate))


def _by_season(gates: str) -> str:
    """The gate metrics of GATE_SQL, grouped."""
    return (gates.replace("FROM m),", "FROM m GROUP BY season),").replace("g AS (SELECT ", "g AS (SELECT season, ")
            .replace("p AS (SELECT ", "p AS (SELECT season, ").replace("WHERE round <> '')", "WHERE round <> '' GROUP BY season)"))


_SEASON_TARGETS = {"1996": 0.9, "1999": 0.2}


@query("A13_quality_gates_by_season", f"{_by_season(GATE_SQL)}, joined AS (SELECT g.*, g4, (SELECT count(*) FROM pr JOIN m USING (incident_id) WHERE m.season = g.season) AS priors "
       "FROM g LEFT JOIN p ON g.season = p.season), t AS (" + " UNION ALL ".join(
    f"SELECT season, '{gate}' AS gate, CAST(g{i} AS DOUBLE) AS actual, CAST("
    + (f"CASE season WHEN 1996 THEN 0.9 WHEN 1999 THEN 0.2 ELSE {target} END" if gate == "sector" else f"{target}")
    + f" AS DOUBLE) AS target, {strict} AS strict FROM joined" + (" WHERE priors > 0" if i == 5 else "")
    for i, (gate, _, target, strict) in enumerate(QUALITY_GATES))
       + ") SELECT season, gate, actual, target, CASE WHEN strict THEN actual > target ELSE actual >= target END AS passed FROM t")
def _(spark, sf):
    rows = roles.multi_incidents(spark, sf)
    rate = fill.provenance_rate(rows, fill.latest_provenance(_prov(spark, sf)), "lap", "timestamp", "round_used", by=["season"])
    found = quality.gate_metrics(rows, points.incidents_with_prior_points(rows), rate, by=["season"])
    return quality.evaluate_gates(found, F.col("season"), sector_targets=_SEASON_TARGETS)


@query("A14_max_lap", f"WITH e AS ({FEED_SQL}) SELECT session_key, CAST(max(lap_number) AS STRING) AS max_lap FROM e WHERE event_type = '{LAPS}' GROUP BY 1")
def _(spark, sf):
    return max_laps(roles.feed(spark, sf, LAPS), ["session_key"], "lap_number").withColumnRenamed("_max_lap", "max_lap")


@query("A15_any_safety_car", f"""WITH e AS ({FEED_SQL}) SELECT session_key, bool_or(contains(message, 'VIRTUAL SAFETY CAR')) AS vsc,
    bool_or(contains(message, 'SAFETY CAR') AND NOT contains(message, 'VIRTUAL')) AS sc FROM e WHERE event_type = '{MESSAGES}' GROUP BY 1""")
def _(spark, sf):
    state = feeds.safety_car_state("message")
    return roles.feed(spark, sf, MESSAGES).groupBy("session_key").agg(
        F.bool_or(state == "vsc").alias("vsc"), F.bool_or(state == "safety_car").alias("sc"))


@query("A16_last_weather", """SELECT user_id, CASE WHEN arg_max(value, ts) > 20 THEN 'rain' ELSE 'sunny' END AS weather,
    CASE WHEN arg_max(value, ts) > 20 OR arg_max(event_type, ts) = 'view' THEN 'wet' ELSE 'dry' END AS track FROM events GROUP BY user_id""")
def _(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct(
        (F.col("value") > 20).alias("rain"), F.when(F.col("event_type") == "view", "Wet track").otherwise("ok").alias("status")), "ts").alias("w"))
    return last.select("user_id", feeds.weather_condition(F.col("w.rain")).alias("weather"),
                       feeds.track_condition(F.col("w.rain"), "w.status").alias("track"))


@query("A17_leader_points", f"""WITH i AS ({INCIDENT_SQL}) SELECT season, round,
    arg_min(CAST(driver_points AS DOUBLE), CAST(driver_standing AS INT) * 1000 - CAST(driver_points AS INT)) AS leader_points FROM i GROUP BY ALL""")
def _(spark, sf):
    return features.leader_points(roles.incidents(spark, sf))


@query("A18_distinct_constructors", f"WITH {STANDING_SQL} SELECT season, count(DISTINCT t) AS teams FROM tst GROUP BY season")
def _(spark, sf):
    return team_standings(spark, sf).groupBy("season").agg(F.countDistinct("constructor_id").alias("teams"))


@query("A19_group_size", "SELECT l_orderkey, l_linenumber, l_suppkey, count(l_suppkey) OVER (PARTITION BY l_orderkey) AS num_drivers FROM lineitem")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return features.group_size(rows, "l_orderkey", "l_suppkey", "num_drivers")


@query("A20_rule_hits", f"""WITH {RULED_SQL}, ids AS (SELECT CASE WHEN incident_type = 'collision' THEN CASE detail WHEN '5s' THEN 'collision_avoidable_advantage'
        WHEN 'no_action' THEN 'collision_racing_no_fault' ELSE 'collision_unclassified' END
        WHEN incident_type = 'track_limits' THEN CASE detail WHEN 'warning' THEN 'track_limits_first_offence' WHEN '5s' THEN 'track_limits_repeat' ELSE 'default_unmatched' END
        WHEN incident_type = 'unsafe_release' THEN CASE WHEN session IN ('Race', 'Qualifying') THEN 'unsafe_release_pit' ELSE 'unsafe_release_general' END
        WHEN incident_type = 'pit_lane' THEN CASE WHEN contains(lower(fact), 'speeding') THEN 'pit_lane_speeding' ELSE 'pit_lane_general' END
        ELSE 'other_unclassified' END AS id FROM dev) SELECT id AS normative_rule_id, count(*) AS hits FROM ids GROUP BY 1""")
def _(spark, sf):
    return rules.rule_hits(ruled(spark, sf))


_CORR = {"price": "l_extendedprice", "qty": "l_quantity", "disc": "l_discount", "tax": "CASE WHEN l_tax > 0.02 THEN l_tax END", "one": "1.0"}


@query("A21_pairwise_correlation", f"WITH c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CORR.items())} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {'max(CAST(NULL AS DOUBLE))' if 'one' in (a, b) else f'round(corr({a}, {b}), 6)'} AS corr FROM c"
    for i, a in enumerate(_CORR) for b in list(_CORR)[i + 1:]))
def _(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rounded(selection.correlations(rows, {n: F.expr(e).cast("double") for n, e in _CORR.items()}))


@query("A22_mutual_information", """WITH r AS (SELECT l_linestatus AS y, unnest([struct_pack(f := 'flag', x := l_returnflag),
        struct_pack(f := 'line', x := CAST(l_linenumber AS STRING)), struct_pack(f := 'qty', x := CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS STRING))], recursive := true) FROM lineitem),
    j AS (SELECT f, x, y, count(*) AS n FROM r GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY f, x) AS nx, sum(n) OVER (PARTITION BY f, y) AS ny, sum(n) OVER (PARTITION BY f) AS nn FROM j)
    SELECT f AS feature, round(sum(n / nn * ln(CAST(n AS DOUBLE) * nn / (CAST(nx AS DOUBLE) * ny))), 6) AS mi FROM t GROUP BY f""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem")
    binned = selection.equal_depth_bins(rows, {"qty": F.col("l_quantity")}, bins=2)
    discrete = {"flag": F.col("l_returnflag"), "line": F.col("l_linenumber"), **binned}
    return rounded(selection.mutual_information(rows, discrete, "l_linestatus"))


@query("A23_imputation_statistics", f"""WITH i AS ({INCIDENT_SQL}), l AS (SELECT session, count(*) AS n FROM i GROUP BY 1), t AS (SELECT incident_type, count(*) AS n FROM i GROUP BY 1)
    SELECT 'lap' AS "column", CAST(median(CAST(lap AS DOUBLE)) AS STRING) AS value FROM i
    UNION ALL SELECT 'full_laps', CAST(median(TRY_CAST(full_laps AS DOUBLE)) AS STRING) FROM i
    UNION ALL SELECT 'completion_percentage', CAST(median(completion_percentage) AS STRING) FROM i
    UNION ALL SELECT 'session', (SELECT session FROM l ORDER BY n DESC, session LIMIT 1)
    UNION ALL SELECT 'incident_type', (SELECT incident_type FROM t ORDER BY n DESC, incident_type LIMIT 1)""")
def _(spark, sf):
    encoder = encode.fit_encoder(roles.incidents(spark, sf), ["lap", "full_laps", "completion_percentage", "session", "incident_type"])
    return spark.createDataFrame([(c, str(v)) for c, v in encoder.fills.items()], "column string, value string")


@query("A24_top_four", f"""WITH {STANDING_SQL} SELECT season, round, string_agg(CASE WHEN k % 5 = 0 THEN 'alias_' || k ELSE 'nation_' || k END, ',' ORDER BY position)
    AS current_top_4_drivers FROM st WHERE position <= 4 GROUP BY ALL""")
def _(spark, sf):
    return lookup.top_four(standings(spark, sf))


@query("A25_three_way_agreement", f"""WITH {RULED_SQL}, prd AS ({PRED_SQL}), x AS (SELECT dev.penalty_severity AS a, ruled AS r, pred AS m FROM dev JOIN prd ON dev.row_id = prd.row_id)
    SELECT count(*) AS overlap_rows, round(avg(CAST(a = m AS INT)), 6) AS agreement_actual_model, round(avg(CAST(r = m AS INT)), 6) AS agreement_rule_model,
        round(avg(CAST(a = r AS INT)), 6) AS agreement_actual_rule, {kappa_sql('a', 'm')} AS kappa_actual_model, {kappa_sql('r', 'm')} AS kappa_rule_model FROM x""")
def _(spark, sf):
    return rounded(compare.three_way(ruled(spark, sf), predictions(spark, sf)))


@query("A26_parse_confidence", f"""WITH f AS ({FIELDS_SQL}), g AS (SELECT document_id, CASE WHEN fact = '' THEN 'fact' END AS a,
        CASE WHEN ({roles.KIND_SQL}) = 'decision' AND decision = '' THEN 'decision' END AS b, CASE WHEN ({roles.KIND_SQL}) = 'decision' THEN 3 ELSE 2 END AS req FROM f)
    SELECT document_id, concat_ws(',', a, b) AS missing, round(1 - (CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT)) / req, 3) AS confidence FROM g""")
def _(spark, sf):
    rows = roles.fields(spark, sf).withColumn("kind", tx.document_type("title"))
    missing = missing_fields(F.col("session_text"), F.col("fact"), F.col("decision"), F.col("kind"))
    required = F.when(F.col("kind") == "decision", 3).otherwise(2)
    return rows.select("document_id", F.array_join(missing, ",").alias("missing"),
                       F.round(1 - F.size(missing) / required, 3).alias("confidence"))


@query("O01_stable_order", f"WITH i AS ({INCIDENT_SQL}) SELECT season, round, incident_id FROM i ORDER BY season NULLS LAST, round NULLS LAST, incident_id")
def _(spark, sf):
    return roles.incidents(spark, sf).select("season", "round", "incident_id").orderBy(
        F.col("season").asc_nulls_last(), F.col("round").asc_nulls_last(), "incident_id")


@query("O02_top_deviations", f"WITH {RULED_SQL} SELECT row_id, season, round, abs(dir) AS deviation_magnitude FROM dev WHERE dir <> 0 ORDER BY abs(dir) DESC, season, round NULLS LAST, row_id LIMIT 15")
def _(spark, sf):
    return compare.top_deviations(ruled(spark, sf)).select("row_id", "season", "round", "deviation_magnitude")


@query("O03_breakdown_order", f"""WITH {RULED_SQL}, b AS (SELECT incident_type AS key, round(1 - avg(CAST(dir = 0 AS INT)), 6) AS disagreement_rate FROM dev GROUP BY 1)
    SELECT key, disagreement_rate, row_number() OVER (ORDER BY disagreement_rate DESC, key) AS position FROM b""")
def _(spark, sf):
    # One row per incident type; the grouping has been done before rows meet in one window.
    place = Window.orderBy(F.col("disagreement_rate").desc(), "key")
    rows = compare.breakdowns(ruled(spark, sf), ["incident_type"]).withColumn("position", F.row_number().over(place))
    return rows.select("key", F.round("disagreement_rate", 6).alias("disagreement_rate"), "position").orderBy("position")


def importances(spark, sf):
    """A small importance table: one row per part type and brand."""
    part = table(spark, sf, "part")
    return part.groupBy(F.concat_ws("_", F.lit("cat__incident_type"), F.lower("p_type"), "p_brand").alias("feature")).agg(
        F.sum("p_size").cast("double").alias("gain"))


_IMP_SQL = "imp AS (SELECT 'cat__incident_type_' || lower(p_type) || '_' || p_brand AS feature, CAST(sum(p_size) AS DOUBLE) AS gain FROM part GROUP BY 1)"


@query("O04_top_importances", f"WITH {_IMP_SQL} SELECT feature, gain, true AS is_domain, false AS is_engineered FROM imp ORDER BY gain DESC, feature LIMIT 10")
def _(spark, sf):
    return selection.top_features(importances(spark, sf), 10)


@query("O05_least_important", f"""WITH {_IMP_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY gain, feature) AS rn, count(*) OVER () AS n FROM imp)
    SELECT feature, gain FROM r WHERE rn <= greatest(1, CAST(floor(n * 20 / 100) AS INT))""")
def _(spark, sf):
    return selection.drop_least_important(importances(spark, sf))


@query("O06_first_errors", "SELECT l_orderkey AS incident_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 20")
def _(spark, sf):
    return quality.duplicates(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "incident_id")).orderBy("incident_id").limit(20)


@query("U01_union_of_splits", f"WITH i AS ({INCIDENT_SQL}) SELECT row_id, season FROM i WHERE season <= 1998 UNION ALL SELECT row_id, season FROM i WHERE season > 1998")
def _(spark, sf):
    rows = roles.incidents(spark, sf).select("row_id", "season")
    return rows.where("season <= 1998").unionByName(rows.where("season > 1998"))


@query("U02_unassigned_seasons", f"WITH i AS ({INCIDENT_SQL}) SELECT DISTINCT season FROM i WHERE season NOT IN (1995, 1996, 1999)")
def _(spark, sf):
    return splits.unassigned_seasons(roles.incidents(spark, sf), [1995, 1996, 1999])


@query("U03_split_overlap", f"WITH i AS ({INCIDENT_SQL}) SELECT season, count(*) AS rows FROM i WHERE season IN (1998, 2000) GROUP BY 1")
def _(spark, sf):
    shared = splits.overlap({"train_seasons": [1995, 1998, 2000], "validation_season": [1998], "test_season": 2000})
    return roles.incidents(spark, sf).where(F.col("season").isin(*shared)).groupBy("season").agg(F.count(F.lit(1)).alias("rows"))


@query("U04_cars_in_text", f"""WITH f AS ({FIELDS_SQL}) SELECT document_id, array_to_string(list_sort(list_distinct(CASE cents % 5 WHEN 0 THEN [car_number, opponent]
    WHEN 1 THEN [car_number] WHEN 3 THEN [opponent] ELSE [] END)), ',') AS cars FROM f""")
def _(spark, sf):
    return roles.fields(spark, sf).select("document_id", F.array_join(tx.opponent_cars("fact"), ",").alias("cars"))


@query("U05_keyed_upsert", f"""WITH t AS ({META_SQL}), u AS (SELECT {roles.MULTI['incident_id']} AS incident_id, {CENTS} % 100 AS lap_hint,
        CASE WHEN o_custkey % 2 = 0 THEN 'updated' END AS document_id FROM orders WHERE o_totalprice < 200000)
    SELECT coalesce(t.incident_id, u.incident_id) AS incident_id, coalesce(u.document_id, t.document_id) AS document_id, parse_confidence, lap_hint
    FROM t FULL OUTER JOIN u ON t.incident_id = u.incident_id""")
def _(spark, sf):
    updates = table(spark, sf, "orders").where("o_totalprice < 200000").selectExpr(
        f"{roles.MULTI['incident_id']} AS incident_id", f"{CENTS} % 100 AS lap_hint", "CASE WHEN o_custkey % 2 = 0 THEN 'updated' END AS document_id")
    merged = fill.upsert(meta(spark, sf).select("incident_id", "document_id", "parse_confidence"), updates, "incident_id")
    return merged.select("incident_id", "document_id", "parse_confidence", "lap_hint")
