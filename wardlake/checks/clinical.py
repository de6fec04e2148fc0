"""Parsing, vital-sign rules, scores, statistics, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, scores, vitals
from ..functions.numbers import float_text
from ..functions.parse import COMPLAINTS
from ..operators import joins, splits
from ..operators.prefix import exact_medians
from ..sources.tables import lab_dimension, parse_list_text
from .derived import Derived, with_tables
from .registry import query

TRIAGE_VITALS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "acuity"]


@query("parse_number_text", """
    SELECT raw, CASE
        WHEN regexp_matches(head, '^[0-9]+-[0-9]+$') THEN (split_part(head, '-', 1)::DOUBLE + split_part(head, '-', 2)::DOUBLE) / 2
        WHEN regexp_matches(head, '^[0-9]+$') THEN head::DOUBLE END AS parsed, count(*) AS n
    FROM (SELECT raw, regexp_extract(raw, '^\\s*([a-zA-Z0-9-]*)', 1) AS head FROM (
      SELECT CASE l_linenumber % 5 WHEN 0 THEN l_quantity::INTEGER || '-' || l_linenumber WHEN 1 THEN ' ' || l_quantity::INTEGER || '/10'
        WHEN 2 THEN '-' || l_quantity::INTEGER WHEN 3 THEN l_quantity::INTEGER || '.5' ELSE l_returnflag || l_linenumber END AS raw FROM lineitem))
    GROUP BY ALL""")
def parse_number_text(d: Derived):
    q = "cast(cast(l_quantity as int) as string)"
    raw = d.table("lineitem").selectExpr(
        f"CASE l_linenumber % 5 WHEN 0 THEN concat({q}, '-', l_linenumber) WHEN 1 THEN concat(' ', {q}, '/10') "
        f"WHEN 2 THEN concat('-', {q}) WHEN 3 THEN concat({q}, '.5') ELSE concat(l_returnflag, l_linenumber) END AS raw"
    )
    return raw.select("raw", parse.parse_number_text("raw").alias("parsed")).groupBy("raw", "parsed").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("complaint_flags", with_tables("triage", body="SELECT stay_id, " + ", ".join(
    f"coalesce(regexp_matches(chiefcomplaint, '(?i){p}'), FALSE) AS {n}" for n, p in COMPLAINTS.items()) + " FROM triage"))
def complaint_flags(d: Derived):
    return parse.complaint_flags(d.triage).select("stay_id", *COMPLAINTS)


_DOC_PATTERNS = {"has_the_and": "the|and", "has_mail": "[a-z0-9]+@[a-z]+", "has_license": "license|copyright"}


@query("document_flags", "SELECT doc_id, " + ", ".join(
    f"regexp_matches(text, '(?i){p}') AS {n}" for n, p in _DOC_PATTERNS.items()) + " FROM documents")
def document_flags(d: Derived):
    wanted = _DOC_PATTERNS
    return parse.complaint_flags(d.table("documents"), wanted, "text").select("doc_id", *wanted)


@query("clean_codes", with_tables("diagnoses", body="""
    SELECT icd_code, trim(replace(icd_code, '.', '')) AS clean, count(*) AS n FROM diagnoses GROUP BY ALL"""))
def clean_codes(d: Derived):
    return d.diagnoses.select("icd_code", parse.clean_code("icd_code").alias("clean")).groupBy("icd_code", "clean").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("pharm_class", """
    SELECT p_partkey, p_name AS term, p_type AS class_type FROM part""")
def pharm_class(d: Derived):
    labelled = d.table("part").selectExpr("p_partkey", "concat(p_name, ' [', p_type, ']') AS label")
    term, kind = parse.pharm_class("label")
    return labelled.select("p_partkey", term.alias("term"), kind.alias("class_type"))


@query("temperature_celsius", with_tables("triage", body="""
    SELECT stay_id, round((triage_temperature - 32) * (5.0::DOUBLE / 9), 6) AS celsius,
      round(round((triage_temperature - 32) * (5.0::DOUBLE / 9), 6), 1) AS shown FROM triage"""))
def temperature_celsius(d: Derived):
    rows = vitals.to_celsius(d.triage.select("stay_id", "triage_temperature"))
    rows = rows.withColumn("triage_temperature", F.round("triage_temperature", 6))
    return vitals.round_temperature(rows.withColumn("celsius", F.col("triage_temperature"))).withColumnRenamed(
        "triage_temperature", "shown"
    )


def _clamp_sql(column: str, family: str) -> str:
    r = vitals.VITAL_LIMITS[family]
    return (
        f"CASE WHEN {column} >= {float(r.outlier_low)} AND {column} <= {float(r.outlier_high)} "
        f"THEN greatest(least({column}, {float(r.valid_high)}), {float(r.valid_low)})::DOUBLE END AS {column}"
    )


_TRIAGE_C = """SELECT * REPLACE (round((triage_temperature - 32) * (5.0::DOUBLE / 9), 6) AS triage_temperature) FROM triage"""


def _triage_celsius(d: Derived):
    rows = vitals.to_celsius(d.triage)
    return rows.withColumn("triage_temperature", F.round("triage_temperature", 6))


@query("remove_outliers", with_tables("triage", extra={"c": _TRIAGE_C}, body="SELECT stay_id, " + ", ".join(
    _clamp_sql(f"triage_{v}", v) for v in TRIAGE_VITALS) + " FROM c"))
def remove_outliers(d: Derived):
    return vitals.remove_outliers(_triage_celsius(d)).select("stay_id", *[f"triage_{v}" for v in TRIAGE_VITALS])


def _bucket_sql(v: str) -> str:
    r, x = vitals.VITAL_LIMITS[v], f"triage_{v}"
    return f"""SELECT '{x}' AS variable, count(*) FILTER ({x} < {r.outlier_low}) AS below_outlier_low,
      count(*) FILTER ({x} >= {r.outlier_low} AND {x} < {r.valid_low}) AS outlier_to_valid_low,
      count(*) FILTER ({x} BETWEEN {r.valid_low} AND {r.valid_high}) AS valid,
      count(*) FILTER ({x} > {r.valid_high} AND {x} <= {r.outlier_high}) AS valid_to_outlier_high,
      count(*) FILTER ({x} > {r.outlier_high}) AS above_outlier_high FROM c"""


@query("outlier_counts", with_tables("triage", extra={"c": _TRIAGE_C}, body=" UNION ALL ".join(map(_bucket_sql, TRIAGE_VITALS))))
def outlier_counts(d: Derived):
    return splits.outlier_counts(_triage_celsius(d))


@query("missing_stats", with_tables("triage", body=" UNION ALL ".join(
    f"SELECT 'triage_{v}' AS variable, count(*) - count(triage_{v}) AS n_missing, "
    f"(count(*) - count(triage_{v})) / count(*)::DOUBLE AS share FROM triage" for v in TRIAGE_VITALS)))
def missing_stats(d: Derived):
    return splits.missing_stats(d.triage, [f"triage_{v}" for v in TRIAGE_VITALS])


@query("missing_stats_of_train", with_tables("triage", body=" UNION ALL ".join(
    f"SELECT 'triage_{v}' AS variable, count(*) FILTER (train AND triage_{v} IS NULL) AS n_missing, "
    f"count(*) FILTER (train AND triage_{v} IS NULL) / count(*)::DOUBLE AS share FROM (SELECT *, "
    "('0x' || substr(md5('10:' || stay_id), 1, 8))::BIGINT % 1000000 < 800000 AS train FROM triage)" for v in TRIAGE_VITALS)))
def missing_stats_of_train(d: Derived):
    train = splits.split_parts(d.triage, "stay_id", test_seed=10, valid_seed=None)["train"]
    return splits.missing_stats(train, [f"triage_{v}" for v in TRIAGE_VITALS], total=d.triage.count())


@query("exact_medians", with_tables("triage", body=" UNION ALL ".join(
    f"SELECT 'triage_{v}' AS variable, median(triage_{v}) AS median FROM triage" for v in TRIAGE_VITALS) + """
    UNION ALL SELECT 'l_extendedprice', median(l_extendedprice) FROM lineitem
    UNION ALL SELECT 'event_value', median(nullif(value, 0.01)) FROM events"""))
def medians(d: Derived):
    rows = exact_medians(d.triage, [f"triage_{v}" for v in TRIAGE_VITALS])
    prices = exact_medians(d.table("lineitem"), ["l_extendedprice"])
    values = d.table("events").select(F.nullif("value", F.lit(0.01)).alias("event_value"))
    return rows.unionByName(prices).unionByName(exact_medians(values, ["event_value"]))


@query("impute_medians", with_tables("triage", extra={
    "t": "SELECT *, ('0x' || substr(md5('10:' || stay_id), 1, 8))::BIGINT % 1000000 < 800000 AS train FROM triage"},
    body="SELECT stay_id, " + ", ".join(
        f"coalesce(triage_{v}, (SELECT median(triage_{v}) FROM t WHERE train)) AS triage_{v}" for v in TRIAGE_VITALS) + " FROM t"))
def impute_medians(d: Derived):
    columns = [f"triage_{v}" for v in TRIAGE_VITALS]
    parts = splits.split_parts(d.triage.select("stay_id", *columns), "stay_id", test_seed=10, valid_seed=None)
    fitted = splits.fit_medians(parts["train"], columns)
    return splits.fill_medians(parts["train"], fitted).unionByName(splits.fill_medians(parts["test"], fitted))


# ---- scores -------------------------------------------------------------------------

_AGE_SQL = "(year(intime) - anchor_year + anchor_age)"


def _band_sql(column: str, bands) -> str:
    cases = []
    for low, low_in, high, high_in, points in bands:
        tests = [] if low is None else [f"{column} {'>=' if low_in else '>'} {low}"]
        tests += [] if high is None else [f"{column} {'<=' if high_in else '<'} {high}"]
        cases.append(f"WHEN {' AND '.join(tests)} THEN {points}")
    return f"CASE {' '.join(cases)} ELSE 0 END"


def _score_sql(name: str) -> str:
    terms = [_band_sql(c, b) for c, b in scores.BANDS[name].items()]
    terms += [f"{w} * {c}" for c, w in scores.WEIGHTS.get(name, {}).items()]
    return f"CAST({' + '.join(terms)} AS INTEGER) AS score_{name}"


_FLAG_SQL = ", ".join(f"CAST((s.stay_id // {k + 2}) % 3 = 0 AS INTEGER) AS {c}" for k, c in enumerate(scores.WEIGHTS["CCI"]))
_SCORED_ROWS = {
    "scored_rows": f"""SELECT s.stay_id, {_AGE_SQL} AS age, {_FLAG_SQL}, t.triage_heartrate / 2 AS triage_heartrate, t.triage_resprate,
      t.triage_o2sat, t.triage_sbp, t.triage_dbp, round(t.triage_sbp * 1 / 3 + t.triage_dbp * 2 / 3, 6) AS triage_MAP,
      t.triage_temperature FROM edstays s JOIN patients USING (subject_id)
      JOIN (SELECT * FROM ({_TRIAGE_C})) t USING (stay_id)"""
}


def _scored_rows(d: Derived):
    from ..functions.outcomes import add_age

    rows = joins.with_triage(add_age(joins.with_patients(d.edstays, d.patients)), _triage_celsius(d))
    rows = vitals.add_map(rows).withColumn("triage_MAP", F.round("triage_MAP", 6))
    # Halved rates reach the gaps between whole-number bands.
    rows = rows.withColumn("triage_heartrate", F.col("triage_heartrate") / 2)
    flags = {c: F.expr(f"cast((stay_id div {k + 2}) % 3 = 0 as int)") for k, c in enumerate(scores.WEIGHTS["CCI"])}
    return rows.withColumns(flags)


def _register_score(name: str) -> None:
    sql = with_tables("edstays", "patients", "triage", extra=_SCORED_ROWS, body=f"SELECT stay_id, {_score_sql(name)} FROM scored_rows")

    @query(f"score_{name.lower()}", sql)
    def build(d: Derived):
        return scores.add_scores(_scored_rows(d), [name]).select("stay_id", f"score_{name}")


for _name in scores.BANDS:
    _register_score(_name)


@query("mean_arterial_pressure", with_tables("triage", body="""
    SELECT stay_id, round(triage_sbp * 1 / 3 + triage_dbp * 2 / 3, 6) AS triage_map FROM triage"""))
def mean_arterial_pressure(d: Derived):
    return vitals.add_map(d.triage).select("stay_id", F.round("triage_MAP", 6).alias("triage_map"))


# ---- text numbers, lists, dimensions ------------------------------------------------


@query("float_text", """
    SELECT l_orderkey, l_linenumber, CAST(x AS VARCHAR) AS shown FROM (
      SELECT l_orderkey, l_linenumber, unnest([l_extendedprice, l_discount, l_extendedprice * 4096, l_discount / 4096,
        l_quantity / 1048576 / 1048576, l_extendedprice * 1048576 * 1048576]) AS x FROM lineitem)""")
def float_texts(d: Derived):
    x = F.explode(F.expr(
        "array(l_extendedprice, l_discount, l_extendedprice * 4096, l_discount / 4096, "
        "l_quantity / 1048576 / 1048576, l_extendedprice * 1048576 * 1048576)"
    ))
    return d.table("lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).select(
        "l_orderkey", "l_linenumber", float_text(F.col("x")).alias("shown")
    )


@query("list_text_round_trip", """
    SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS total, min(l_quantity) AS least FROM lineitem GROUP BY l_orderkey""")
def list_text_round_trip(d: Derived):
    written = d.table("lineitem").groupBy("l_orderkey").agg(
        F.to_json(F.sort_array(F.collect_list("l_quantity"))).alias("listed")
    )
    back = written.withColumn("values", parse_list_text("listed"))
    return back.select(
        "l_orderkey",
        F.size("values").cast("long").alias("n"),
        F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 2).alias("total"),
        F.array_min("values").alias("least"),
    )


@query("labs_with_dimension", with_tables("labevents", "lab_items", body="""
    SELECT label, group_idx::INTEGER AS group_idx, count(*) AS n, count(valuenum) AS n_values
    FROM labevents JOIN lab_items USING (itemid) GROUP BY ALL"""))
def labs_with_dimension(d: Derived):
    items = lab_dimension(d.lab_items_raw, _groups())
    return d.labevents.join(items, "itemid").groupBy("label", "group_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count("valuenum").alias("n_values")
    )


def _groups():
    from ..functions.panels import PANEL_GROUPS

    return PANEL_GROUPS


@query("anonymous_columns", """
    SELECT c_acctbal AS feature1, c_mktsegment AS feature2, c_nationkey AS feature3, c_custkey FROM customer""")
def anonymous_columns(d: Derived):
    return splits.anonymous_columns(d.table("customer"), ["c_acctbal", "c_mktsegment", "c_nationkey"], ["c_custkey"])


@query("class_ratio", """
    SELECT count(*) FILTER (quality = 1) AS n_positive, count(*) FILTER (quality = 0) AS n_negative,
      count(*) FILTER (quality = 1) / count(*) FILTER (quality = 0)::DOUBLE AS ratio FROM labels""")
def class_ratio(d: Derived):
    return splits.class_ratio(d.table("labels"), "quality")


@query("label_encoder", """
    SELECT c_custkey, (SELECT count(DISTINCT b.c_mktsegment) FROM customer b WHERE b.c_mktsegment < a.c_mktsegment)::DOUBLE AS segment_idx
    FROM customer a""")
def label_encoder(d: Derived):
    from ..operators.models import label_encoder as encoder

    rows = d.table("customer").select("c_custkey", "c_mktsegment")
    return encoder("c_mktsegment", "segment_idx").fit(rows).transform(rows).select("c_custkey", "segment_idx")


