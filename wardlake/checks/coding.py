"""Diagnosis and drug codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codes
from ..operators.comorbidity_groups import (
    CCI_FLAGS, ECI_FLAGS, FLAGS, custom_dimension, prefix_dimension, prefix_rows,
)
from ..plans.master import build_code_lists
from ..session import local_table
from .derived import MAP_10_TO_9, MAP_9_TO_10, Derived, _values, with_tables
from .registry import query

DAYS = codes.LOOKBACK_DAYS
_DIM = {"dim": f"SELECT * FROM (VALUES {_values(prefix_rows())}) p(scheme, version, grp, prefix)"}
_HITS = {
    **_DIM,
    "hits": """SELECT DISTINCT icd_code, icd_version, scheme, grp FROM (SELECT DISTINCT icd_code, icd_version FROM diagnoses)
      JOIN dim ON version = icd_version AND starts_with(trim(replace(icd_code, '.', '')), prefix)""",
}


@query("charlson_groups", with_tables("diagnoses", extra=_HITS, body="""
    SELECT icd_code, icd_version, grp AS comorbidity FROM hits WHERE scheme = 'charlson'"""))
def charlson_groups(d: Derived):
    hits = codes.match_prefixes(d.diagnoses, prefix_dimension(d.spark))
    return hits.filter("scheme = 'charlson'").select("icd_code", "icd_version", F.col("group").alias("comorbidity"))


@query("elixhauser_groups", with_tables("diagnoses", extra=_HITS, body="""
    SELECT icd_code, icd_version, grp AS comorbidity FROM hits WHERE scheme = 'elixhauser'"""))
def elixhauser_groups(d: Derived):
    hits = codes.match_prefixes(d.diagnoses, prefix_dimension(d.spark))
    return hits.filter("scheme = 'elixhauser'").select("icd_code", "icd_version", F.col("group").alias("comorbidity"))


_CUSTOM = {"sugar": ["E1", "250"], "heart": ["I5", "428", "I21"], "salt": ["E11"]}
_CUSTOM_VALUES = _values([(g, p) for g, ps in _CUSTOM.items() for p in ps])


@query("custom_comorbidities", with_tables("diagnoses", extra={
    "dim": f"SELECT * FROM (VALUES {_CUSTOM_VALUES}) p(grp, prefix)"}, body="""
    SELECT DISTINCT icd_code, grp AS comorbidity FROM diagnoses JOIN dim ON starts_with(trim(replace(icd_code, '.', '')), prefix)
    WHERE icd_version = 10"""))
def custom_comorbidities(d: Derived):
    dimension = custom_dimension(d.spark, _CUSTOM, 10)
    return codes.match_prefixes(d.diagnoses, dimension).select("icd_code", F.col("group").alias("comorbidity"))


@query("comorbidity_table", with_tables("diagnoses", extra=_HITS, body="""
    SELECT c.icd_code, c.icd_version, 'code ' || c.icd_code AS description,
      coalesce(string_agg(grp, ';' ORDER BY grp), '') AS comorbidities
    FROM (SELECT DISTINCT icd_code, icd_version FROM diagnoses) c
      LEFT JOIN hits h ON h.icd_code = c.icd_code AND h.icd_version = c.icd_version AND scheme = 'elixhauser'
    GROUP BY ALL"""))
def comorbidity_table(d: Derived):
    known = d.diagnoses.select("icd_code", "icd_version").distinct().withColumn(
        "description", F.concat(F.lit("code "), "icd_code")
    )
    table = codes.code_groups(d.diagnoses, prefix_dimension(d.spark), "elixhauser", known)
    return table.select(
        "icd_code", "icd_version", "description", F.array_join("elixhauser_comorbidity", ";").alias("comorbidities")
    )


@query("rejected_codes", with_tables("diagnoses", body="""
    SELECT DISTINCT icd_code, v AS icd_version, CASE WHEN v = 11 THEN 'version' ELSE 'unknown' END AS reason FROM (
      SELECT icd_code, CASE WHEN icd_code = 'Z00.0' THEN 11 ELSE icd_version END AS v FROM diagnoses)
    WHERE v = 11 OR icd_code LIKE 'K%'"""))
def rejected_codes(d: Derived):
    asked = d.diagnoses.withColumn("icd_version", F.expr("CASE WHEN icd_code = 'Z00.0' THEN 11 ELSE icd_version END"))
    known = d.diagnoses.filter("icd_code NOT LIKE 'K%'").select("icd_code", "icd_version").distinct()
    return codes.rejected_codes(asked, known)


@query("convert_9_to_10", with_tables("diagnoses", "map9to10", body="""
    SELECT icd_code, icd_version, CASE WHEN icd_version = 9 THEN coalesce(target_code, icd_code) ELSE icd_code END AS converted, count(*) AS n
    FROM diagnoses LEFT JOIN map9to10 ON source_code = icd_code GROUP BY ALL"""))
def convert_9_to_10(d: Derived):
    out = codes.convert_codes(d.diagnoses, codes.unique_code_map(d.code_map(MAP_9_TO_10)), 10)
    return out.groupBy("icd_code", "icd_version", "converted").agg(F.count(F.lit(1)).alias("n"))


@query("convert_10_to_9", with_tables("diagnoses", "map10to9", body="""
    SELECT icd_code, icd_version, CASE WHEN icd_version = 10 THEN coalesce(target_code, icd_code) ELSE icd_code END AS full_code,
      CASE WHEN icd_version = 10 THEN substr(coalesce(target_code, icd_code), 1, 3) ELSE icd_code END AS short_code, count(*) AS n
    FROM diagnoses LEFT JOIN map10to9 ON source_code = icd_code GROUP BY ALL"""))
def convert_10_to_9(d: Derived):
    code_map = codes.unique_code_map(d.code_map(MAP_10_TO_9))
    out = codes.convert_codes(d.diagnoses, code_map, 9, out="full_code")
    out = codes.convert_codes(out, code_map, 9, digit3=True, out="short_code")
    return out.groupBy("icd_code", "icd_version", "full_code", "short_code").agg(F.count(F.lit(1)).alias("n"))


_RECENT = f"""SELECT DISTINCT s.stay_id, x.icd_code, x.icd_version FROM edstays s JOIN dated x
      ON s.subject_id = x.subject_id AND x.dischtime < s.intime AND s.intime - x.dischtime <= INTERVAL {DAYS} DAY"""


@query("lookback_codes", with_tables("edstays", "dated", extra={"recent": _RECENT}, body="""
    SELECT DISTINCT stay_id, icd_code FROM recent"""))
def lookback_codes(d: Derived):
    dated = codes.dated_diagnoses(d.diagnoses, d.admissions)
    return codes.lookback_codes(d.edstays, dated, "icd_code", "dischtime", DAYS).drop("subject_id")


@query("lookback_codes_90_days", with_tables("edstays", "dated", extra={"recent": _RECENT.replace(f"{DAYS} DAY", "90 DAY")}, body="""
    SELECT DISTINCT stay_id, icd_code FROM recent"""))
def lookback_codes_90_days(d: Derived):
    dated = codes.dated_diagnoses(d.diagnoses, d.admissions)
    return codes.lookback_codes(d.edstays, dated, "icd_code", "dischtime", 90).drop("subject_id")


def _flag_sql(scheme: str) -> str:
    return ", ".join(
        f"coalesce(max((grp = '{g}' AND scheme = '{scheme}')::INTEGER), 0)::INTEGER AS {flag}" for g, flag in FLAGS[scheme].items()
    )


@query("comorbidity_flags", with_tables("edstays", "dated", extra={**_HITS, "recent": _RECENT}, body=f"""
    SELECT e.stay_id, {_flag_sql('charlson')}, {_flag_sql('elixhauser')} FROM edstays e
      LEFT JOIN recent USING (stay_id) LEFT JOIN hits USING (icd_code, icd_version) GROUP BY e.stay_id"""))
def comorbidity_flags(d: Derived):
    out = codes.comorbidity_flags(d.edstays, d.diagnoses, d.admissions, prefix_dimension(d.spark))
    return out.select("stay_id", *CCI_FLAGS, *ECI_FLAGS)


_VARIANT_SQL = {
    "v9": "CASE WHEN icd_version = 10 THEN coalesce(target_code, icd_code) ELSE icd_code END",
    "v9_3digit": "CASE WHEN icd_version = 10 THEN substr(coalesce(target_code, icd_code), 1, 3) ELSE icd_code END",
    "v10": "CASE WHEN icd_version = 9 THEN coalesce(target_code, icd_code) ELSE icd_code END",
}


def _register_list(variant: str) -> None:
    table = "map9to10" if variant == "v10" else "map10to9"
    extra = {
        "recent": _RECENT,
        "pairs": f"SELECT DISTINCT stay_id, {_VARIANT_SQL[variant]} AS code FROM recent LEFT JOIN {table} ON source_code = icd_code",
        "idx": "SELECT code, row_number() OVER (ORDER BY code) - 1 AS code_idx FROM (SELECT DISTINCT code FROM pairs)",
    }
    sql = with_tables("edstays", "dated", table, extra=extra, body="""
      SELECT e.stay_id, coalesce(string_agg(code, '|' ORDER BY code), '') AS icd_list,
        coalesce(string_agg(code_idx::VARCHAR, '|' ORDER BY code), '') AS icd_encoded_list
      FROM edstays e LEFT JOIN (pairs JOIN idx USING (code)) USING (stay_id) GROUP BY e.stay_id""")

    @query(f"code_list_{variant}", sql)
    def build(d: Derived):
        maps = {"9to10": d.code_map(MAP_9_TO_10), "10to9": d.code_map(MAP_10_TO_9)}
        rows, _ = build_code_lists(d.tables, maps)[variant]
        return rows.select(
            "stay_id", F.array_join("icd_list", "|").alias("icd_list"),
            F.array_join(F.col("icd_encoded_list").cast("array<string>"), "|").alias("icd_encoded_list"),
        )


for _variant in _VARIANT_SQL:
    _register_list(_variant)


@query("code_lists_on_stays", with_tables("edstays", "dated", "map10to9", extra={
    "recent": _RECENT, "pairs": f"SELECT DISTINCT stay_id, {_VARIANT_SQL['v9_3digit']} AS code FROM recent LEFT JOIN map10to9 ON source_code = icd_code"}, body="""
    SELECT e.stay_id, e.hadm_id, coalesce(string_agg(code, '|' ORDER BY code), '') AS codes FROM edstays e LEFT JOIN pairs USING (stay_id) GROUP BY ALL"""))
def code_lists_on_stays(d: Derived):
    dated = codes.dated_diagnoses(d.diagnoses, d.admissions)
    lists, _ = codes.code_lists(d.edstays, dated, codes.unique_code_map(d.code_map(MAP_10_TO_9)), "v9_3digit")
    out = codes.merge_code_lists(d.edstays, lists, {"icd_list": "codes"})
    return out.select("stay_id", "hadm_id", F.array_join("codes", "|").alias("codes"))


@query("code_index", """
    SELECT p_name AS code, row_number() OVER (ORDER BY p_name) - 1 AS code_idx FROM (SELECT DISTINCT p_name FROM part)""")
def code_index(d: Derived):
    return codes.code_index(d.table("part"), "p_name")


_ATC = [(1, "R", "level one r"), (1, "S", "level one s"), (2, "RED", "red"), (2, "SMA", "small"), (3, "RED ", "red blank"),
        (4, "SMALL", "small five"), (5, "RED NUT", "a red nut"), (5, "HOT NUT", "a hot nut")]


@query("atc_levels", f"""
    SELECT p_name AS atc_id, level, code, description FROM (
      SELECT DISTINCT p_name, level, CASE level WHEN 1 THEN substr(u, 1, 1) WHEN 2 THEN substr(u, 1, 3) WHEN 3 THEN substr(u, 1, 4)
        WHEN 4 THEN substr(u, 1, 5) ELSE CASE WHEN length(u) = 7 THEN u END END AS code
      FROM (SELECT p_name, upper(p_name) AS u FROM part), (VALUES (1), (2), (3), (4), (5)) l(level))
    LEFT JOIN (VALUES {_values(_ATC)}) a(level, code, description) USING (level, code)""")
def atc_levels(d: Derived):
    atc = local_table(d.spark, _ATC, "level int, code string, description string")
    return codes.atc_classes(d.table("part").withColumnRenamed("p_name", "atc_id"), atc)
