"""Visit table: readers, joins, outcomes, time line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outcomes
from ..functions.clock import micros
from ..operators import history, joins, splits
from ..sources import tables as shapes
from .derived import Derived, with_tables
from .registry import query

LOOKBACKS = (30, 90, 365)


# ---- readers ------------------------------------------------------------------------


@query("read_edstays", with_tables("edstays", body="""
    SELECT subject_id, hadm_id, stay_id, epoch_us(intime) AS in_us, epoch_us(outtime) AS out_us FROM edstays"""))
def read_edstays(d: Derived):
    shaped = d.from_csv("edstays")
    return shaped.select("subject_id", "hadm_id", "stay_id", micros("intime").alias("in_us"), micros("outtime").alias("out_us"))


@query("read_patients", with_tables("patients", body="""
    SELECT subject_id, gender, anchor_age, anchor_year, epoch_us(dod) AS dod_us FROM patients"""))
def read_patients(d: Derived):
    shaped = d.from_csv("patients")
    return shaped.select("subject_id", "gender", "anchor_age", "anchor_year", micros("dod").alias("dod_us"))


@query("read_admissions", with_tables("admissions", body="""
    SELECT subject_id, hadm_id, epoch_us(admittime) AS admit_us, epoch_us(dischtime) AS disch_us,
      NULL::BIGINT AS death_us, ethnicity, edregtime, edouttime, insurance FROM admissions"""))
def read_admissions(d: Derived):
    shaped = d.from_csv("admissions")
    return shaped.select(
        "subject_id", "hadm_id", micros("admittime").alias("admit_us"), micros("dischtime").alias("disch_us"),
        micros("deathtime").alias("death_us"), "ethnicity", "edregtime", "edouttime", "insurance",
    )


@query("read_icustays", with_tables("icustays", body="""
    SELECT subject_id, hadm_id, epoch_us(intime) AS in_us, epoch_us(intime + INTERVAL 20 HOUR) AS out_us FROM icustays"""))
def read_icustays(d: Derived):
    rows = d.from_csv("icustays")
    return rows.select("subject_id", "hadm_id", micros("intime").alias("in_us"), micros("outtime").alias("out_us"))


@query("read_triage", with_tables("triage", body="SELECT * FROM triage"))
def read_triage(d: Derived):
    return d.from_csv("triage")


@query("read_vitalsign", with_tables("vitalsign", body="""
    SELECT subject_id, stay_id, epoch_us(charttime) AS chart_us, ed_temperature, ed_heartrate, ed_resprate, ed_o2sat,
      ed_sbp, ed_dbp, ed_pain, ed_rhythm FROM vitalsign"""))
def read_vitalsign(d: Derived):
    return d.from_csv("vitalsign").withColumn("chart_us", micros("charttime")).drop("charttime")


@query("read_pyxis", with_tables("pyxis", body="SELECT stay_id, name, gsn FROM pyxis"))
def read_pyxis(d: Derived):
    return d.from_csv("pyxis")


@query("read_diagnoses", with_tables("diagnoses", body="SELECT subject_id, hadm_id, icd_code, icd_version FROM diagnoses"))
def read_diagnoses(d: Derived):
    return d.from_csv("diagnoses_icd")


@query("read_labevents", with_tables("labevents", body="""
    SELECT subject_id, hadm_id, itemid, epoch_us(storetime) AS store_us, valuenum FROM labevents"""))
def read_labevents(d: Derived):
    return d.from_csv("labevents").select("subject_id", "hadm_id", "itemid", micros("storetime").alias("store_us"), "valuenum")


@query("rejected_csv_cells", with_tables("visits", body="""
    SELECT c AS "column", CASE WHEN c = 'heartrate' THEN (SELECT count(*) FROM visits WHERE stay_id % 50 = 0)
      WHEN c = 'stay_id' THEN (SELECT count(*) FROM visits WHERE stay_id % 70 = 0) ELSE 0 END AS rejected
    FROM (SELECT unnest(['subject_id', 'stay_id', 'temperature', 'heartrate', 'resprate', 'o2sat', 'sbp', 'dbp', 'pain', 'acuity', 'chiefcomplaint']) AS c)"""))
def rejected_csv_cells(d: Derived):
    """Triage with bad cells: text in a number, a fraction in a whole number; and quotes inside a quoted cell."""
    bad = {
        "heartrate": F.expr("CASE WHEN stay_id % 50 = 0 THEN 'high' ELSE cast(heartrate AS string) END"),
        "chiefcomplaint": F.concat("chiefcomplaint", F.lit(', "as told"')),
        "stay_id": F.expr("CASE WHEN stay_id % 70 = 0 THEN concat(stay_id, '.5') ELSE concat(stay_id, '.0') END"),
    }
    return shapes.rejected_cells(d.from_csv("triage", bad, raw=True), "triage")


# ---- joins --------------------------------------------------------------------------


@query("join_patients", with_tables("edstays", "patients", body="""
    SELECT stay_id, subject_id, gender, anchor_age, anchor_year, epoch_us(dod) AS dod_us
    FROM edstays LEFT JOIN patients USING (subject_id)"""))
def join_patients(d: Derived):
    out = joins.with_patients(d.edstays, d.patients)
    return out.select("stay_id", "subject_id", "gender", "anchor_age", "anchor_year", micros("dod").alias("dod_us"))


@query("join_admissions", with_tables("edstays", "admissions", body="""
    SELECT stay_id, hadm_id, ethnicity, insurance, epoch_us(dischtime) AS disch_us
    FROM edstays LEFT JOIN admissions USING (subject_id, hadm_id)"""))
def join_admissions(d: Derived):
    out = joins.with_admissions(d.edstays, d.admissions)
    return out.select("stay_id", "hadm_id", "ethnicity", "insurance", micros("dischtime").alias("disch_us"))


@query("join_triage", with_tables("edstays", "triage", body="""
    SELECT stay_id, subject_id, triage_sbp, triage_pain, chiefcomplaint FROM edstays LEFT JOIN triage USING (subject_id, stay_id)"""))
def join_triage(d: Derived):
    out = joins.with_triage(d.edstays, d.triage)
    return out.select("stay_id", "subject_id", "triage_sbp", "triage_pain", "chiefcomplaint")


@query("keep_members", with_tables("edstays", "icustays", body="""
    SELECT stay_id, subject_id FROM edstays WHERE subject_id IN (SELECT subject_id FROM icustays)"""))
def keep_members(d: Derived):
    return joins.keep_members(d.edstays, d.icustays, "subject_id").select("stay_id", "subject_id")


@query("drop_members", """
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def drop_members(d: Derived):
    seen = d.table("orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return joins.drop_members(d.table("customer"), seen, "c_custkey").select("c_custkey", "c_mktsegment")


@query("right_join_admissions", with_tables("edstays", "icustays", body="""
    SELECT i.subject_id, i.hadm_id, e.stay_id, epoch_us(i.intime) AS icu_us
    FROM (SELECT * FROM edstays WHERE stay_id % 2 = 0) e RIGHT JOIN icustays i ON e.subject_id = i.subject_id AND e.hadm_id = i.hadm_id"""))
def right_join_admissions(d: Derived):
    even = d.edstays.filter("stay_id % 2 = 0").drop("intime", "outtime")
    out = joins.keep_right(even, d.icustays, ["subject_id", "hadm_id"])
    return out.select("subject_id", "hadm_id", "stay_id", micros("intime").alias("icu_us"))


# ---- outcomes -----------------------------------------------------------------------


@query("age", with_tables("edstays", "patients", body="""
    SELECT stay_id, CAST(year(intime) AS INTEGER) AS in_year, CAST(year(intime) - anchor_year + anchor_age AS INTEGER) AS age
    FROM edstays LEFT JOIN patients USING (subject_id)"""))
def age(d: Derived):
    return outcomes.add_age(joins.with_patients(d.edstays, d.patients)).select("stay_id", "in_year", "age")


@query("adults_with_acuity", with_tables("edstays", "patients", "triage", body="""
    SELECT stay_id, triage_acuity, -triage_acuity AS esi
    FROM edstays LEFT JOIN patients USING (subject_id) LEFT JOIN triage USING (subject_id, stay_id)
    WHERE year(intime) - anchor_year + anchor_age >= 18 AND triage_acuity IS NOT NULL"""))
def adults_with_acuity(d: Derived):
    rows = joins.with_triage(outcomes.add_age(joins.with_patients(d.edstays, d.patients)), d.triage)
    return outcomes.acuity_score(outcomes.with_acuity(outcomes.adults(rows))).select("stay_id", "triage_acuity", "esi")


@query("inhospital_mortality", with_tables("edstays", "patients", "admissions", body="""
    SELECT stay_id, coalesce(dod IS NOT NULL AND dischtime >= dod, FALSE) AS outcome_inhospital_mortality
    FROM edstays LEFT JOIN patients USING (subject_id) LEFT JOIN admissions USING (subject_id, hadm_id)"""))
def inhospital_mortality(d: Derived):
    rows = joins.with_admissions(joins.with_patients(d.edstays, d.patients), d.admissions)
    return outcomes.add_inhospital_mortality(rows).select("stay_id", "outcome_inhospital_mortality")


@query("ed_los", with_tables("edstays", body="""
    SELECT stay_id, epoch_us(outtime) - epoch_us(intime) AS ed_los_us,
      ((epoch_us(outtime) - epoch_us(intime)) // 1000000) % 86400 / 60.0::DOUBLE AS wrapped_minutes,
      (epoch_us(outtime) - epoch_us(intime)) // 1000000 / 60.0::DOUBLE AS minutes FROM edstays"""))
def ed_los(d: Derived):
    rows = outcomes.add_ed_los(d.edstays)
    span = F.unix_micros((F.lit("1970-01-01").cast("timestamp") + F.col("ed_los")).cast("timestamp"))
    return rows.select(
        "stay_id", span.alias("ed_los_us"), outcomes.ed_minutes(True).alias("wrapped_minutes"),
        outcomes.ed_minutes(False).alias("minutes"),
    )


def _critical(d: Derived):
    rows = joins.with_admissions(joins.with_patients(d.edstays, d.patients), d.admissions)
    rows = outcomes.add_inhospital_mortality(rows)
    rows = history.transfer_outcome(rows, d.icustays, 12)
    return outcomes.add_critical(outcomes.add_hospitalization(rows))


_ICU = {
    "first_icu": "SELECT hadm_id, min(subject_id) AS subject_id, min(intime) AS intime_icu FROM icustays GROUP BY hadm_id"
}


@query("icu_transfer", with_tables("edstays", "icustays", extra=_ICU, body="""
    SELECT stay_id, epoch_us(intime_icu) AS icu_us, epoch_us(intime_icu) - epoch_us(outtime) AS delay_us,
      coalesce(intime_icu - outtime <= INTERVAL 12 HOUR, FALSE) AS outcome_icu_transfer_12h
    FROM edstays LEFT JOIN first_icu USING (subject_id, hadm_id)"""))
def icu_transfer(d: Derived):
    rows = history.transfer_outcome(d.edstays, d.icustays, 12)
    return rows.select(
        "stay_id", micros("intime_icu").alias("icu_us"), (micros("intime_icu") - micros("outtime")).alias("delay_us"),
        "outcome_icu_transfer_12h",
    )


@query("critical_outcome", with_tables("edstays", "patients", "admissions", "icustays", extra=_ICU, body="""
    SELECT stay_id, hadm_id IS NOT NULL AS outcome_hospitalization,
      coalesce(dod IS NOT NULL AND dischtime >= dod, FALSE) OR coalesce(intime_icu - outtime <= INTERVAL 12 HOUR, FALSE) AS outcome_critical
    FROM edstays LEFT JOIN patients USING (subject_id) LEFT JOIN admissions USING (subject_id, hadm_id)
      LEFT JOIN first_icu USING (subject_id, hadm_id)"""))
def critical_outcome(d: Derived):
    return _critical(d).select("stay_id", "outcome_hospitalization", "outcome_critical")


@query("cohort_filters", with_tables("edstays", "admissions", body="""
    SELECT 'hospitalized' AS cohort, count(*) AS n, min(stay_id) AS first_stay FROM edstays WHERE hadm_id IS NOT NULL
    UNION ALL SELECT 'discharged', count(*), min(stay_id) FROM edstays WHERE hadm_id IS NULL"""))
def cohort_filters(d: Derived):
    rows = outcomes.add_hospitalization(d.edstays)
    count = lambda df, name: df.agg(
        F.lit(name).alias("cohort"), F.count(F.lit(1)).alias("n"), F.min("stay_id").alias("first_stay")
    )
    return count(outcomes.hospitalized(rows), "hospitalized").unionByName(count(outcomes.discharged(rows), "discharged"))


_NEXT = """lead(intime) OVER (PARTITION BY subject_id ORDER BY intime, stay_id)"""


@query("numeric_spans", with_tables("edstays", "icustays", extra={**_ICU, "s": f"""
      SELECT *, (epoch_us(outtime) - epoch_us(intime)) // 60000000 AS los, (epoch_us(intime_icu) - epoch_us(outtime)) // 60000000 AS icu,
        (epoch_us({_NEXT}) - epoch_us(outtime)) // 60000000 AS gap
      FROM edstays LEFT JOIN first_icu USING (subject_id, hadm_id)"""}, body="""
    SELECT stay_id, round(los / 60.0::DOUBLE, 2) AS ed_los_hours, round(icu / 60.0::DOUBLE, 2) AS time_to_icu_transfer_hours,
      sign(gap) * ((abs(gap) * 200 + 1440) // 2880) / 100.0::DOUBLE AS next_ed_visit_time_diff_days,
      round(los / 60.0::DOUBLE, 2) > 24 AS outcome_ed_los FROM s"""))
def numeric_spans(d: Derived):
    rows = history.transfer_outcome(d.edstays, d.icustays, 12)
    rows = outcomes.add_numeric_spans(history.next_visit_outcome(rows, 3))
    return outcomes.add_long_stay(rows).select(
        "stay_id", "ed_los_hours", "time_to_icu_transfer_hours", "next_ed_visit_time_diff_days", "outcome_ed_los"
    )


# ---- time line ----------------------------------------------------------------------

_PAST = {
    "past_ed": """
      SELECT a.stay_id, """ + ", ".join(
        f"count(*) FILTER (b.intime >= a.intime - INTERVAL {n} DAY) AS n_ed_{n}d" for n in LOOKBACKS
    ) + """
      FROM edstays a LEFT JOIN edstays b ON a.subject_id = b.subject_id
        AND (b.intime < a.intime OR (b.intime = a.intime AND b.stay_id < a.stay_id)) GROUP BY a.stay_id"""
}


def _past_events(name: str, table: str, time: str) -> dict[str, str]:
    return {
        f"past_{name}": f"""
      SELECT a.stay_id, """ + ", ".join(
            f"count(*) FILTER (b.{time} >= a.intime - INTERVAL {n} DAY) AS n_{name}_{n}d" for n in LOOKBACKS
        ) + f"""
      FROM edstays a LEFT JOIN {table} b ON a.subject_id = b.subject_id AND b.{time} < a.intime GROUP BY a.stay_id"""
    }


_PAST_HOSP = _past_events("hosp", "admissions", "admittime")
_PAST_ICU = _past_events("icu", "icustays", "intime")
_PAST_SQL = with_tables("edstays", extra=_PAST, body="SELECT * FROM past_ed")


def _past_ed(d: Derived, strategy: str):
    out = history.past_visit_counts(d.edstays, LOOKBACKS, strategy=strategy)
    return out.select("stay_id", *[f"n_ed_{n}d" for n in LOOKBACKS])


@query("past_ed_visits", _PAST_SQL)
def past_ed_visits(d: Derived):
    return _past_ed(d, "auto")


@query("past_ed_visits_blocks", _PAST_SQL)
def past_ed_visits_blocks(d: Derived):
    return _past_ed(d, "blocks")


@query("past_orders_by_day", """
    SELECT a.o_orderkey, count(b.o_orderkey) AS n_past_365d
    FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate >= a.o_orderdate - INTERVAL 365 DAY
      AND (b.o_orderdate < a.o_orderdate OR (b.o_orderdate = a.o_orderdate AND b.o_orderkey < a.o_orderkey))
    GROUP BY a.o_orderkey""")
def past_orders_by_day(d: Derived):
    out = history.visit_history(
        d.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"),
        subject="o_custkey", key="o_orderkey", start="o_orderdate", end="o_orderdate",
        past_visits={"n_past_365d": 365}, strategy="blocks",
    )
    return out.select("o_orderkey", "n_past_365d")


@query("past_admissions", with_tables("edstays", "admissions", extra=_PAST_HOSP, body="SELECT * FROM past_hosp"))
def past_admissions(d: Derived):
    out = history.past_event_counts(d.edstays, d.admissions, "admittime", LOOKBACKS, "hosp")
    return out.select("stay_id", *[f"n_hosp_{n}d" for n in LOOKBACKS])


@query("past_icu_visits", with_tables("edstays", "icustays", extra=_PAST_ICU, body="SELECT * FROM past_icu"))
def past_icu_visits(d: Derived):
    out = history.past_event_counts(d.edstays, d.icustays, "intime", LOOKBACKS, "icu", strategy="blocks")
    return out.select("stay_id", *[f"n_icu_{n}d" for n in LOOKBACKS])


_NEXT_SQL = with_tables("edstays", body=f"""
    SELECT stay_id, epoch_us(next_in) AS next_us, epoch_us(next_in) - epoch_us(outtime) AS gap_us,
      coalesce(next_in - outtime < INTERVAL 3 DAY, FALSE) AS outcome_ed_revisit_3d
    FROM (SELECT *, {_NEXT} AS next_in FROM edstays)""")


def _next_visit(d: Derived, strategy: str):
    out = history.next_visit_outcome(d.edstays, 3, strategy=strategy)
    return out.select(
        "stay_id", micros("next_ed_visit_time").alias("next_us"),
        (micros("next_ed_visit_time") - micros("outtime")).alias("gap_us"), "outcome_ed_revisit_3d",
    )


@query("next_ed_visit", _NEXT_SQL)
def next_ed_visit(d: Derived):
    return _next_visit(d, "auto")


@query("next_ed_visit_blocks", _NEXT_SQL)
def next_ed_visit_blocks(d: Derived):
    return _next_visit(d, "blocks")


@query("visit_history", with_tables("edstays", "admissions", "icustays", extra={**_PAST, **_PAST_HOSP, **_PAST_ICU}, body=f"""
    SELECT * EXCLUDE (next_in, outtime), coalesce(next_in - outtime < INTERVAL 3 DAY, FALSE) AS outcome_ed_revisit_3d
    FROM (SELECT subject_id, stay_id, outtime, {_NEXT} AS next_in FROM edstays)
      JOIN past_ed USING (stay_id) JOIN past_hosp USING (stay_id) JOIN past_icu USING (stay_id)"""))
def visit_history(d: Derived):
    out = history.visit_history(
        d.edstays,
        past_visits={f"n_ed_{n}d": n for n in LOOKBACKS},
        past_events={"hosp": (d.admissions, "admittime", LOOKBACKS), "icu": (d.icustays, "intime", LOOKBACKS)},
        next_visit=3,
    )
    counts = [f"n_{w}_{n}d" for w in ("ed", "hosp", "icu") for n in LOOKBACKS]
    return out.select("subject_id", "stay_id", *counts, "outcome_ed_revisit_3d")


@query("fill_ethnicity", with_tables("edstays", "admissions", extra={
    "rows": "SELECT * FROM edstays LEFT JOIN admissions USING (subject_id, hadm_id)",
    "best": """SELECT subject_id, ethnicity AS usual FROM (
        SELECT subject_id, ethnicity, count(*) AS n, min(epoch_us(intime)) AS t FROM rows WHERE ethnicity IS NOT NULL GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, t) = 1""",
    }, body="SELECT stay_id, coalesce(ethnicity, usual) AS ethnicity FROM rows LEFT JOIN best USING (subject_id)"))
def fill_ethnicity(d: Derived):
    rows = joins.with_admissions(d.edstays, d.admissions)
    return history.fill_from_subject(rows, "ethnicity").select("stay_id", "ethnicity")


@query("split_train_test", """
    SELECT o_orderkey, CASE WHEN h < 800000 THEN 'train' ELSE 'test' END AS part FROM (
      SELECT o_orderkey, ('0x' || substr(md5('10:' || o_orderkey), 1, 8))::BIGINT % 1000000 AS h FROM orders)""")
def split_train_test(d: Derived):
    return d.table("orders").select("o_orderkey", splits.split_name("o_orderkey", 10, None).alias("part"))


@query("split_train_valid_test", """
    SELECT part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (
      SELECT o_orderkey, CASE WHEN a < 800000 THEN 'train' WHEN b < 500000 THEN 'valid' ELSE 'test' END AS part FROM (
        SELECT o_orderkey, ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT % 1000000 AS a,
          ('0x' || substr(md5('10:' || o_orderkey), 1, 8))::BIGINT % 1000000 AS b FROM orders)) GROUP BY part""")
def split_train_valid_test(d: Derived):
    parts = splits.split_parts(d.table("orders").select("o_orderkey"), "o_orderkey")
    out = None
    for name, part in parts.items():
        row = part.agg(
            F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"),
            F.max("o_orderkey").alias("last_key"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("split_exact_shares", """
    SELECT o_orderkey, CASE WHEN r <= floor(n * 0.8::DOUBLE + 0.5) THEN 'train' WHEN r <= floor(n * (0.8::DOUBLE + 0.1::DOUBLE) + 0.5) THEN 'valid' ELSE 'test' END AS part
    FROM (SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || o_orderkey), 1, 15))::BIGINT) AS r FROM orders)""")
def split_exact_shares(d: Derived):
    return splits.exact_split(d.table("orders").select("o_orderkey"), "o_orderkey", {"train": 0.8, "valid": 0.1, "test": 0.1})
