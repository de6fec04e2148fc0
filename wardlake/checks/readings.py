"""Event tables per stay: vitals, medication, labs, hourly series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.clock import DAY_US, micros
from ..functions.panels import LAB_LABELS
from ..operators import events, joins
from ..plans import training
from ..session import checkpoint_dir
from ..sources.sinks import write_lab_results, write_table
from ..sources.tables import load, parse_list_text, read_table
from .derived import Derived, with_tables
from .registry import query

V = events.VITAL_COLUMNS


def _summary_sql(option: str, c: str) -> str:
    keyed = f"struct_pack(t := epoch_us(charttime), v := {c})"
    return {
        "max": f"max({c})", "min": f"min({c})", "median": f"median({c})", "mean": f"round(avg({c}), 6)",
        "first": f"arg_min({c}, {keyed}) FILTER ({c} IS NOT NULL)", "last": f"arg_max({c}, {keyed}) FILTER ({c} IS NOT NULL)",
    }[option] + f" AS {c}_{option}"


OPTIONS = ["max", "min", "median", "mean", "first", "last"]


@query("vital_summaries", with_tables("vitalsign", body="SELECT subject_id, stay_id, " + ", ".join(
    _summary_sql(o, c) for o in OPTIONS for c in V) + " FROM vitalsign GROUP BY ALL"))
def vital_summaries(d: Derived):
    out = events.vital_summaries(d.vitalsign, OPTIONS)
    return out.withColumns({f"{c}_mean": F.round(f"{c}_mean", 6) for c in V})


@query("vitals_on_stays", with_tables("edstays", "vitalsign", extra={
    "v": "SELECT subject_id, stay_id, " + ", ".join(_summary_sql("last", c) for c in V) + " FROM vitalsign GROUP BY ALL"},
    body="SELECT stay_id, " + ", ".join(f"{c}_last" for c in V) + " FROM edstays LEFT JOIN v USING (subject_id, stay_id)"))
def vitals_on_stays(d: Derived):
    out = events.merge_vital_summaries(d.edstays, d.vitalsign, ["last"])
    return out.select("stay_id", *[f"{c}_last" for c in V])


@query("event_summaries", """
    SELECT user_id, event_type, max(v) AS v_max, min(v) AS v_min, median(v) AS v_median,
      arg_min(v, struct_pack(t := epoch_us(ts), v := v)) FILTER (v IS NOT NULL) AS v_first,
      arg_max(v, struct_pack(t := epoch_us(ts), v := v)) FILTER (v IS NOT NULL) AS v_last
    FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events) GROUP BY ALL""")
def event_summaries(d: Derived):
    rows = d.table("events").withColumn("v", F.expr("CASE WHEN event_id % 3 <> 0 THEN value END"))
    return events.vital_summaries(
        rows, ["max", "min", "median", "first", "last"], ["user_id", "event_type"], "ts", ["v"]
    )


@query("medication_counts", with_tables("edstays", "pyxis", extra={
    "m": "SELECT stay_id, count(DISTINCT coalesce(gsn, name)) AS n_med, count(DISTINCT gsn) AS n_medrecon FROM pyxis GROUP BY 1"}, body="""
    SELECT stay_id, coalesce(n_med, 0) AS n_med, coalesce(n_medrecon, 0) AS n_medrecon FROM edstays LEFT JOIN m USING (stay_id)"""))
def medication_counts(d: Derived):
    out = events.merge_medication_count(d.edstays, d.pyxis, "n_med")
    out = events.merge_medication_count(out, d.pyxis, "n_medrecon", fill_from=None)
    return out.select("stay_id", "n_med", "n_medrecon")


_LABS = {
    "inside": """SELECT e.subject_id, e.hadm_id, e.stay_id, itemid, valuenum FROM edstays e
      JOIN labevents l ON l.subject_id = e.subject_id AND l.hadm_id = e.hadm_id
        AND l.storetime BETWEEN e.intime AND e.outtime
      WHERE valuenum IS NOT NULL AND itemid IN (SELECT itemid FROM lab_items)""",
    "single": """SELECT * FROM inside WHERE stay_id IN (
      SELECT stay_id FROM inside GROUP BY stay_id HAVING count(*) = count(DISTINCT itemid))""",
}


@query("labs_in_stay", with_tables("edstays", "labevents", "lab_items", extra=_LABS, body="SELECT * FROM inside"))
def labs_in_stay(d: Derived):
    return events.stay_labs(d.edstays, d.labevents, d.lab_items)


@query("labs_from_files", with_tables("edstays", "labevents", "lab_items", extra=_LABS, body="SELECT * FROM inside"))
def labs_from_files(d: Derived):
    """The lab table as a parquet file, whose scan takes the items and the range of admissions as filters."""
    root = f"{checkpoint_dir(d.spark).rstrip('/')}/labs-{uuid.uuid4().hex}"
    write_table(d.labevents, f"{root}/hosp/labevents.parquet")
    return events.stay_labs(d.edstays, load(d.spark, root, "labevents", "parquet"), d.lab_items)


@query("lab_result_files", with_tables("edstays", "labevents", "lab_items", extra=_LABS, body="""
    SELECT stay_id, string_agg(itemid::VARCHAR, ',' ORDER BY itemid) AS lab_measure, round(list_sum(list(valuenum ORDER BY itemid)), 4) AS value_sum
    FROM single GROUP BY stay_id"""))
def lab_result_files(d: Derived):
    """Lab lists written as CSV, the lists as text, and read back."""
    out = f"{checkpoint_dir(d.spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    single = events.single_measures(events.stay_labs(d.edstays, d.labevents, d.lab_items))
    write_lab_results(events.lab_lists(single), out, "csv")
    back = read_table(d.spark, f"{out}/lab_results", fmt="csv")
    items, values = parse_list_text("lab_measure", "bigint"), parse_list_text("lab_results")
    return back.select(
        F.col("stay_id").cast("long"),
        F.array_join(items.cast("array<string>"), ",").alias("lab_measure"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 4).alias("value_sum"),
    )


@query("lines_in_order_window", """
    SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY""")
def lines_in_order_window(d: Derived):
    spans = d.table("orders").selectExpr("o_orderkey", "o_orderdate", "timestampadd(DAY, 30, o_orderdate) AS until")
    lines = d.table("lineitem").withColumnRenamed("l_orderkey", "o_orderkey").select(
        "o_orderkey", "l_linenumber", "l_partkey", "l_shipdate"
    )
    out = joins.events_within(spans, lines, ["o_orderkey"], "o_orderdate", "until", "l_shipdate", 7 * DAY_US)
    return out.select("o_orderkey", "l_linenumber", "l_partkey")


@query("lab_lists", with_tables("edstays", "labevents", "lab_items", extra=_LABS, body="""
    SELECT stay_id, string_agg(itemid::VARCHAR, ',' ORDER BY itemid) AS lab_measure, count(*) AS n, sum(itemid)::BIGINT AS item_sum,
      round(list_sum(list(valuenum ORDER BY itemid)), 4) AS value_sum
    FROM single GROUP BY stay_id"""))
def lab_lists(d: Derived):
    single = events.single_measures(events.stay_labs(d.edstays, d.labevents, d.lab_items))
    lists = events.lab_lists(single)
    return lists.select(
        "stay_id",
        F.array_join(F.col("lab_measure").cast("array<string>"), ",").alias("lab_measure"),
        F.size("lab_measure").cast("long").alias("n"),
        F.aggregate("lab_measure", F.lit(0).cast("long"), lambda a, x: a + x).alias("item_sum"),
        F.round(F.aggregate("lab_results", F.lit(0.0), lambda a, x: a + x), 4).alias("value_sum"),
    )


_PIVOT_SQL = ", ".join(f"coalesce(max(valuenum) FILTER (label = '{l}'), 0) AS \"{l}\"" for l in LAB_LABELS)


@query("lab_pivot", with_tables("edstays", "labevents", "lab_items", extra=_LABS, body=f"""
    SELECT stay_id, {_PIVOT_SQL} FROM single JOIN lab_items USING (itemid) GROUP BY stay_id"""))
def lab_pivot(d: Derived):
    single = events.single_measures(events.stay_labs(d.edstays, d.labevents, d.lab_items))
    return events.lab_pivot(single, d.lab_items, LAB_LABELS).drop("subject_id", "hadm_id", "lab_group_idx")


@query("lab_group_order", with_tables("edstays", "labevents", "lab_items", extra=_LABS, body="""
    SELECT stay_id, string_agg(group_idx::VARCHAR, ',' ORDER BY r) AS lab_group_idx FROM (
      SELECT stay_id, group_idx, min(item_rank) AS r FROM single JOIN lab_items USING (itemid) GROUP BY ALL) GROUP BY stay_id"""))
def lab_group_order(d: Derived):
    single = events.single_measures(events.stay_labs(d.edstays, d.labevents, d.lab_items))
    out = events.lab_pivot(single, d.lab_items, LAB_LABELS)
    return out.select("stay_id", F.array_join(F.col("lab_group_idx").cast("array<string>"), ",").alias("lab_group_idx"))


# The shift before rounding keeps exact ties (interpolated cents) away from the rounding edge.
# The fixed grid is a day, the step 30 days; a customer's orders of one day are merged first.
_SERIES = {
    "days": "SELECT o_custkey, o_orderdate, max(o_totalprice) AS price, min(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END) AS low FROM orders GROUP BY ALL",
    "span": "SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM days GROUP BY 1",
    "steps": """SELECT o_custkey, a, unnest(range(0, date_diff('day', a, z) // 30 + 1)) AS step FROM span""",
    "points": "SELECT o_custkey, step, a + to_days((step * 30)::INTEGER) AS moment FROM steps",
}


def _series_sql(c: str) -> str:
    return f"""SELECT p.o_custkey, p.step, p.moment,
        (SELECT arg_max({c}, o_orderdate) FROM days d WHERE d.o_custkey = p.o_custkey AND {c} IS NOT NULL AND o_orderdate <= p.moment) AS y0,
        (SELECT max(o_orderdate) FROM days d WHERE d.o_custkey = p.o_custkey AND {c} IS NOT NULL AND o_orderdate <= p.moment) AS t0,
        (SELECT arg_min({c}, o_orderdate) FROM days d WHERE d.o_custkey = p.o_custkey AND {c} IS NOT NULL AND o_orderdate >= p.moment) AS y1,
        (SELECT min(o_orderdate) FROM days d WHERE d.o_custkey = p.o_custkey AND {c} IS NOT NULL AND o_orderdate >= p.moment) AS t1
      FROM points p"""


def _value_sql(c: str) -> str:
    return f"""SELECT o_custkey, step, moment, CASE WHEN t1 = moment THEN y1 WHEN t0 IS NULL THEN NULL WHEN t1 IS NULL THEN y0
        ELSE y0 + (y1 - y0) * date_diff('day', t0, moment) / date_diff('day', t0, t1) END AS {c} FROM s_{c}"""


@query("resampled_series", with_tables(extra={
    **_SERIES, "s_price": _series_sql("price"), "s_low": _series_sql("low"),
    "v_price": _value_sql("price"), "v_low": _value_sql("low")}, body="""
    SELECT o_custkey, step, epoch_us(moment) AS at_us, round(price + 1e-7, 3) AS price,
      round(coalesce(low, first_value(low IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + 1e-7, 3) AS low
    FROM v_price JOIN v_low USING (o_custkey, step, moment)"""))
def resampled_series(d: Derived):
    days = d.table("orders").groupBy("o_custkey", "o_orderdate").agg(
        F.max("o_totalprice").alias("price"),
        F.min(F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END")).alias("low"),
    )
    out = events.hourly_series(days, ["price", "low"], "o_custkey", "o_orderdate", 30 * DAY_US, DAY_US)
    return out.select(
        "o_custkey", "step", micros("o_orderdate").alias("at_us"), F.round(F.col("price") + 1e-7, 3).alias("price"),
        F.round(F.col("low") + 1e-7, 3).alias("low"),
    )


# Every hour of a stay, and around it the nearest readings that lie on whole minutes from the first.
_HOURLY = {
    "span": "SELECT stay_id, min(charttime) AS a, max(charttime) AS z FROM vitalsign GROUP BY 1",
    "placed": "SELECT v.*, epoch_us(charttime) - epoch_us(a) AS x FROM vitalsign v JOIN span USING (stay_id)",
    "hours": """SELECT stay_id, epoch_us(a) AS a, step, step * 3600000000 AS x FROM (
        SELECT stay_id, a, unnest(range(0, (epoch_us(z) - epoch_us(a)) // 3600000000 + 1)) AS step FROM span)""",
    **{
        f"near_{c}": f"""SELECT h.stay_id, h.step, h.a, h.x,
            max({{'x': p.x, 'y': {c}::DOUBLE}}) FILTER (p.x < h.x) AS past, min({{'x': p.x, 'y': {c}::DOUBLE}}) FILTER (p.x >= h.x) AS next
          FROM hours h LEFT JOIN placed p ON p.stay_id = h.stay_id AND {c} IS NOT NULL AND p.x % 60000000 = 0 GROUP BY ALL"""
        for c in V
    },
    **{
        f"at_{c}": f"""SELECT stay_id, step, a, x, CASE WHEN next.x = x THEN next.y WHEN past IS NULL THEN NULL WHEN next IS NULL THEN past.y
            ELSE past.y + (next.y - past.y) / (next.x - past.x)::DOUBLE * (x - past.x)::DOUBLE END AS {c} FROM near_{c}"""
        for c in V
    },
}


@query("hourly_vitals", with_tables("vitalsign", extra=_HOURLY, body="SELECT stay_id, step, a + x AS at_us, " + ", ".join(
    f"""round(coalesce({c}, first_value({c} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY step
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + 1e-7, 3) AS {c}""" for c in V)
    + f" FROM at_{V[0]} " + " ".join(f"JOIN at_{c} USING (stay_id, step, a, x)" for c in V[1:])))
def hourly_vitals(d: Derived):
    numeric = d.vitalsign.select("stay_id", "charttime", *V)
    out = events.hourly_series(numeric, V)
    return out.select("stay_id", "step", micros("charttime").alias("at_us"), *[F.round(F.col(c) + 1e-7, 3).alias(c) for c in V])


def small_master(d: Derived):
    """The parts of the master table that the lab path needs, without the history columns."""
    from ..functions import outcomes
    from ..functions.clock import HOUR_US, micros_between, rounded_span

    rows = outcomes.add_age(joins.with_patients(d.edstays, d.patients))
    rows = outcomes.add_hospitalization(joins.with_triage(rows, d.triage))
    return rows.withColumn("ed_los_hours", rounded_span(micros_between("intime", "outtime"), HOUR_US))


_LAB_MASTER = {
    **_LABS,
    "labbed": "SELECT DISTINCT stay_id FROM single",
    "m": """SELECT e.stay_id, year(intime) - anchor_year + anchor_age AS age, t.* EXCLUDE (subject_id, stay_id),
        round((epoch_us(outtime) - epoch_us(intime)) / 3600000000.0::DOUBLE, 2) AS ed_los_hours
      FROM edstays e JOIN labbed USING (stay_id) LEFT JOIN patients USING (subject_id) LEFT JOIN triage t USING (subject_id, stay_id)""",
    "kept": "SELECT * FROM m WHERE age >= 18 AND triage_acuity IS NOT NULL",
    "clean": """SELECT stay_id, ed_los_hours, CASE WHEN triage_sbp BETWEEN 0 AND 375 THEN triage_sbp END AS triage_sbp,
      CASE WHEN triage_heartrate BETWEEN 0 AND 390 THEN least(triage_heartrate, 350) END AS triage_heartrate,
      CASE WHEN triage_pain BETWEEN 0 AND 10 THEN triage_pain END AS triage_pain, triage_acuity FROM kept""",
}


@query("lab_master", with_tables("edstays", "patients", "triage", "labevents", "lab_items", extra=_LAB_MASTER, body="""
    SELECT stay_id, coalesce(triage_sbp, (SELECT median(triage_sbp) FROM clean)) AS triage_sbp,
      coalesce(triage_heartrate, (SELECT median(triage_heartrate) FROM clean)) AS triage_heartrate,
      coalesce(triage_pain, (SELECT median(triage_pain) FROM clean)) AS triage_pain, triage_acuity,
      ed_los_hours > 24 AS outcome_ed_los FROM clean"""))
def lab_master(d: Derived):
    master = small_master(d)
    single = training.lab_results(master, d.labevents, d.lab_items)
    out = training.lab_master(master, single, d.lab_items)
    return out.select("stay_id", "triage_sbp", "triage_heartrate", "triage_pain", "triage_acuity", "outcome_ed_los")


