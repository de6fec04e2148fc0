"""Clinical-shaped tables derived from the given business tables.

A customer stands for a subject, an order for a visit, an order line for a reading, a
medication, a diagnosis or a lab value. Every derived table grows with its source.
``Derived`` builds them with Spark, ``DERIVED_SQL`` states the same derivation for the
SQL engine of the correctness check.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panels import LAB_LABELS, PANEL_GROUPS, PANELS
from ..operators.policy import until_diagnosis
from ..session import checkpoint_dir, local_table
from ..sources import tables as shapes
from ..sources.sinks import write_table

#: Diagnosis codes that the lines of an order pick from: (code, version).
CODES = [
    ("I21.4", 10), ("I50.9", 10), ("I70.0", 10), ("G45.9", 10), ("F03.90", 10), ("J44.1", 10), ("M05.9", 10),
    ("K25.7", 10), ("K70.30", 10), ("E11.9", 10), ("E11.2", 10), ("G81.9", 10), ("N18.6", 10), ("C34.1", 10),
    ("I85.01", 10), ("C78.0", 10), ("B20", 10), ("I48.0", 10), ("I35.0", 10), ("I26.9", 10), ("I10", 10),
    ("D68.9", 10), ("E66.9", 10), ("F32.9", 10), ("Z00.0", 10), ("41401", 9), ("4280", 9), ("4019", 9),
    ("2504", 9), ("25000", 9), ("3441", 9), ("3341", 9), ("1960", 9), ("1950", 9), ("042", 9), ("5849", 9),
    ("2639", 9), ("30500", 9), ("29620", 9), ("V434", 9), (" 496 ", 9), ("7140", 9),
]
COMPLAINT_TEXTS = [
    "Chest pain", "ABD PAIN, nausea", "headache", "Short of breath", "lower back pain", "cough / fever",
    "Vomiting", "chills", "Syncope", "dizziness", "Fall", "Abdominal pain and CHEST PAIN",
]
#: Code mapping pairs; 4280 occurs twice on purpose.
MAP_9_TO_10 = [
    ("41401", "I2510"), ("4280", "I509"), ("4280", "I5020"), ("4019", "I10"), ("25000", "E119"), ("1960", "C770"),
    ("5849", "N179"), ("042", "B20"),
]
MAP_10_TO_9 = [("I10", "4019"), ("I50.9", "4280"), ("E11.9", "25000"), ("I21.4", "41071"), ("N18.6", "5856")]


def lab_item_rows() -> list[tuple]:
    """An item table with all labels; file order runs across the panels."""
    group_of = {lab: PANEL_GROUPS[i] for i, panel in enumerate(PANELS) for lab in panel}
    return [
        (50001 + i, label.title(), "Blood", "Any", 1, 1, 40000 - 100 * ((i * 29) % len(LAB_LABELS)), group_of[label])
        for i, label in enumerate(LAB_LABELS)
    ]


class Derived:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def from_csv(self, name: str, change: dict | None = None, raw: bool = False) -> DataFrame:
        """The raw table written as CSV, as exports look, and loaded: whole numbers with ``.0``, missing ones ``NaN``."""
        rows = getattr(self, f"{name}_raw")
        whole = [f.name for f in rows.schema.fields if f.name == "hadm_id"]
        rows = rows.withColumns(
            {c: F.when(F.col(c).isNull(), "NaN").otherwise(F.concat(F.col(c).cast("string"), F.lit(".0"))) for c in whole}
        ).withColumns(change or {})
        root = f"{checkpoint_dir(self.spark).rstrip('/')}/files-{uuid.uuid4().hex}"
        path = f"{root}/{shapes.FOLDERS[name]}/{name}.csv"
        write_table(rows, path, "csv")
        if raw:
            return self.spark.read.option("header", True).option("escape", '"').csv(path)
        return shapes.load(self.spark, root, name)

    @property
    def pyxis_raw(self) -> DataFrame:
        return self.pyxis

    @property
    def diagnoses_icd_raw(self) -> DataFrame:
        return self.diagnoses

    @property
    def labevents_raw(self) -> DataFrame:
        return self.labevents

    # ---- visits -------------------------------------------------------------------

    @cached_property
    def _visits(self) -> DataFrame:
        start = "timestampadd(MINUTE, cast(o_custkey * 7 % 1440 as int), o_orderdate)"
        base = self.table("orders").selectExpr(
            "o_custkey AS subject_id",
            "CASE WHEN o_orderstatus <> 'F' THEN o_orderkey + 10000000 END AS hadm_id",
            "o_orderkey AS stay_id",
            f"{start} AS intime",
            "o_orderpriority AS race",
            "o_orderstatus AS status",
        )
        return base.withColumn("outtime", F.expr("timestampadd(MINUTE, cast(60 + stay_id * 13 % 2880 as int), intime)"))

    @cached_property
    def edstays_raw(self) -> DataFrame:
        return self._visits.select("subject_id", "hadm_id", "stay_id", "intime", "outtime", "race")

    @cached_property
    def edstays(self) -> DataFrame:
        return shapes.shape_edstays(self.edstays_raw)

    @cached_property
    def patients_raw(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS subject_id",
            "CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender",
            "cast(10 + c_custkey % 85 as int) AS anchor_age",
            "cast(1994 + c_nationkey % 5 as int) AS anchor_year",
            "CASE WHEN c_custkey % 3 = 0 THEN date_add(DATE'1995-01-01', cast(c_custkey * 11 % 2400 as int)) END AS dod",
        )

    @cached_property
    def patients(self) -> DataFrame:
        return shapes.shape_patients(self.patients_raw)

    @cached_property
    def admissions_raw(self) -> DataFrame:
        return self._visits.filter("hadm_id IS NOT NULL").selectExpr(
            "subject_id",
            "hadm_id",
            "timestampadd(MINUTE, -30, outtime) AS admittime",
            "timestampadd(DAY, cast(stay_id * 17 % 20 + 1 as int), outtime) AS dischtime",
            "cast(NULL AS timestamp_ntz) AS deathtime",
            "nullif(race, '5-LOW') AS race",
            "cast(intime AS string) AS edregtime",
            "cast(outtime AS string) AS edouttime",
            "status AS insurance",
        )

    @cached_property
    def admissions(self) -> DataFrame:
        return shapes.shape_admissions(self.admissions_raw)

    @cached_property
    def icustays(self) -> DataFrame:
        return shapes.shape_icustays(self.icustays_raw)

    @cached_property
    def icustays_raw(self) -> DataFrame:
        first = self._visits.filter("status = 'P'").selectExpr(
            "subject_id", "hadm_id", "stay_id",
            "timestampadd(HOUR, cast(stay_id * 37 % 40 - 4 as int), outtime) AS intime",
        )
        second = first.filter("stay_id % 2 = 0").withColumn("intime", F.expr("timestampadd(HOUR, 48, intime)"))
        both = first.unionByName(second)
        return both.select("subject_id", "hadm_id", "intime", F.expr("timestampadd(HOUR, 20, intime)").alias("outtime"))

    # ---- per-stay tables ----------------------------------------------------------

    @cached_property
    def triage_raw(self) -> DataFrame:
        texts = ", ".join(f"'{t}'" for t in COMPLAINT_TEXTS)
        return self._visits.selectExpr(
            "subject_id",
            "stay_id",
            "CASE WHEN stay_id % 11 = 0 THEN NULL WHEN stay_id % 97 = 0 THEN 25.0D "
            "ELSE 90 + (stay_id * 13 % 180) / 10.0D END AS temperature",
            "CASE WHEN stay_id % 13 <> 0 THEN cast(30 + stay_id * 29 % 380 as double) END AS heartrate",
            "CASE WHEN stay_id % 14 <> 0 THEN cast(4 + stay_id * 17 % 60 as double) END AS resprate",
            "CASE WHEN stay_id % 15 <> 0 THEN cast(70 + stay_id * 19 % 45 as double) END AS o2sat",
            "CASE WHEN stay_id % 16 <> 0 THEN cast(50 + stay_id * 23 % 200 as double) END AS sbp",
            "CASE WHEN stay_id % 19 <> 0 THEN cast(25 + stay_id * 31 % 110 as double) END AS dbp",
            "CASE stay_id % 9 WHEN 0 THEN '7' WHEN 1 THEN '7-8' WHEN 2 THEN '5/10' WHEN 3 THEN '7.5' WHEN 4 THEN '-3' "
            "WHEN 5 THEN 'unable' WHEN 6 THEN '' WHEN 7 THEN ' 13 ' END AS pain",
            "CASE WHEN stay_id % 17 <> 0 THEN cast(1 + stay_id % 5 as double) END AS acuity",
            f"CASE WHEN stay_id % 13 <> 12 THEN element_at(array({texts}), cast(stay_id % 12 + 1 as int)) END AS chiefcomplaint",
        )

    @cached_property
    def triage(self) -> DataFrame:
        return shapes.shape_triage(self.triage_raw)

    @cached_property
    def _lines(self) -> DataFrame:
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("stay_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus",
        )
        return lines.join(self._visits, "stay_id")

    @cached_property
    def vitalsign_raw(self) -> DataFrame:
        return self._lines.selectExpr(
            "subject_id",
            "stay_id",
            "timestampadd(MINUTE, cast(l_linenumber * 47 + l_partkey % 40 as int), intime) AS charttime",
            "CASE WHEN l_suppkey % 7 <> 0 THEN 90 + l_quantity / 4 END AS temperature",
            "CASE WHEN l_suppkey % 5 <> 0 THEN 40 + l_quantity * 3 END AS heartrate",
            "CASE WHEN l_suppkey % 6 <> 0 THEN 5 + l_quantity END AS resprate",
            "80 + l_quantity / 2 AS o2sat",
            "60 + l_quantity * 4 AS sbp",
            "CASE WHEN l_suppkey % 3 <> 0 THEN 30 + l_quantity END AS dbp",
            "l_returnflag AS rhythm",
            "concat(cast(cast(l_quantity as int) % 12 as string), '-', cast(l_linenumber as string)) AS pain",
        )

    @cached_property
    def vitalsign(self) -> DataFrame:
        return shapes.shape_vitalsign(self.vitalsign_raw)

    @cached_property
    def pyxis(self) -> DataFrame:
        lines = self.table("lineitem").selectExpr(
            "l_orderkey AS stay_id",
            "concat('drug ', cast(l_partkey % 50 as string)) AS name",
            "CASE WHEN l_suppkey % 4 <> 0 THEN cast(l_partkey % 40 as string) END AS gsn",
        )
        return shapes.unchanged(lines)

    @cached_property
    def diagnoses(self) -> DataFrame:
        codes = ", ".join(f"named_struct('c', '{c}', 'v', {v})" for c, v in CODES)
        picked = self._lines.filter("hadm_id IS NOT NULL").selectExpr(
            "subject_id", "hadm_id", f"element_at(array({codes}), cast(l_partkey % {len(CODES)} + 1 as int)) AS d"
        )
        return shapes.unchanged(picked.selectExpr("subject_id", "hadm_id", "d.c AS icd_code", "d.v AS icd_version"))

    @cached_property
    def labevents(self) -> DataFrame:
        return self._lines.filter("hadm_id IS NOT NULL").selectExpr(
            "subject_id",
            "hadm_id",
            "50001 + l_partkey % 72 AS itemid",
            "timestampadd(MINUTE, cast((l_suppkey * 53 + l_linenumber * 11) % 3200 - 100 as int), intime) AS storetime",
            "CASE WHEN l_tax > 0 THEN l_extendedprice / 100 END AS valuenum",
        )

    @cached_property
    def lab_items_raw(self) -> DataFrame:
        return local_table(
            self.spark,
            lab_item_rows(),
            "itemid long, label string, fluid string, category string, ed_labs int, ed_most_common_labs int, "
            "frequency long, grouping string",
        )

    @cached_property
    def lab_items(self) -> DataFrame:
        return shapes.lab_dimension(self.lab_items_raw, PANEL_GROUPS)

    def code_map(self, pairs) -> DataFrame:
        return local_table(self.spark, pairs, "source_code string, target_code string")

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "edstays": self.edstays, "patients": self.patients, "admissions": self.admissions,
            "icustays": self.icustays, "triage": self.triage, "vitalsign": self.vitalsign,
            "pyxis": self.pyxis, "medrecon": self.pyxis, "diagnoses_icd": self.diagnoses, "labevents": self.labevents,
        }

    # ---- scored rows and episodes -------------------------------------------------

    @cached_property
    def scored(self) -> DataFrame:
        """Labelled documents with two scores."""
        return self.table("labels").join(self.table("documents"), "doc_id").selectExpr(
            "doc_id",
            "quality",
            "toxic",
            "cast(n_chars as double) AS length_score",
            "cast(n_chars % 17 as double) AS coarse_score",
        )

    @cached_property
    def log(self) -> DataFrame:
        """Conversations as episodes: a user turn orders a panel, an assistant turn may diagnose."""
        action = (
            "CASE WHEN role = 'user' THEN cast((conv_id + turn) % 12 as int) "
            "WHEN turn < 4 THEN cast((conv_id * 5 + turn) % 12 as int) "
            "ELSE cast(12 + length(text) % 2 as int) END"
        )
        steps = self.table("conversations").selectExpr(
            "conv_id AS patient_id",
            "turn AS step",
            f"{action} AS action",
            "(length(text) % 101) / 100.0D AS prob_pos",
            "cast(conv_id % 3 = 0 as int) AS label",
        )
        return until_diagnosis(steps)

    @cached_property
    def episode_patients(self) -> DataFrame:
        """The panels each patient has: those whose user turns named them."""
        return self.log.filter("action < 12").groupBy("patient_id").agg(
            F.sort_array(F.collect_set("action")).alias("lab_group_idx")
        )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_CODE_LIST = ", ".join(f"{{'c': '{c}', 'v': {v}}}" for c, v in CODES)
_TEXT_LIST = ", ".join(f"'{t}'" for t in COMPLAINT_TEXTS)

#: name -> (tables it needs, SQL of the derivation).
DERIVED_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "visits": ((), """
        SELECT *, intime + to_minutes(60 + stay_id * 13 % 2880) AS outtime FROM (
        SELECT o_custkey AS subject_id,
               CASE WHEN o_orderstatus <> 'F' THEN o_orderkey + 10000000 END AS hadm_id,
               o_orderkey AS stay_id, o_orderdate + to_minutes(o_custkey * 7 % 1440) AS intime,
               o_orderpriority AS race, o_orderstatus AS status
        FROM orders)"""),
    "edstays": (("visits",), "SELECT subject_id, hadm_id, stay_id, intime, outtime FROM visits"),
    "patients": ((), """
        SELECT c_custkey AS subject_id, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               CAST(10 + c_custkey % 85 AS INTEGER) AS anchor_age,
               CAST(1994 + c_nationkey % 5 AS INTEGER) AS anchor_year,
               CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey * 11 % 2400 AS INTEGER)) END AS dod
        FROM customer"""),
    "admissions": (("visits",), """
        SELECT subject_id, hadm_id, outtime - to_minutes(30) AS admittime,
               outtime + to_days(CAST(stay_id * 17 % 20 + 1 AS INTEGER)) AS dischtime,
               NULLIF(race, '5-LOW') AS ethnicity, CAST(intime AS VARCHAR) AS edregtime,
               CAST(outtime AS VARCHAR) AS edouttime, status AS insurance
        FROM visits WHERE hadm_id IS NOT NULL"""),
    "icustays": (("visits",), """
        SELECT subject_id, hadm_id, outtime + to_hours(stay_id * 37 % 40 - 4 + extra) AS intime
        FROM visits, (VALUES (0), (48)) x(extra)
        WHERE status = 'P' AND (extra = 0 OR stay_id % 2 = 0)"""),
    "triage": (("visits",), f"""
        SELECT subject_id, stay_id,
          CASE WHEN stay_id % 11 = 0 THEN NULL WHEN stay_id % 97 = 0 THEN 25.0
               ELSE 90 + CAST(stay_id * 13 % 180 AS DOUBLE) / 10 END::DOUBLE AS triage_temperature,
          CASE WHEN stay_id % 13 <> 0 THEN (30 + stay_id * 29 % 380)::DOUBLE END AS triage_heartrate,
          CASE WHEN stay_id % 14 <> 0 THEN (4 + stay_id * 17 % 60)::DOUBLE END AS triage_resprate,
          CASE WHEN stay_id % 15 <> 0 THEN (70 + stay_id * 19 % 45)::DOUBLE END AS triage_o2sat,
          CASE WHEN stay_id % 16 <> 0 THEN (50 + stay_id * 23 % 200)::DOUBLE END AS triage_sbp,
          CASE WHEN stay_id % 19 <> 0 THEN (25 + stay_id * 31 % 110)::DOUBLE END AS triage_dbp,
          CASE stay_id % 9 WHEN 0 THEN 7.0 WHEN 1 THEN 7.5 WHEN 2 THEN 5.0 WHEN 3 THEN 7.0 WHEN 7 THEN 13.0 END::DOUBLE AS triage_pain,
          CASE WHEN stay_id % 17 <> 0 THEN (1 + stay_id % 5)::DOUBLE END AS triage_acuity,
          CASE WHEN stay_id % 13 <> 12 THEN [{_TEXT_LIST}][stay_id % 12 + 1] END AS chiefcomplaint
        FROM visits"""),
    "lines": (("visits",), """
        SELECT * FROM (SELECT l_orderkey AS stay_id, l_partkey, l_suppkey, l_linenumber, l_quantity,
               l_extendedprice, l_tax, l_returnflag FROM lineitem) JOIN visits USING (stay_id)"""),
    "vitalsign": (("lines",), """
        SELECT subject_id, stay_id, intime + to_minutes(l_linenumber * 47 + l_partkey % 40) AS charttime,
          CASE WHEN l_suppkey % 7 <> 0 THEN 90 + l_quantity / 4 END AS ed_temperature,
          CASE WHEN l_suppkey % 5 <> 0 THEN 40 + l_quantity * 3 END AS ed_heartrate,
          CASE WHEN l_suppkey % 6 <> 0 THEN 5 + l_quantity END AS ed_resprate,
          80 + l_quantity / 2 AS ed_o2sat, 60 + l_quantity * 4 AS ed_sbp,
          CASE WHEN l_suppkey % 3 <> 0 THEN 30 + l_quantity END AS ed_dbp,
          (CAST(l_quantity AS INTEGER) % 12 + l_linenumber) / 2.0::DOUBLE AS ed_pain, l_returnflag AS ed_rhythm
        FROM lines"""),
    "pyxis": ((), """
        SELECT l_orderkey AS stay_id, 'drug ' || CAST(l_partkey % 50 AS VARCHAR) AS name,
          CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_partkey % 40 AS VARCHAR) END AS gsn FROM lineitem"""),
    "diagnoses": (("lines",), f"""
        SELECT subject_id, hadm_id, d.c AS icd_code, d.v AS icd_version FROM (
          SELECT subject_id, hadm_id, [{_CODE_LIST}][l_partkey % {len(CODES)} + 1] AS d
          FROM lines WHERE hadm_id IS NOT NULL)"""),
    "dated": (("diagnoses", "admissions"), """
        SELECT d.*, a.dischtime FROM diagnoses d LEFT JOIN admissions a USING (subject_id, hadm_id)"""),
    "labevents": (("lines",), """
        SELECT subject_id, hadm_id, 50001 + l_partkey % 72 AS itemid,
          intime + to_minutes((l_suppkey * 53 + l_linenumber * 11) % 3200 - 100) AS storetime,
          CASE WHEN l_tax > 0 THEN l_extendedprice / 100 END AS valuenum
        FROM lines WHERE hadm_id IS NOT NULL"""),
    "lab_items": ((), f"""
        SELECT itemid, lower(label) AS label, grouping_name, list_position([{', '.join(f"'{g}'" for g in PANEL_GROUPS)}], grouping_name) - 1 AS group_idx,
               row_number() OVER (ORDER BY frequency DESC, itemid) AS item_rank
        FROM (VALUES {_values(lab_item_rows())}) t(itemid, label, fluid, category, ed_labs, common, frequency, grouping_name)"""),
    "map9to10": ((), f"""
        SELECT source_code, max(target_code) AS target_code FROM (VALUES {_values(MAP_9_TO_10)}) m(source_code, target_code) GROUP BY 1"""),
    "map10to9": ((), f"""
        SELECT source_code, max(target_code) AS target_code FROM (VALUES {_values(MAP_10_TO_9)}) m(source_code, target_code) GROUP BY 1"""),
    "scored": ((), """
        SELECT doc_id, quality, toxic, n_chars::DOUBLE AS length_score, (n_chars % 17)::DOUBLE AS coarse_score
        FROM labels JOIN documents USING (doc_id)"""),
    "log": ((), """
        SELECT * FROM (SELECT *, min(CASE WHEN action >= 12 THEN step END) OVER (PARTITION BY patient_id) AS stop FROM (
        SELECT conv_id AS patient_id, turn AS step,
          CASE WHEN role = 'user' THEN (conv_id + turn) % 12 WHEN turn < 4 THEN (conv_id * 5 + turn) % 12
               ELSE 12 + length(text) % 2 END::INTEGER AS action,
          (length(text) % 101)::DOUBLE / 100 AS prob_pos, (conv_id % 3 = 0)::INTEGER AS label
        FROM conversations)) WHERE stop IS NULL OR step <= stop"""),
}


def with_tables(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the WITH clauses of the named derivations, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in DERIVED_SQL[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    clauses = [f"{n} AS ({DERIVED_SQL[n][1]})" for n in ordered]
    clauses += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(clauses)} {body}" if clauses else body
