"""Readers: file -> DataFrame, and the pure shaping step of each table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import parse_number_text
from .schemas import ADMISSION_COLUMNS, SCHEMAS, SERIES_VITALS, TRIAGE_VITALS


#: Tables with free text, whose quoted cells may hold line breaks. Spark reads such a file
#: in one task, so the large tables of numbers and codes are not among them.
FREE_TEXT = {"triage", "pyxis", "medrecon"}


def read_table(
    spark: SparkSession, path: str, name: str | None = None, fmt: str | None = None, line_breaks: bool | None = None
) -> DataFrame:
    """Reads parquet or header CSV; CSV columns are matched to the schema by their names.

    CSV is read as text first, so column order and extra columns do not matter. Quoted
    cells may hold line breaks if ``line_breaks`` says so (by default in the tables of
    ``FREE_TEXT`` and in tables without a schema). Cells that do not parse become NULL;
    `rejected_cells` counts them.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if fmt != "csv":
        return nan_to_null(spark.read.format(fmt).load(path))
    breaks = name is None or name in FREE_TEXT if line_breaks is None else line_breaks
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", breaks).csv(path)
    return conform(raw, name) if name else raw


def _typed(cell: Column, kind: T.DataType) -> Column:
    """A text cell as a value; ``NaN`` is missing, and ``2345.0`` is a whole number."""
    cell = F.when(~F.lower(F.trim(cell)).isin("nan", ""), F.trim(cell)) if not isinstance(kind, T.StringType) else cell
    if isinstance(kind, T.IntegralType):
        number = cell.try_cast("decimal(38, 6)")
        return F.coalesce(cell.try_cast(kind), F.when(number == F.floor(number), number).try_cast(kind))
    return cell.try_cast(kind)


def conform(raw: DataFrame, name: str) -> DataFrame:
    """Casts the known columns of a text frame; unknown columns stay as they are."""
    types = {f.name: f.dataType for f in T._parse_datatype_string(SCHEMAS[name]).fields}
    return raw.select(
        *[_typed(F.col(f"`{c}`"), types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in raw.columns]
    )


def rejected_cells(raw: DataFrame, name: str) -> DataFrame:
    """``column, rejected``: cells of a text frame that hold something but not the column's type."""
    types = {f.name: f.dataType for f in T._parse_datatype_string(SCHEMAS[name]).fields}
    known = [c for c in raw.columns if c in types]
    given = {c: ~F.lower(F.trim(F.col(f"`{c}`"))).isin("nan", "") for c in known}
    counts = raw.select(
        *[F.count(F.when(given[c] & _typed(F.col(f"`{c}`"), types[c]).isNull(), 1)).alias(c) for c in known]
    )
    return counts.unpivot([], known, "column", "rejected")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing, and Spark orders NaN above all numbers, so NULL takes its place."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles}) if doubles else df


def _times(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in columns})


def shape_edstays(raw: DataFrame) -> DataFrame:
    return _times(raw, ["intime", "outtime"]).drop("race")


def shape_patients(raw: DataFrame) -> DataFrame:
    return raw.withColumn("dod", F.col("dod").try_cast("timestamp_ntz"))


def shape_admissions(raw: DataFrame) -> DataFrame:
    renamed = raw.withColumnRenamed("race", "ethnicity").select(*ADMISSION_COLUMNS)
    return _times(renamed, ["admittime", "dischtime", "deathtime"])


def shape_icustays(raw: DataFrame) -> DataFrame:
    return _times(raw, ["intime", "outtime"])


def shape_triage(raw: DataFrame) -> DataFrame:
    renamed = raw.withColumnsRenamed({v: f"triage_{v}" for v in TRIAGE_VITALS})
    return renamed.withColumn("triage_pain", parse_number_text("triage_pain"))


def shape_vitalsign(raw: DataFrame) -> DataFrame:
    renamed = raw.withColumnsRenamed({v: f"ed_{v}" for v in SERIES_VITALS})
    return _times(renamed, ["charttime"]).withColumn("ed_pain", parse_number_text("ed_pain"))


def unchanged(raw: DataFrame) -> DataFrame:
    return raw


#: table name -> shaping step.
SHAPES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "edstays": shape_edstays,
    "patients": shape_patients,
    "admissions": shape_admissions,
    "icustays": shape_icustays,
    "triage": shape_triage,
    "vitalsign": shape_vitalsign,
    "pyxis": unchanged,
    "medrecon": unchanged,
    "diagnoses_icd": unchanged,
    "labevents": unchanged,
}

#: table name -> folder below the data root.
FOLDERS = {
    "edstays": "ed", "triage": "ed", "vitalsign": "ed", "pyxis": "ed", "medrecon": "ed",
    "patients": "hosp", "admissions": "hosp", "diagnoses_icd": "hosp", "labevents": "hosp",
    "icustays": "icu",
}


def load(spark: SparkSession, root: str, name: str, extension: str = "csv") -> DataFrame:
    """One shaped table from ``root/<folder>/<name>.<extension>``."""
    return SHAPES[name](read_table(spark, f"{root.rstrip('/')}/{FOLDERS[name]}/{name}.{extension}", name))


def lab_dimension(items: DataFrame, group_order: Sequence[str]) -> DataFrame:
    """The lab item table: lower-case label, group number, and the row's rank in the file.

    Rank follows descending use count (the file's order), ties by item id.
    """
    groups = F.array(*[F.lit(g) for g in group_order])
    return items.filter("ed_labs = 1").select(
        F.col("itemid").cast("long"),
        F.lower("label").alias("label"),
        "grouping",
        (F.array_position(groups, F.col("grouping")) - 1).cast("int").alias("group_idx"),
        F.struct((-F.col("frequency")).alias("neg_frequency"), "itemid").alias("rank"),
    )


def parse_list_text(column: str, element: str = "double"):
    """A list written as text, such as ``[1, 2.5]``, back to an array."""
    return F.from_json(F.col(column), f"array<{element}>")
