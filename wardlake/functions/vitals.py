"""Vital-sign columns: families by name, unit change, outlier rule, mean arterial pressure."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Limits(NamedTuple):
    outlier_low: float
    valid_low: float
    valid_high: float
    outlier_high: float


# Outlier low, valid low, valid high, outlier high of each family.
VITAL_LIMITS = {
    "temperature": Limits(14.2, 26, 45, 47),
    "heartrate": Limits(0, 0, 350, 390),
    "resprate": Limits(0, 0, 300, 330),
    "o2sat": Limits(0, 0, 100, 150),
    "sbp": Limits(0, 0, 375, 375),
    "dbp": Limits(0, 0, 375, 375),
    "pain": Limits(0, 0, 10, 10),
    "acuity": Limits(1, 1, 5, 5),
}


def family(column: str) -> str | None:
    """The second ``_`` word of a column name: ``triage_sbp`` and ``ed_sbp_last`` are ``sbp``."""
    words = column.split("_")
    return words[1] if len(words) > 1 else None


def family_columns(df: DataFrame, families=VITAL_LIMITS, skip=()) -> list[str]:
    return [c for c in df.columns if family(c) in families and family(c) not in skip]


def to_celsius(df: DataFrame) -> DataFrame:
    columns = family_columns(df, {"temperature"})
    return df.withColumns({c: (F.col(c) - 32) * F.lit(5 / 9) for c in columns}) if columns else df


def clamp(column: str, limits: Limits) -> Column:
    """Outside the outlier limits -> NULL; outside the valid range -> nearest valid value."""
    x = F.col(column)
    return (
        F.when((x < limits.outlier_low) | (x > limits.outlier_high), F.lit(None))
        .when(x < limits.valid_low, F.lit(float(limits.valid_low)))
        .when(x > limits.valid_high, F.lit(float(limits.valid_high)))
        .otherwise(x)
    )


def remove_outliers(df: DataFrame, limits: Mapping[str, Limits] = VITAL_LIMITS) -> DataFrame:
    columns = family_columns(df, limits)
    return df.withColumns({c: clamp(c, limits[family(c)]) for c in columns}) if columns else df


def add_map(df: DataFrame) -> DataFrame:
    """Mean arterial pressure at triage."""
    return df.withColumn("triage_MAP", F.col("triage_sbp") * 1 / 3 + F.col("triage_dbp") * 2 / 3)


def round_temperature(df: DataFrame, column: str = "triage_temperature") -> DataFrame:
    return df.withColumn(column, F.round(column, 1))
