"""Row-wise outcomes and filters of the visit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clock import DAY_US, HOUR_US, micros, micros_between, rounded_span


def add_age(df: DataFrame) -> DataFrame:
    return df.withColumn("in_year", F.year("intime")).withColumn(
        "age", F.col("in_year") - F.col("anchor_year") + F.col("anchor_age")
    )


def add_inhospital_mortality(df: DataFrame) -> DataFrame:
    died = F.col("dod").isNotNull() & (micros("dischtime") >= micros("dod"))
    return df.withColumn("outcome_inhospital_mortality", F.coalesce(died, F.lit(False)))


def add_ed_los(df: DataFrame) -> DataFrame:
    return df.withColumn("ed_los", F.col("outtime") - F.col("intime"))


def add_hospitalization(df: DataFrame) -> DataFrame:
    return df.withColumn("outcome_hospitalization", F.col("hadm_id").isNotNull())


def add_critical(df: DataFrame, icu_hours: int = 12) -> DataFrame:
    return df.withColumn(
        "outcome_critical",
        F.col("outcome_inhospital_mortality") | F.col(f"outcome_icu_transfer_{icu_hours}h"),
    )


def add_numeric_spans(df: DataFrame) -> DataFrame:
    """The three spans as numbers: stay hours, hours to intensive care, days to the next visit."""
    return df.withColumns(
        {
            "ed_los_hours": rounded_span(micros_between("intime", "outtime"), HOUR_US),
            "time_to_icu_transfer_hours": rounded_span(micros_between("outtime", "intime_icu"), HOUR_US),
            "next_ed_visit_time_diff_days": rounded_span(micros_between("outtime", "next_ed_visit_time"), DAY_US),
        }
    )


def add_long_stay(df: DataFrame, hours: float = 24) -> DataFrame:
    return df.withColumn("outcome_ed_los", F.coalesce(F.col("ed_los_hours") > hours, F.lit(False)))


def ed_minutes(wrap_days: bool = True) -> Column:
    """Stay length in minutes; ``wrap_days`` drops whole days, as the task scripts expect."""
    seconds = micros_between("intime", "outtime") / F.lit(1_000_000)
    return (F.pmod(seconds, F.lit(86400.0)) if wrap_days else seconds) / 60


def adults(df: DataFrame, age: int = 18) -> DataFrame:
    return df.filter(F.col("age") >= age)


def with_acuity(df: DataFrame) -> DataFrame:
    return df.filter(F.col("triage_acuity").isNotNull())


def hospitalized(df: DataFrame) -> DataFrame:
    return df.filter(F.col("outcome_hospitalization"))


def discharged(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("outcome_hospitalization"))


def acuity_score(df: DataFrame) -> DataFrame:
    """Low acuity numbers are urgent, so the score is the negated number."""
    return df.withColumn("esi", -F.col("triage_acuity"))
