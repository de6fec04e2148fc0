"""Scores, vital limits and prices against values set by hand, not read from the library's tables."""

import pytest
from pyspark.sql import functions as F

from wardlake.functions import panels, scores, vitals

FLAGS = {c: 0 for c in scores.WEIGHTS["CCI"]}
WELL = dict(
    age=40, triage_MAP=90.0, triage_heartrate=75.0, triage_resprate=16.0, triage_o2sat=98.0, triage_sbp=120.0,
    triage_dbp=70.0, triage_temperature=37.0,
)
ILL = dict(
    age=85, triage_MAP=45.0, triage_heartrate=185.0, triage_resprate=50.0, triage_o2sat=70.0, triage_sbp=65.0,
    triage_dbp=30.0, triage_temperature=34.0,
)
EDGE = dict(
    age=50, triage_MAP=130.0, triage_heartrate=110.0, triage_resprate=24.0, triage_o2sat=92.0, triage_sbp=101.0,
    triage_dbp=40.0, triage_temperature=38.5,
)


@pytest.mark.parametrize(
    "name, row, total",
    [
        ("CCI", WELL, 0), ("CCI", ILL, 4), ("CCI", EDGE, 1),
        ("REMS", WELL, 0), ("REMS", ILL, 6 + 4 + 4 + 4 + 4), ("REMS", EDGE, 2 + 3 + 2 + 0 + 0),
        ("CART", WELL, 0), ("CART", ILL, 9 + 22 + 13 + 13), ("CART", EDGE, 0 + 12 + 4 + 4),
        ("NEWS", WELL, 0), ("NEWS", ILL, 3 + 3 + 3 + 3 + 3), ("NEWS", EDGE, 2 + 2 + 1 + 1 + 1),
        ("NEWS2", WELL, 0), ("NEWS2", ILL, 12), ("NEWS2", EDGE, 2 + 1 + 1 + 1),
        ("MEWS", WELL, 1), ("MEWS", ILL, 3 + 3 + 3 + 2), ("MEWS", EDGE, 0 + 1 + 2 + 2),
        ("SERP2d", WELL, 9 + 3 + 0 + 1 + 0 + 0), ("SERP2d", ILL, 17 + 10 + 7 + 10 + 5 + 7), ("SERP2d", EDGE, 13 + 10 + 7 + 4 + 5 + 5),
        ("SERP7d", WELL, 10 + 4 + 0 + 1 + 0), ("SERP7d", ILL, 21 + 12 + 6 + 12 + 4), ("SERP7d", EDGE, 17 + 12 + 6 + 6 + 4),
        ("SERP30d", WELL, 8 + 2 + 0 + 2 + 0), ("SERP30d", ILL, 19 + 9 + 6 + 8 + 3), ("SERP30d", EDGE, 14 + 9 + 6 + 5 + 3),
    ],
)
def test_totals(spark, name, row, total):
    values = {**FLAGS, **row}
    df = spark.range(1).select(*[F.lit(v).alias(c) for c, v in values.items()])
    assert df.select(scores.score(name)).first()[0] == total


def test_missing_values_and_gaps_have_no_points(spark):
    values = {**FLAGS, **{c: None for c in WELL}}
    df = spark.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in values.items()])
    assert all(df.select(scores.score(n)).first()[0] == 0 for n in scores.BANDS)
    gap = spark.range(1).select(F.lit(40.5).alias("x")).select(scores.band_points("x", scores.HEART_NEWS))
    assert gap.first()[0] == 0


@pytest.mark.parametrize(
    "flag, cci",
    [
        ("cci_MI", 1), ("cci_Liver1", 1), ("cci_Liver2", 3), ("cci_DM1", 1), ("cci_DM2", 2), ("cci_Paralysis", 2),
        ("cci_Renal", 2), ("cci_Cancer1", 2), ("cci_Cancer2", 6), ("cci_HIV", 6),
    ],
)
def test_weights(spark, flag, cci):
    df = spark.range(1).select(*[F.lit(v).alias(c) for c, v in {**FLAGS, **WELL, flag: 1}.items()])
    assert df.select(scores.score("CCI")).first()[0] == cci
    extra = {"cci_Cancer1": 6, "cci_Cancer2": 12}.get(flag, 0)
    assert df.select(scores.score("SERP30d")).first()[0] == 12 + extra


def test_panels():
    assert panels.PRICES == [30, 60, 48, 40, 4, 104, 100, 89, 122, 12, 70, 178]
    assert [len(p) for p in panels.PANELS] == [23, 9, 3, 10, 1, 5, 1, 2, 2, 8, 1, 2]
    assert len(set(panels.LAB_LABELS)) == 67
    assert panels.PANELS[2] == ["prothrombin time", "inr(pt)", "ptt"]
    assert "calcium, total" in panels.PANELS[1] and "potassium, whole blood" in panels.PANELS[9]


def test_vital_limits_by_hand(spark):
    limit = vitals.VITAL_LIMITS["heartrate"]
    rows = [limit.outlier_low - 1, limit.outlier_low, limit.outlier_high, limit.outlier_high + 1]
    df = spark.createDataFrame([(float(x),) for x in rows], "triage_heartrate double")
    got = [r[0] for r in vitals.remove_outliers(df).collect()]
    assert got == [None, float(limit.valid_low), float(limit.valid_high), None]
