"""Additive risk scores: every input falls into one band, each band has points."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. A band is (low, low included, high, high included, points); None is open.
# A value in no band (a gap between whole numbers, or a missing value) has 0 points.
HEART_NEWS = [
    (None, False, 40, True, 3),
    (41, True, 50, True, 1),
    (51, True, 90, True, 0),
    (91, True, 110, True, 1),
    (111, True, 130, True, 2),
    (130, False, None, False, 3),
]
RESP_NEWS = [
    (None, False, 8, True, 3),
    (9, True, 11, True, 1),
    (12, True, 20, True, 0),
    (21, True, 24, True, 2),
    (25, True, None, False, 3),
]
TEMP_NEWS = [
    (None, False, 35, True, 3),
    (35, False, 36, True, 1),
    (36, False, 38, True, 0),
    (38, False, 39, True, 1),
    (39, False, None, False, 2),
]
SBP_NEWS = [
    (None, False, 90, True, 3),
    (91, True, 100, True, 2),
    (101, True, 110, True, 1),
    (111, True, 219, True, 0),
    (219, False, None, False, 3),
]
BANDS = {
    "CCI": {
        "age": [
            (None, False, 50, False, 0),
            (50, True, 59, True, 1),
            (60, True, 69, True, 2),
            (70, True, 79, True, 3),
            (80, True, None, False, 4),
        ],
    },
    "REMS": {
        "age": [
            (None, False, 45, False, 0),
            (45, True, 54, True, 2),
            (55, True, 64, True, 3),
            (65, True, 74, True, 5),
            (74, False, None, False, 6),
        ],
        "triage_MAP": [
            (159, False, None, False, 4),
            (130, True, 159, True, 3),
            (110, True, 129, True, 2),
            (70, True, 109, True, 0),
            (50, True, 69, True, 2),
            (None, False, 49, False, 4),
        ],
        "triage_heartrate": [
            (179, False, None, False, 4),
            (140, True, 179, True, 3),
            (110, True, 139, True, 2),
            (70, True, 109, True, 0),
            (55, True, 69, True, 2),
            (40, True, 54, True, 3),
            (None, False, 40, False, 4),
        ],
        "triage_resprate": [
            (49, False, None, False, 4),
            (35, True, 49, True, 3),
            (25, True, 34, True, 1),
            (12, True, 24, True, 0),
            (10, True, 11, True, 1),
            (6, True, 9, True, 2),
            (None, False, 6, False, 4),
        ],
        "triage_o2sat": [
            (None, False, 75, False, 4),
            (75, True, 85, True, 3),
            (86, True, 89, True, 1),
            (89, False, None, False, 0),
        ],
    },
    "CART": {
        "age": [
            (None, False, 55, False, 0),
            (55, True, 69, True, 4),
            (70, True, None, False, 9),
        ],
        "triage_resprate": [
            (None, False, 21, False, 0),
            (21, True, 23, True, 8),
            (24, True, 25, True, 12),
            (26, True, 29, True, 15),
            (30, True, None, False, 22),
        ],
        "triage_heartrate": [
            (None, False, 110, False, 0),
            (110, True, 139, True, 4),
            (140, True, None, False, 13),
        ],
        "triage_dbp": [
            (49, False, None, False, 0),
            (40, True, 49, True, 4),
            (35, True, 39, True, 6),
            (None, False, 35, False, 13),
        ],
    },
    "NEWS": {
        "triage_resprate": RESP_NEWS,
        "triage_o2sat": [
            (None, False, 91, True, 3),
            (92, True, 93, True, 2),
            (94, True, 95, True, 1),
            (96, True, None, False, 0),
        ],
        "triage_temperature": TEMP_NEWS,
        "triage_sbp": SBP_NEWS,
        "triage_heartrate": HEART_NEWS,
    },
    "NEWS2": {
        "triage_resprate": RESP_NEWS,
        "triage_temperature": TEMP_NEWS,
        "triage_sbp": SBP_NEWS,
        "triage_heartrate": HEART_NEWS,
    },
    "MEWS": {
        "triage_sbp": [
            (None, False, 70, True, 3),
            (71, True, 80, True, 2),
            (81, True, 100, True, 1),
            (101, True, 199, True, 0),
            (199, False, None, False, 2),
        ],
        "triage_heartrate": [
            (None, False, 40, True, 2),
            (41, True, 50, True, 1),
            (51, True, 100, True, 0),
            (101, True, 110, True, 1),
            (111, True, 129, True, 2),
            (130, True, None, False, 3),
        ],
        "triage_resprate": [
            (None, False, 9, False, 2),
            (9, True, 14, True, 0),
            (15, True, 20, True, 1),
            (21, True, 29, True, 2),
            (30, True, None, False, 3),
        ],
        "triage_temperature": [
            (None, False, 35, False, 2),
            (35, True, 38.5, False, 0),
            (38.5, True, None, False, 2),
        ],
    },
    "SERP2d": {
        "age": [
            (None, False, 30, False, 0),
            (30, True, 49, True, 9),
            (50, True, 79, True, 13),
            (80, True, None, False, 17),
        ],
        "triage_heartrate": [
            (None, False, 60, False, 3),
            (60, True, 69, True, 0),
            (70, True, 94, True, 3),
            (95, True, 109, True, 6),
            (110, True, None, False, 10),
        ],
        "triage_resprate": [
            (None, False, 16, False, 11),
            (16, True, 19, True, 0),
            (20, True, None, False, 7),
        ],
        "triage_sbp": [
            (None, False, 100, False, 10),
            (100, True, 114, True, 4),
            (115, True, 149, True, 1),
            (150, True, None, False, 0),
        ],
        "triage_dbp": [
            (None, False, 50, False, 5),
            (50, True, 94, True, 0),
            (95, True, None, False, 1),
        ],
        "triage_o2sat": [
            (None, False, 90, False, 7),
            (90, True, 94, True, 5),
            (95, True, None, False, 0),
        ],
    },
    "SERP7d": {
        "age": [
            (None, False, 30, False, 0),
            (30, True, 49, True, 10),
            (50, True, 79, True, 17),
            (80, True, None, False, 21),
        ],
        "triage_heartrate": [
            (None, False, 60, False, 2),
            (60, True, 69, True, 0),
            (70, True, 94, True, 4),
            (95, True, 109, True, 8),
            (110, True, None, False, 12),
        ],
        "triage_resprate": [
            (None, False, 16, False, 10),
            (16, True, 19, True, 0),
            (20, True, None, False, 6),
        ],
        "triage_sbp": [
            (None, False, 100, False, 12),
            (100, True, 114, True, 6),
            (115, True, 149, True, 1),
            (150, True, None, False, 0),
        ],
        "triage_dbp": [
            (None, False, 50, False, 4),
            (50, True, 94, True, 0),
            (95, True, None, False, 2),
        ],
    },
    "SERP30d": {
        "age": [
            (None, False, 30, False, 0),
            (30, True, 49, True, 8),
            (50, True, 79, True, 14),
            (80, True, None, False, 19),
        ],
        "triage_heartrate": [
            (None, False, 60, False, 1),
            (60, True, 69, True, 0),
            (70, True, 94, True, 2),
            (95, True, 109, True, 6),
            (110, True, None, False, 9),
        ],
        "triage_resprate": [
            (None, False, 16, False, 8),
            (16, True, 19, True, 0),
            (20, True, None, False, 6),
        ],
        "triage_sbp": [
            (None, False, 100, False, 8),
            (100, True, 114, True, 5),
            (115, True, 149, True, 2),
            (150, True, None, False, 0),
        ],
        "triage_dbp": [
            (None, False, 50, False, 3),
            (50, True, 94, True, 0),
            (95, True, None, False, 2),
        ],
    },
}
# Points of each comorbidity flag.
WEIGHTS = {
    "CCI": {
        "cci_MI": 1, "cci_CHF": 1, "cci_PVD": 1, "cci_Stroke": 1, "cci_Dementia": 1, "cci_Pulmonary": 1,
        "cci_PUD": 1, "cci_Rheumatic": 1, "cci_Liver1": 1, "cci_Liver2": 3, "cci_DM1": 1, "cci_DM2": 2,
        "cci_Paralysis": 2, "cci_Renal": 2, "cci_Cancer1": 2, "cci_Cancer2": 6, "cci_HIV": 6,
    },
    "SERP30d": {"cci_Cancer1": 6, "cci_Cancer2": 12},
}

Band = tuple[float | None, bool, float | None, bool, int]


def _inside(value: Column, band: Band) -> Column:
    low, low_in, high, high_in, _ = band
    tests = []
    if low is not None:
        tests.append(value >= float(low) if low_in else value > float(low))
    if high is not None:
        tests.append(value <= float(high) if high_in else value < float(high))
    return reduce(operator.and_, tests)


def band_points(column: str, bands: Sequence[Band]) -> Column:
    """Points of the first band that holds the value, else 0."""
    chain = F
    for band in bands:
        chain = chain.when(_inside(F.col(column), band), band[4])
    return chain.otherwise(0)


def score(name: str) -> Column:
    """The score's value for a row; needs ``triage_MAP`` for REMS and comorbidity flags for CCI, SERP30d."""
    terms = [band_points(c, bands) for c, bands in BANDS[name].items()]
    terms += [F.col(c) * F.lit(w) for c, w in WEIGHTS.get(name, {}).items()]
    return reduce(operator.add, terms)


def add_scores(df: DataFrame, names=("CCI", "CART", "REMS", "NEWS", "NEWS2", "MEWS")) -> DataFrame:
    return df.withColumns({f"score_{n}": score(n) for n in names})
