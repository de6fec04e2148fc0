import math

import pytest
from pyspark.sql import functions as F

from wardlake.functions import costs, parse, scores, text, vitals
from wardlake.functions.numbers import float_text
from wardlake.functions.panels import LAB_LABELS, PANEL_PRICES, PRICES, panel_feature_numbers
from wardlake.plans.training import RECORD


def test_number_texts(spark):
    cases = {"7": 7.0, "7-8": 7.5, "5/10": 5.0, "7.5": 7.0, "-3": None, "unable": None, "": None, None: None, " 4 ": 4.0,
             "1-2-3": None, "7a": None, "10 of 10": 10.0}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    for r in df.select("x", parse.parse_number_text("x").alias("y")).collect():
        assert r["y"] == cases[r["x"]], r


def test_float_text_is_the_shortest_form(spark):
    values = [3.0, 0.1, 0.0, -2.5, 1e-4, 0.00012345, 9.9e-5, 1e-5, 12345678.0, 12345678.125, 1e15, 1e16, 123456789012345680.0,
              2.5e-7, 0.001, 1e7, 9999999.5, 1 / 3, 2e23, 1e-100, 4.8030032406836672e16]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", float_text(F.col("x")).alias("t")).collect():
        assert r["t"] == repr(r["x"])


def test_complaints(spark):
    df = spark.createDataFrame([("CHEST PAIN, abd pain",), (None,), ("Lightheaded",)], "chiefcomplaint string")
    rows = parse.complaint_flags(df).collect()
    assert rows[0]["chiefcom_chest_pain"] and rows[0]["chiefcom_abdominal_pain"] and not rows[0]["chiefcom_cough"]
    assert not any(rows[1][c] for c in parse.COMPLAINTS)
    assert rows[2]["chiefcom_headache"]


def test_pharm_class(spark):
    df = spark.createDataFrame([("Beta Adrenergic Blocker [EPC]",), ("[MoA]",)], "x string")
    term, kind = parse.pharm_class("x")
    assert [tuple(r) for r in df.select(term, kind).collect()] == [("Beta Adrenergic Blocker", "EPC"), ("", "MoA")]


def test_clamp(spark):
    values = [14.1, 14.2, 25.9, 26.0, 45.0, 46.0, 47.0, 47.1, None]
    df = spark.createDataFrame([(v,) for v in values], "triage_temperature double")
    got = [r[0] for r in vitals.remove_outliers(df).collect()]
    assert got == [None, 26.0, 26.0, 26.0, 45.0, 45.0, 45.0, None, None]


def test_family_of_a_column():
    assert vitals.family("triage_sbp") == vitals.family("ed_sbp_last") == "sbp"
    assert vitals.family("age") is None


def test_band_gaps_and_missing_values_score_zero(spark):
    cases = [(109.5, 0), (49.5, 0), (None, 0), (110.0, 2), (48.9, 4), (160.0, 4), (49.0, 0)]
    df = spark.createDataFrame([(v,) for v, _ in cases], "triage_MAP double")
    got = [r[0] for r in df.select(scores.band_points("triage_MAP", scores.BANDS["REMS"]["triage_MAP"])).collect()]
    assert got == [p for _, p in cases]


def test_half_open_bands(spark):
    cases = [(35.0, 3), (35.5, 1), (36.0, 1), (36.1, 0), (38.0, 0), (39.0, 1), (39.1, 2)]
    df = spark.createDataFrame([(v,) for v, _ in cases], "t double")
    assert [r[0] for r in df.select(scores.band_points("t", scores.TEMP_NEWS)).collect()] == [p for _, p in cases]
    mews = [(34.9, 2), (35.0, 0), (38.49, 0), (38.5, 2)]
    df = spark.createDataFrame([(v,) for v, _ in mews], "t double")
    got = [r[0] for r in df.select(scores.band_points("t", scores.BANDS["MEWS"]["triage_temperature"])).collect()]
    assert got == [p for _, p in mews]


@pytest.mark.parametrize("name", sorted(scores.BANDS))
def test_scores_stay_in_range(spark, name):
    inputs = {"age": 200, "triage_MAP": 300, "triage_heartrate": 300, "triage_resprate": 100, "triage_o2sat": 120,
              "triage_sbp": 300, "triage_dbp": 200, "triage_temperature": 60}
    ladder = spark.range(0, 400).select(*[(F.col("id") * m / 400).alias(c) for c, m in inputs.items()])
    ladder = ladder.withColumns({c: F.lit(0) for w in scores.WEIGHTS.values() for c in w})
    top = sum(max(band[4] for band in bands) for bands in scores.BANDS[name].values())
    low, high = scores.add_scores(ladder, [name]).agg(F.min(f"score_{name}"), F.max(f"score_{name}")).first()
    assert 0 <= low <= high <= top


def test_panels():
    assert len(LAB_LABELS) == 67 and len(RECORD) == 55
    assert [len(r) for r in panel_feature_numbers(56)] == [23, 9, 3, 10, 1, 5, 1, 2, 2, 8, 1, 2]
    assert panel_feature_numbers(56)[-1][-1] == 122


def test_personal_costs_and_actions(spark):
    df = spark.createDataFrame([([0, 4],), ([],)], "g array<int>")
    rows = df.select(
        costs.personal_costs("g").alias("c"), costs.legal_actions("g").alias("m"), costs.pending_panels("g").alias("p"),
        costs.legal_actions("g", F.array(F.lit(4))).alias("m4"),
    ).collect()
    assert rows[0]["c"][0] == pytest.approx(30 / 34 * 2) and rows[0]["c"][4] == pytest.approx(4 / 34 * 2)
    assert rows[0]["c"][1] == PRICES[1] and rows[1]["c"] == [float(p) for p in PANEL_PRICES.values()]
    assert [i for i, ok in enumerate(rows[0]["m"]) if ok] == [0, 4, 12, 13]
    assert [i for i, ok in enumerate(rows[0]["m4"]) if ok] == [0, 12, 13]
    assert rows[0]["p"] == [1, 2, 3, 5, 6, 7, 8, 9, 10, 11]


def test_rewards(spark):
    cases = [(0, False, -7.0), (12, True, -99.0 * 15), (13, True, 0.0), (13, False, -99.0), (12, False, 0.0)]
    df = spark.createDataFrame([(a, y) for a, y, _ in cases], "a int, y boolean")
    reward = costs.step_reward(F.col("a"), F.col("y"), F.array(F.lit(7.0)))
    assert [r[0] for r in df.select(reward).collect()] == [v for _, _, v in cases]


def test_ill_probability(spark):
    p = [0.0] * 12 + [0.2, 0.6]
    df = spark.createDataFrame([(p,)], "p array<double>")
    assert math.isclose(df.select(costs.ill_probability("p")).first()[0], 0.75)


def test_row_texts(spark):
    df = spark.createDataFrame(
        [(61, "F", 0, None, 1.5, 0.0, None, [1]), (0, "", 3, "nan", 0.0, 2.0, 4.0, [0, 1])],
        "age int, gender string, n long, note string, x double, a double, b double, g array<int>",
    )
    record = ["age", "gender", "n", "note", "x"]
    df = df.withColumn("parts", text.segments(df, record, [["a"], ["a", "b"]], "g"))
    rows = [r[0] for r in df.select(text.segmented_row_text(F.col("parts"), "#")).collect()]
    assert rows[0] == "age : 61 | gender : F | x : 1.5#a : 0.0 | b : nan#"
    assert rows[1] == "gender :  | n : 3#a : 2.0#a : 2.0 | b : 4.0#"
    steps = text.growing_text(df.select("age", "parts"), "parts", "#").filter("age = 61").orderBy("step").collect()
    assert [s["text"] for s in steps] == ["age : 61 | gender : F | x : 1.5#", rows[0]]
