"""Operators that work block by block: intervals, grouped medians, carried values, empty input."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlake.operators import events, joins, metrics, policy, splits
from wardlake.operators.prefix import carried, exact_medians, grouped_medians, rank_blocks

T0 = datetime(1969, 12, 20)


def test_dyadic_blocks_cover_a_range_once(spark):
    rng = random.Random(3)
    rows = [(i, a, a + rng.choice([0, 1, 5, 100, 4000])) for i, a in enumerate(rng.randint(-70, 70) for _ in range(150))]
    rows += [(900, 0, 7), (901, -8, 7), (902, 5, 4), (903, -(2**40), 2**41)]
    found = spark.createDataFrame(rows, "i long, a long, z long").select("i", F.inline(joins.dyadic_blocks("a", "z"))).collect()
    by = {}
    for r in found:
        by.setdefault(r.i, []).append((r._level, r._block))
    for i, a, z in rows:
        own = sorted((b << j, (b + 1) << j) for j, b in by.get(i, []))
        assert [x[0] for x in own[1:]] == [x[1] for x in own[:-1]]
        assert (own[0][0], own[-1][1]) == (a, z + 1) if z >= a else not own
        assert len(own) <= 2 * max(z - a + 1, 1).bit_length()


def test_intervals_of_any_length(spark):
    """A span to the year 9999, one of an instant, a reversed and an open one; a third of all events in one key."""
    rng = random.Random(5)
    spans = [(k % 3, k, T0 + timedelta(hours=rng.randint(0, 900)), None) for k in range(30)]
    spans = [(g, k, a, a + timedelta(hours=rng.choice([0, 3, 30, 700]))) for g, k, a, _ in spans]
    spans += [(0, 90, T0, datetime(9999, 12, 31)), (0, 91, T0 + timedelta(days=3), T0), (0, 92, T0, None), (None, 93, T0, datetime(2500, 1, 1))]
    points = [(rng.choice([0, 0, 1, 2]), m, T0 + timedelta(hours=rng.randint(-20, 1500))) for m in range(400)] + [(0, 990, None), (None, 991, T0)]
    left = spark.createDataFrame(spans, "g long, k long, a timestamp_ntz, z timestamp_ntz")
    right = spark.createDataFrame(points, "g long, m long, t timestamp_ntz")
    joined = joins.events_within(left, right, ["g"], "a", "z", "t")
    assert joined.columns == ["g", "k", "a", "z", "m", "t"]
    want = sorted((k, m) for g, k, a, z in spans for h, m, t in points if g == h and g is not None and z and t and a <= t <= z)
    assert sorted((r.k, r.m) for r in joined.collect()) == want
    assert joins.events_within(left.filter("k < 0"), right, ["g"], "a", "z", "t").count() == 0


def test_grouped_medians_with_a_hot_group(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "b", "c", None]), rng.choice([rng.gauss(0, 1), 0.5, None, float("nan")]), float(i % 7)) for i in range(900)]
    rows += [("hot", rng.gauss(0, 1), None) for _ in range(450)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {(r.g, r.variable): r["median"] for r in grouped_medians(df, ["g"], ["x", "y"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for i, c in ((1, "x"), (2, "y")):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]]
            if values:
                want[(g, c)] = statistics.median(values)
    assert got == want
    plan = grouped_medians(df, ["g"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median" not in plan.replace("median#", "")


def test_carried_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), i, rng.choice([None, i]), rng.choice([None, -i])) for i in range(200)] + [(None, 5, 1, None), (None, 9, None, 2)]
    df = spark.createDataFrame(rows, "g string, o long, x long, y long")
    out = carried(df, ["g"], "o", F.floor(F.col("o") / 16), ["x"], ["y"]).collect()
    assert len(out) == len(rows)
    for r in out:
        past = [x for g, o, x, _ in rows if g == r.g and o < r.o and x is not None]
        following = [y for g, o, _, y in rows if g == r.g and o > r.o and y is not None]
        assert r.past_x == (past[-1] if past else None)
        assert r.next_y == (following[0] if following else None)


def test_series_over_many_blocks(spark, monkeypatch):
    """The same steps whatever the blocks, with a reading missing at the start and a long gap."""
    rows = [(1, T0 + timedelta(hours=h), None if h < 2 else float(h), float(h) if h % 40 == 0 else None) for h in [0, 1, 2, 3, 40, 41, 300, 301]]
    rows += [(2, T0 + timedelta(minutes=90 * i), float(i), None) for i in range(150)] + [(3, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "stay_id long, charttime timestamp_ntz, a double, b double")
    got = []
    for bits in (2, 20):
        monkeypatch.setattr(events, "STEP_BITS", bits)
        got.append(sorted(tuple(r) for r in events.hourly_series(df, ["a", "b"]).collect()))
    assert got[0] == got[1] and len(got[0]) == 302 + 224
    one = {r[2]: r[3:] for r in got[0] if r[0] == 1}
    assert one[0] == (2.0, 0.0) and one[1] == (2.0, 1.0) and one[170] == (41 + (170 - 41), 40.0) and one[301] == (301.0, 40.0)


EMPTY = "g string, x double, y double, label int, k long"


def test_blocks_of_columns_without_values(spark):
    rows = [("a", None, float("inf"), 1, 1), ("b", None, float("-inf"), 0, 2)]
    df = spark.createDataFrame(rows, EMPTY)
    assert {(r.x_block, r.y_block) for r in rank_blocks(df, ["x", "y"]).collect()} == {(None, 0)}
    assert {r.variable: r["median"] for r in exact_medians(df, ["x"]).collect()} == {"x": None}
    for frame in (df.filter("k < 0"), df.select("g", "x", "y", "label", "k")):
        assert splits.fit_medians(frame, ["x"]) == {"x": None}
        assert grouped_medians(frame, ["g"], ["x"]).count() == 0


@pytest.mark.parametrize("value", [None, float("inf")])
def test_metrics_without_scores(spark, value):
    df = spark.createDataFrame([("a", value, 1.0, 1, 1), ("b", value, 2.0, 0, 2)], EMPTY)
    some = metrics.score_metrics(df, ["x"], "label").collect()
    assert [(r.group, r.auroc) for r in some] == ([] if value is None else [("x", 0.5)])
    none = df.filter("k < 0")
    assert metrics.score_metrics(none, ["x", "y"], "label").count() == 0
    assert metrics.bootstrap_intervals(none, ["x"], "label", "k", 5).count() == 0
    assert metrics.roc_points(metrics.cumulative(metrics.long_scores(none, ["x"], "label"))).count() == 0


def test_policies_of_an_empty_log(spark):
    log = spark.createDataFrame([], "patient_id long, step int, action int, prob_pos double, label int")
    assert policy.budget_curve(log).count() == 0
    patients = spark.createDataFrame([], "patient_id long, lab_group_idx array<int>")
    assert policy.policy_report(log, patients).count() <= 1


@pytest.mark.parametrize("rows", [0, 1, 7, 1003])
def test_exact_shares(spark, rows):
    shares = {"train": 0.8, "valid": 0.1, "test": 0.1}
    df = spark.range(rows).withColumnRenamed("id", "k")
    got = {r.k: r.part for r in splits.exact_split(df, "k", shares).collect()}
    count = lambda part: sum(p == part for p in got.values())
    assert len(got) == rows
    assert (count("train"), count("train") + count("valid")) == (int(rows * 0.8 + 0.5), int(rows * 0.9 + 0.5))
    again = splits.exact_split(df.repartition(7), "k", shares)
    assert {r.k: r.part for r in again.collect()} == got
    other = {r.k: r.part for r in splits.exact_split(df, "k", shares, seed=1).collect()}
    assert rows < 100 or other != got


def test_nth_hashes(spark):
    values = [5, 5, 5, 0, (1 << 60) - 1, 1 << 59, 77, 78, 79, (1 << 48) + 3, (1 << 48) + 4]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ranks = list(range(len(values) + 1))
    assert splits.nth_hashes(df, F.col("v"), ranks) == [-1, *sorted(values)]


def test_rows_of_one_key_stay_together(spark):
    df = spark.createDataFrame([(k,) for k in [1] * 40 + list(range(2, 62))], "k long")
    rows = splits.exact_split(df, "k", {"a": 0.5, "b": 0.5}).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.k, set()).add(r.part)
    assert all(len(p) == 1 for p in parts.values())


def test_lab_filters_reach_the_scan(spark, tmp_path):
    """The items and the range of admissions are pushed into the parquet scan."""
    rows = [(i % 5, 100 + i % 50, 50_000 + i % 9, T0 + timedelta(minutes=i), float(i)) for i in range(400)] + [(1, None, 50_001, T0, 1.0)]
    labs = spark.createDataFrame(rows, "subject_id long, hadm_id long, itemid long, storetime timestamp_ntz, valuenum double")
    labs.write.parquet(str(tmp_path / "labs"))
    visits = spark.createDataFrame([(1, 111, 7), (2, 120, 8), (3, None, 9)], "subject_id long, hadm_id long, stay_id long")
    items = spark.createDataFrame([(50_002,), (50_004,), (50_002,)], "itemid long")
    found = events.wanted_labs(visits, spark.read.parquet(str(tmp_path / "labs")), items)
    assert sorted(r.valuenum for r in found.collect()) == [r[4] for r in rows if r[2] in (50_002, 50_004) and r[1] and 111 <= r[1] <= 120]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    again = events.wanted_labs(visits, spark.read.parquet(str(tmp_path / "labs")), items)
    plan = again._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "In(itemid, [50002,50004])" in pushed and "GreaterThanOrEqual(hadm_id,111)" in pushed and "LessThanOrEqual(hadm_id,120)" in pushed
    assert events.wanted_labs(visits.filter("hadm_id is null"), labs, items).count() == 0
    assert events.wanted_labs(visits, labs, items.filter("itemid < 0")).count() == 0


def test_drawn_episodes(spark):
    log = spark.createDataFrame(
        [(p, s, a, 0.5, p % 2) for p in range(10, 15) for s, a in ((0, 3), (1, 12 + p % 2))],
        "patient_id long, step int, action int, prob_pos double, label int",
    )
    drawn = policy.draw_patients(log, 400, seed=2)
    per = {r.drawn_from: r.n for r in drawn.groupBy("drawn_from").agg(F.count_distinct("patient_id").alias("n")).collect()}
    assert sum(per.values()) == 400 and set(per) == set(range(10, 15)) and all(50 < n < 110 for n in per.values())
    assert drawn.count() == 800
    assert drawn.exceptAll(policy.draw_patients(log.repartition(5), 400, seed=2)).count() == 0
    assert policy.draw_patients(log.filter("patient_id < 0"), 10).count() == 0


def test_actions_close_along_a_log(spark):
    log = spark.createDataFrame([(1, 0, 3, 0.1, 0), (1, 1, 3, 0.1, 0), (1, 2, 5, 0.1, 0), (1, 3, 12, 0.1, 0), (2, 0, 4, 0.1, 1)],
                                "patient_id long, step int, action int, prob_pos double, label int")
    patients = spark.createDataFrame([(1, [3, 4])], "patient_id long, lab_group_idx array<int>")
    rows = {(r.patient_id, r.step): r for r in policy.legal_along_log(log, patients).collect()}
    open_ = lambda p, s: [i for i, ok in enumerate(rows[p, s].legal) if ok]
    assert [open_(1, s) for s in range(4)] == [[3, 4, 12, 13], [4, 12, 13], [4, 12, 13], [4, 12, 13]]
    assert [rows[1, s].was_legal for s in range(4)] == [True, False, False, True]
    assert open_(2, 0) == [12, 13] and rows[2, 0].was_legal is False


def test_models_with_a_column_without_values(spark):
    from wardlake.operators import models

    rows = [(i, float(i % 7) if i % 3 else None, None, "x" if i % 2 else None, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c string, y int")
    model = models.fit_model(df, ["a", "b", "c"], "y", "logistic")
    got = models.predict(model, df, ["a", "b", "c"], "y", ["k"]).collect()
    assert sorted(r.k for r in got) == list(range(60)) and all(0 <= r.score <= 1 for r in got)


def test_bucketed_parts_join_without_a_shuffle(spark, tmp_path):
    from wardlake.plans import features

    keys = spark.range(200).withColumnRenamed("id", "stay_id")
    times = {c: F.lit(T0) for c in ("intime", "outtime", "intime_icu", "next_ed_visit_time")}
    parts = {"stay": keys.withColumns(times), "a": keys.withColumn("x", F.col("stay_id") * 2), "b": keys.filter("stay_id > 5").withColumn("y", F.lit(1))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = features.join_features(spark, features.write_features(parts, str(tmp_path), 6))
        rows = {r.stay_id: (r.x, r.y) for r in joined.collect()}
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {i: (2 * i, 1 if i > 5 else None) for i in range(200)}
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert len(list(tmp_path.glob("a/part-*"))) <= 6


def test_running_cost_keeps_rows_without_a_place(spark):
    rows = [(1, 0, 3, 0.1, 0), (1, 1, 12, 0.1, 0), (None, 0, 4, 0.2, 1), (2, None, 5, 0.2, 1)]
    log = spark.createDataFrame(rows, "patient_id long, step int, action int, prob_pos double, label int")
    got = {(r.patient_id, r.step): (r.spent is None, r.n_tests) for r in policy.running_cost(log).collect()}
    assert got == {(1, 0): (False, 1), (1, 1): (False, 1), (None, 0): (True, None), (2, None): (True, None)}
    assert {r.patient_id for r in policy.budget_stops(log).collect()} == {1}
