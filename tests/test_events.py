from datetime import datetime, timedelta

import pandas as pd
import pytest

from wardlake.operators import events, joins, prefix

T0 = datetime(2020, 1, 1, 10, 7)
minute = lambda m: T0 + timedelta(minutes=m)


def readings(spark, rows):
    return spark.createDataFrame(
        [(1, s, minute(m), hr, pain) for s, m, hr, pain in rows],
        "subject_id long, stay_id long, charttime timestamp_ntz, ed_heartrate double, ed_pain double",
    )


def test_summaries_skip_missing_per_column(spark):
    df = readings(spark, [(1, 0, None, 3.0), (1, 5, 80.0, None), (1, 9, 90.0, 1.0), (1, 9, 95.0, 0.0), (2, 0, None, None)])
    out = {r["stay_id"]: r for r in events.vital_summaries(df, ["first", "last", "max", "min", "mean", "median"]).collect()}
    one = out[1]
    assert (one["ed_heartrate_first"], one["ed_heartrate_last"]) == (80.0, 95.0)
    assert (one["ed_pain_first"], one["ed_pain_last"]) == (3.0, 1.0)
    assert (one["ed_heartrate_max"], one["ed_heartrate_min"], one["ed_heartrate_median"]) == (95.0, 80.0, 90.0)
    assert out[2]["ed_heartrate_last"] is None
    with pytest.raises(ValueError):
        events.vital_summaries(df, ["mode"])


def test_medication_counts(spark):
    stays = spark.createDataFrame([(1,), (2,)], "stay_id long")
    meds = spark.createDataFrame([(1, "5", "a"), (1, None, "a"), (1, "5", "b"), (1, None, "c")], "stay_id long, gsn string, name string")
    both = events.merge_medication_count(stays, meds, "n")
    assert {r["stay_id"]: r["n"] for r in both.collect()} == {1: 3, 2: 0}
    coded = events.merge_medication_count(stays, meds, "n", fill_from=None)
    assert {r["stay_id"]: r["n"] for r in coded.collect()} == {1: 1, 2: 0}


def labs(spark, rows):
    return spark.createDataFrame(
        [(1, 7, i, minute(m), v) for i, m, v in rows],
        "subject_id long, hadm_id long, itemid long, storetime timestamp_ntz, valuenum double",
    )


def dimension(spark):
    rows = [(1, "glucose", "chem", 1, (-5, 1)), (2, "wbc", "cbc", 0, (-9, 2)), (3, "rbc", "cbc", 0, (-1, 3))]
    return spark.createDataFrame(
        rows, "itemid long, label string, grouping string, group_idx int, rank struct<neg_frequency:long,itemid:long>"
    )


def stays(spark):
    return spark.createDataFrame(
        [(1, 7, 100, minute(0), minute(60)), (1, 7, 101, minute(100), minute(3000)), (1, None, 102, minute(0), minute(60))],
        "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz",
    )


def test_labs_on_the_edges_count(spark):
    rows = labs(spark, [(1, 0, 5.0), (2, 60, 6.0), (3, 61, 7.0), (3, 2999, 8.0), (9, 30, 1.0), (1, 30, None)])
    out = events.stay_labs(stays(spark), rows, dimension(spark)).collect()
    assert sorted((r["stay_id"], r["itemid"]) for r in out) == [(100, 1), (100, 2), (101, 3)]


def test_repeated_items_drop_the_stay(spark):
    rows = labs(spark, [(1, 0, 5.0), (1, 1, 6.0), (3, 200, 7.0), (1, 201, 4.0)])
    single = events.single_measures(events.stay_labs(stays(spark), rows, dimension(spark)))
    lists = {r["stay_id"]: (r["lab_measure"], r["lab_results"]) for r in events.lab_lists(single).collect()}
    assert lists == {101: ([1, 3], [4.0, 7.0])}


def test_pivot_and_group_order(spark):
    rows = labs(spark, [(1, 0, 5.0), (3, 1, 6.0)])
    single = events.single_measures(events.stay_labs(stays(spark), rows, dimension(spark)))
    row = events.lab_pivot(single, dimension(spark), ["wbc", "rbc", "glucose"]).first()
    assert (row["wbc"], row["rbc"], row["glucose"]) == (0.0, 6.0, 5.0)
    # glucose is used more often than rbc, so its group comes first.
    assert row["lab_group_idx"] == [1, 0]


def test_interval_join_against_brute_force(spark):
    spans = spark.createDataFrame([(k % 2, k, minute(k * 700), minute(k * 700 + 4000)) for k in range(12)], "g long, k long, a timestamp_ntz, z timestamp_ntz")
    points = spark.createDataFrame([(m % 2, m, minute(m * 331)) for m in range(60)], "g long, m long, t timestamp_ntz")
    out = joins.events_within(spans, points, ["g"], "a", "z", "t").collect()
    expected = sorted((k, m) for k in range(12) for m in range(60) if k % 2 == m % 2 and k * 700 <= m * 331 <= k * 700 + 4000)
    assert sorted((r["k"], r["m"]) for r in out) == expected


def test_hourly_series_against_pandas(spark):
    rows = [
        (1, 0, None, 1.0), (1, 53, 10.0, None), (1, 150, 20.0, 5.0), (1, 190, None, None), (1, 260, None, 6.0),
        (2, 3, 70.0, None),
        (3, 0, 60.0, 2.0), (3, 60, 66.0, None), (3, 125, 71.0, 4.0),
        (4, 0, None, None), (4, 130, None, 3.0), (4, 200, 9.0, 3.0),
    ]
    expected = {}
    for stay in (1, 2, 3, 4):
        frame = pd.DataFrame(
            {"hr": [r[2] for r in rows if r[0] == stay], "pain": [r[3] for r in rows if r[0] == stay]},
            index=pd.DatetimeIndex([minute(r[1]) for r in rows if r[0] == stay]), dtype=float,
        )
        fine = frame.resample("1min", origin="start").asfreq().interpolate(method="linear")
        hourly = fine.resample("1h", origin="start").asfreq().ffill().bfill()
        for t, r in hourly.iterrows():
            expected[(stay, t.to_pydatetime())] = tuple(None if pd.isna(v) else round(v, 9) for v in (r["hr"], r["pain"]))
    out = events.hourly_series(readings(spark, rows), ["ed_heartrate", "ed_pain"]).collect()
    got = {
        (r["stay_id"], r["charttime"]): tuple(None if v is None else round(v, 9) for v in (r["ed_heartrate"], r["ed_pain"]))
        for r in out
    }
    assert got == expected


def test_hourly_series_ignores_off_grid_readings(spark):
    df = readings(spark, [(1, 0, 10.0, None), (1, 30.5, 99.0, None), (1, 120, 30.0, None)])
    assert [r["ed_heartrate"] for r in events.hourly_series(df, ["ed_heartrate"]).orderBy("step").collect()] == [10.0, 20.0, 30.0]


def test_summaries_deal_readings_once(spark, monkeypatch):
    """One shuffle, tasks by the number of readings, and the same rows with stays too large for a buffer."""
    rows = [(s, m, None if m % 5 == s % 5 else float(m * 7 % 11), None if m % 3 else float(m)) for s in range(40) for m in range(s % 7 + 1)]
    rows += [(99, i // 2, float(i * 31 % 17), float("nan") if i % 2 else None) for i in range(60)] + [(None, 3, 1.0, 2.0), (None, 4, 2.0, None)]
    df = readings(spark, rows)
    options = ["first", "last", "max", "min", "mean", "median"]
    shown = lambda out: sorted(repr(r) for r in out.collect())
    monkeypatch.setattr(prefix, "TASK_ROWS", 20)
    once = events.vital_summaries(df, options)
    assert once.rdd.getNumPartitions() == -(-len(rows) // 20)
    plan = events.vital_summaries(df, options)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    want = shown(once)
    for limit in (0, 1, 7):
        monkeypatch.setattr(events, "STAY_ROWS", limit)
        assert shown(events.vital_summaries(df, options)) == want


def test_series_deals_readings_once(spark, monkeypatch):
    """One shuffle, tasks by the number of readings, and the same steps by blocks."""
    rows = [(s, m * (31 + s), None if m % 3 == 0 else float(m), float(s) if m % 4 == 1 else None) for s in range(30) for m in range(s % 6 + 1)]
    df = readings(spark, [*rows, (None, 0, 1.0, 1.0)])
    series = lambda: events.hourly_series(df, ["ed_heartrate", "ed_pain"])
    monkeypatch.setattr(prefix, "TASK_ROWS", 10)
    once = series()
    plan = series()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and once.rdd.getNumPartitions() == -(-len(rows) // 10)
    monkeypatch.setattr(events, "STAY_ROWS", 0)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, series().collect()))


def test_interval_join_moves_rows_once(spark, monkeypatch):
    """Keys with few pairs are joined as a whole, with the rows of the join by blocks."""
    spans = spark.createDataFrame([(k % 9, k, minute(k * 700), minute(k * 700 + 4000)) for k in range(20)], "g long, k long, a timestamp_ntz, z timestamp_ntz")
    points = spark.createDataFrame([(m % 9 or None, m, minute(m * 331)) for m in range(90)], "g long, m long, t timestamp_ntz")
    join = lambda: joins.events_within(spans, points, ["g"], "a", "z", "t")
    plain = join()
    assert "Generate" not in plain._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(joins, "KEY_PAIRS", 1)
    blocks = join()
    assert "Generate" in blocks._jdf.queryExecution().executedPlan().toString()
    assert plain.columns == blocks.columns and plain.count() > 0
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, blocks.collect()))


def test_last_vitals_of_stays_are_dealt_once(spark, monkeypatch):
    """Tasks of the last readings follow their number, also where the session has few shuffle partitions."""
    rows = [(s, m, float(m), None if m == 2 else float(s)) for s in range(30) for m in range(3)]
    monkeypatch.setattr(prefix, "TASK_ROWS", 9)
    assert events.vital_summaries(readings(spark, rows), ["last"]).rdd.getNumPartitions() == 10
    visits = spark.createDataFrame([(1, s) for s in range(31)], "subject_id long, stay_id long")
    out = events.merge_vital_summaries(visits, readings(spark, rows), ["last"]).collect()
    got = {r.stay_id: (r.ed_heartrate_last, r.ed_pain_last) for r in out}
    assert got == {s: (2.0, float(s)) if s < 30 else (None, None) for s in range(31)}


def test_last_readings_need_no_sort(spark):
    """Buffers of ``first`` and ``last`` hold plain numbers, so the aggregation is hashed; the greatest of one instant is last."""
    rows = [(s, m // 2, float(m), None if m == 3 else float(m)) for s in range(5) for m in range(4)]
    out = events.vital_summaries(readings(spark, rows), ["first", "last"])
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.ed_heartrate_first, r.ed_heartrate_last, r.ed_pain_first, r.ed_pain_last) for r in out.collect()}
    assert got == {(0.0, 3.0, 0.0, 2.0)}
