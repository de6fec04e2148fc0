import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlake.operators import history

T0 = datetime(2020, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def visits(spark, rows):
    """rows: (subject, stay, start hour, end hour)"""
    return spark.createDataFrame(
        [(s, k, at(a), at(b)) for s, k, a, b in rows],
        "subject_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz",
    )


def events(spark, rows):
    return spark.createDataFrame([(s, at(h)) for s, h in rows], "subject_id long, t timestamp_ntz")


def collected(df, key="stay_id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("strategy", ["window", "blocks"])
def test_counts_and_next_visit_against_brute_force(spark, strategy):
    rng = random.Random(5)
    # Subject 1 holds a third of all rows; hours repeat, so there are many ties.
    subjects = [1] * 60 + [rng.randint(2, 20) for _ in range(120)]
    rows = []
    for stay, s in enumerate(subjects):
        start = rng.randint(0, 24 * 20)
        rows.append((s, stay * 600_000, start, start + rng.randint(1, 60)))
    seen = [(s, rng.randint(0, 24 * 20)) for s in subjects for _ in range(3)]
    out = collected(
        history.visit_history(
            visits(spark, rows),
            past_visits={"n_ed_3d": 3, "n_ed_9d": 9},
            past_events={"adm": (events(spark, seen), "t", [2, 7])},
            next_visit=1,
            strategy=strategy,
        )
    )
    assert len(out) == len(rows)
    for s, k, a, b in rows:
        got = out[k]
        earlier = [r for r in rows if r[0] == s and (r[2], r[1]) < (a, k)]
        later = sorted((r[2], r[1]) for r in rows if r[0] == s and (r[2], r[1]) > (a, k))
        for d in (3, 9):
            assert got[f"n_ed_{d}d"] == sum(a - r[2] <= 24 * d for r in earlier)
        for d in (2, 7):
            assert got[f"n_adm_{d}d"] == sum(e == s and 0 < a - h <= 24 * d for e, h in seen)
        expected = at(later[0][0]) if later else None
        assert got["next_ed_visit_time"] == expected
        assert got["outcome_ed_revisit_1d"] == (bool(later) and later[0][0] - b < 24)
        assert got["next_ed_visit_time_diff"] == (expected - at(b) if later else None)


@pytest.mark.parametrize("strategy", ["window", "blocks"])
def test_edges_of_the_look_back(spark, strategy):
    rows = [(1, 1, 0, 1), (1, 2, 24, 25), (1, 3, 24, 30)]
    out = collected(
        history.visit_history(
            visits(spark, rows),
            past_visits={"n_1d": 1},
            past_events={"e": (events(spark, [(1, 24), (1, 0), (2, 3)]), "t", [1])},
            next_visit=1,
            strategy=strategy,
        )
    )
    # A gap of exactly the limit counts, the same instant counts only for visits before me.
    assert [out[k]["n_1d"] for k in (1, 2, 3)] == [0, 1, 2]
    assert [out[k]["n_e_1d"] for k in (1, 2, 3)] == [0, 1, 1]
    # A next visit before my end is a negative gap and true; exactly one day is not.
    assert out[2]["outcome_ed_revisit_1d"] is True
    assert out[1]["outcome_ed_revisit_1d"] is True
    assert out[3]["outcome_ed_revisit_1d"] is False
    late = collected(history.next_visit_outcome(visits(spark, [(1, 1, 0, 0), (1, 2, 24, 25)]), 1, strategy=strategy))
    assert late[1]["outcome_ed_revisit_1d"] is False


def test_counts_grow_with_the_look_back(spark):
    rows = [(i % 3, i, i * 30, i * 30 + 4) for i in range(60)]
    for r in history.past_visit_counts(visits(spark, rows), [1, 10, 100]).collect():
        assert r["n_ed_1d"] <= r["n_ed_10d"] <= r["n_ed_100d"]


def test_fill_from_subject(spark):
    rows = [
        (1, 1, 0, None), (1, 2, 1, "B"), (1, 3, 2, "A"), (1, 4, 3, "A"), (1, 5, 4, "B"),  # tie: B was first
        (2, 6, 0, None), (2, 7, 1, None),  # all missing
        (3, 8, 0, "C"), (3, 9, 1, None),
    ]
    df = spark.createDataFrame(
        [(s, k, at(h), e) for s, k, h, e in rows], "subject_id long, stay_id long, intime timestamp_ntz, ethnicity string"
    )
    out = collected(history.fill_from_subject(df, "ethnicity"))
    assert out[1]["ethnicity"] == "B" and out[3]["ethnicity"] == "A"
    assert out[6]["ethnicity"] is None and out[7]["ethnicity"] is None
    assert out[9]["ethnicity"] == "C"


def test_transfer_outcome(spark):
    stays = spark.createDataFrame(
        [(1, 10, 1, at(5)), (1, None, 2, at(5)), (2, 20, 3, at(5)), (2, 21, 4, at(5)), (3, 30, 5, at(5))],
        "subject_id long, hadm_id long, stay_id long, outtime timestamp_ntz",
    )
    icu = spark.createDataFrame(
        [(1, 10, at(17)), (1, 10, at(18)), (2, 20, at(1)), (2, 21, at(17.01)), (9, None, at(0))],
        "subject_id long, hadm_id long, intime timestamp_ntz",
    )
    out = collected(history.transfer_outcome(stays, icu, 12))
    assert [out[k]["outcome_icu_transfer_12h"] for k in (1, 2, 3, 4, 5)] == [True, False, True, False, False]
    assert out[3]["time_to_icu_transfer"] == timedelta(hours=-4)
    assert out[1]["intime_icu"] == at(17)


def test_wrong_strategy(spark):
    with pytest.raises(ValueError):
        history.past_visit_counts(visits(spark, [(1, 1, 0, 1)]), [1], strategy="other")


def test_strategy_switches_on_a_hot_group(spark):
    from wardlake.operators.prefix import pick_strategy

    df = spark.range(100).select((F.col("id") % 2).alias("g"))
    assert pick_strategy("auto", df, ["g"], limit=50) == "window"
    assert pick_strategy("auto", df, ["g"], limit=49) == "blocks"


def brute_history(rows, events, days, horizon):
    """Counts and the next start by comparing all rows; what has no place has no history."""
    placed = lambda r: r[0] is not None and r[2] is not None
    order = lambda r: (r[2], r[1] is not None, r[1] if r[1] is not None else 0)
    out = []
    for r in rows:
        n = sum(
            placed(r) and placed(o) and o[0] == r[0] and order(o) < order(r) and (r[2] - o[2]).total_seconds() <= days * 86400
            for o in rows
        )
        e = sum(
            placed(r) and s == r[0] and t is not None and 0 < (r[2] - t).total_seconds() <= days * 86400 for s, t in events
        )
        later = [o[2] for o in rows if placed(r) and placed(o) and o[0] == r[0] and (o[2] > r[2] or (o[2] == r[2] and order(o) > order(r)))]
        after = min(later, default=None)
        soon = after is not None and r[3] is not None and (after - r[3]).total_seconds() < horizon * 86400
        out.append((r[0], r[1], n, e, after, soon))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strategy", ["window", "blocks"])
@pytest.mark.parametrize("text_keys", [False, True])
def test_missing_repeated_and_text_keys(spark, strategy, text_keys):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    at = lambda h: None if h is None else start + timedelta(hours=h)
    base = [
        (1, 10, 0), (1, 11, 30), (1, 11, 30), (1, 12, 30), (1, 9, 200), (1, 13, None), (None, 14, 5), (None, 15, 5),
        (2, 16, 7), (2, 16, 7), (2, 17, 7), (2, 18, 7 + 24 * 30), (3, 19, 1),
    ]
    rows = [(s, f"k{k:03d}" if text_keys else k, at(t), at(None if t is None else t + 2)) for s, k, t in base]
    events = [(1, at(0)), (1, at(29)), (1, at(29)), (1, None), (None, at(3)), (2, at(7)), (2, at(6))]
    kind = "string" if text_keys else "long"
    visits = spark.createDataFrame(rows, f"subject_id long, stay_id {kind}, intime timestamp_ntz, outtime timestamp_ntz")
    seen = spark.createDataFrame(events, "subject_id long, at timestamp_ntz")
    got = history.visit_history(
        visits, past_visits={"n_ed_2d": 2}, past_events={"seen": (seen, "at", [2])}, next_visit=3, strategy=strategy
    )
    found = [(r.subject_id, r.stay_id, r.n_ed_2d, r.n_seen_2d, r.next_ed_visit_time, r.outcome_ed_revisit_3d) for r in got.collect()]
    assert sorted(found, key=repr) == brute_history(rows, events, 2, 3)


def test_tasks_follow_the_number_of_rows(spark, monkeypatch):
    """However few shuffle partitions the session has, a task of the time line gets about TASK_ROWS rows."""
    from wardlake.operators import prefix

    df = visits(spark, [(s, 10 * s + k, k * 3, k * 3 + 1) for s in range(30) for k in range(4)])
    plain = history.visit_history(df, past_visits={"n": 7}, next_visit=3)
    monkeypatch.setattr(prefix, "TASK_ROWS", 10)
    cut = history.visit_history(df, past_visits={"n": 7}, next_visit=3)
    assert cut.rdd.getNumPartitions() == 12
    assert sorted(cut.collect()) == sorted(plain.collect())
