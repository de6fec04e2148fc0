import pytest

from wardlake.operators import policy


def log(spark):
    rows = [
        (1, 0, 0, 0.1, 1), (1, 1, 4, 0.2, 1), (1, 2, 13, 0.9, 1),  # 30, 4, positive
        (2, 0, 12, 0.3, 0),  # diagnosis at once
        (3, 0, 1, 0.4, 1), (3, 1, 11, 0.5, 1), (3, 2, 12, 0.6, 1), (3, 3, 2, 0.7, 1),  # 60, 178, missed; a late step
    ]
    return policy.until_diagnosis(
        spark.createDataFrame(rows, "patient_id long, step long, action int, prob_pos double, label int")
    )


def test_running_cost(spark):
    got = {(r["patient_id"], r["step"]): (r["spent"], r["n_tests"]) for r in policy.running_cost(log(spark)).collect()}
    assert got == {(1, 0): (30, 1), (1, 1): (34, 2), (1, 2): (34, 2), (2, 0): (0, 0), (3, 0): (60, 1), (3, 1): (238, 2), (3, 2): (238, 2)}


def test_budget_stops(spark):
    got = {
        (r["budget"], r["patient_id"]): (r["prob"], r["predicted"], r["n_tests"])
        for r in policy.budget_stops(log(spark), [0, 30, 34, 100]).collect()
    }
    assert got[(0, 1)] == (0.1, False, 0)
    assert got[(30, 1)] == (0.2, False, 1)  # 30 is paid exactly, the next test is not
    assert got[(34, 1)] == (0.9, True, 2)
    assert got[(0, 2)] == (0.3, False, 0)
    assert got[(100, 3)] == (0.5, False, 1)


def test_report(spark):
    patients = spark.createDataFrame([(1, [0, 4]), (2, [3]), (3, [1, 11])], "patient_id long, lab_group_idx array<int>")
    r = policy.policy_report(log(spark), patients).first()
    assert r["n_patients"] == 3 and r["mean_tests"] == pytest.approx(4 / 3)
    assert r["mean_cost"] == pytest.approx((34 + 0 + 238) / 3)
    # Tests of a patient's own panels cost their number in total; one ill patient was missed.
    assert r["mean_reward"] == pytest.approx((-2 - 2 - 99 * 15) / 3)
    assert r["f1"] == pytest.approx(2 / 3)
    assert r["auroc"] == 1.0


def test_action_distribution(spark):
    got = {r["panel"]: r["n"] for r in policy.action_distribution(log(spark)).collect()}
    assert got == {"CBC": 1, "LACTATE": 1, "CHEM": 1, "INFLAMMATION": 1}


def test_costs_only_grow_with_the_budget(spark):
    counts = policy.within_budget(log(spark)).groupBy("budget").count().orderBy("budget").collect()
    values = [r["count"] for r in counts]
    assert values == sorted(values)
