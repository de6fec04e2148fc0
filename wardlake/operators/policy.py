"""Evaluation of logged test-ordering episodes.

The log has one row per step: ``patient_id, step, action, prob_pos, label``; actions 0-11
order a panel (each at most once), 12 and 13 end the episode with a diagnosis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import legal_actions, personal_costs, price_array, step_reward
from ..functions.panels import N_PANELS, PANEL_PRICES, POSITIVE
from ..session import materialize
from .codes import code_index
from .metrics import confusion, cumulative, long_scores, ranking_metrics
from .prefix import null_safe, running_totals

# Budgets of the cost curve.
BUDGETS = list(range(0, 700, 50))
#: Steps per block of the running cost.
STEP_BITS = 12


def until_diagnosis(log: DataFrame) -> DataFrame:
    """Steps up to and with the first diagnosis; an episode has no later ones."""
    ends = log.filter(F.col("action") >= N_PANELS).groupBy("patient_id").agg(F.min("step").alias("_end"))
    return log.join(ends, "patient_id", "left").filter(F.col("_end").isNull() | (F.col("step") <= F.col("_end"))).drop("_end")


def raw_price(action: str = "action") -> Column:
    """List price of a test step, 0 for a diagnosis."""
    return F.when(F.col(action) < N_PANELS, F.get(price_array(), F.col(action))).otherwise(0.0)


def running_cost(log: DataFrame) -> DataFrame:
    """Adds ``cost``, ``spent`` (list prices up to and with this step) and ``n_tests`` so far.

    Rows without a patient or a step stay, with NULL totals: they have no place in an episode.
    """
    priced = log.withColumn("cost", raw_price()).withColumn("n", (F.col("action") < N_PANELS).cast("int"))
    totals = running_totals(
        priced, ["patient_id"], "step", ["cost", "n"], F.shiftright(F.col("step").cast("long"), STEP_BITS)
    )
    spent = totals.select(
        "patient_id",
        "step",
        (F.col("cost_before") + F.col("cost")).alias("spent"),
        (F.col("n_before") + F.col("n")).alias("n_tests"),
    )
    return null_safe(priced.drop("n"), spent, ["patient_id", "step"], "left")


def within_budget(log: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """Test steps that are still paid for, per budget; the test that breaks the budget is not."""
    tests = running_cost(log).filter(F.col("action") < N_PANELS)
    budget = F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget")
    return tests.select(budget, "*").filter(F.col("spent") <= F.col("budget"))


def action_distribution(log: DataFrame) -> DataFrame:
    """How often each panel was ordered."""
    names = F.array(*[F.lit(n) for n in PANEL_PRICES])
    tests = log.filter(F.col("action") < N_PANELS)
    return tests.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(
        "action", F.get(names, F.col("action")).alias("panel"), "n"
    )


def logged_rewards(log: DataFrame, patients: DataFrame) -> DataFrame:
    """Adds the reward of every step; ``patients`` has ``patient_id, lab_group_idx``."""
    costs = patients.select("patient_id", personal_costs("lab_group_idx").alias("_costs"))
    joined = log.join(costs, "patient_id", "left")
    known = F.coalesce("_costs", price_array())
    return joined.withColumn(
        "reward", step_reward(F.col("action"), F.col("label").cast("boolean"), known)
    ).drop("_costs")


def episodes(log: DataFrame) -> DataFrame:
    """One row per patient: label, diagnosis probability and prediction, cost and number of tests.

    Without a diagnosis step the probability and the prediction stay 0.
    """
    ends = F.col("action") >= N_PANELS
    return log.groupBy("patient_id").agg(
        F.max(F.col("label").cast("int")).alias("label"),
        F.coalesce(F.min_by("prob_pos", F.when(ends, F.col("step"))), F.lit(0.0)).alias("prob"),
        F.coalesce(F.min_by("action", F.when(ends, F.col("step"))) == POSITIVE, F.lit(False)).alias("predicted"),
        F.sum(raw_price()).alias("cost"),
        F.count_if(~ends).alias("n_tests"),
    )


def policy_report(log: DataFrame, patients: DataFrame) -> DataFrame:
    """One row: F1, areas, operating point, and reward, cost and tests per patient.

    The episodes are written once, as three results read them.
    """
    log = until_diagnosis(log)
    per_patient = materialize(episodes(log))
    ranking = ranking_metrics(cumulative(long_scores(per_patient, ["prob"], "label"))).drop("n_positive", "n_negative")
    counts = confusion(
        per_patient.withColumn("group", F.lit("prob")), F.col("predicted"), F.col("label") == 1, ["group"]
    )
    means = per_patient.agg(
        F.lit("prob").alias("group"),
        F.count(F.lit(1)).alias("n_patients"),
        F.avg("cost").alias("mean_cost"),
        F.avg("n_tests").alias("mean_tests"),
    )
    rewards = logged_rewards(log, patients).agg(F.lit("prob").alias("group"), F.sum("reward").alias("_reward"))
    joined = means.join(rewards, "group").join(counts, "group").join(ranking, "group")
    return joined.select(
        "n_patients", "f1", "auroc", "ap", "sensitivity", "specificity", "threshold",
        (F.col("_reward") / F.col("n_patients")).alias("mean_reward"), "mean_cost", "mean_tests",
    )


def budget_stops(log: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """Per patient and budget the step at which the episode ends: a diagnosis, or the first unpaid test.

    At an unpaid test the prediction is negative and the probability is the step's own.
    Rows without a patient or a step belong to no episode.
    """
    costed = running_cost(until_diagnosis(log.filter(F.col("patient_id").isNotNull() & F.col("step").isNotNull())))
    budget = F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget")
    is_test = F.col("action") < N_PANELS
    paid = F.col("spent") <= F.col("budget")
    rows = costed.select(budget, "patient_id", "step", "action", "prob_pos", "label", "spent")
    ends = F.when(~is_test | ~paid, F.col("step"))
    return rows.groupBy("budget", "patient_id").agg(
        F.max(F.col("label").cast("int")).alias("label"),
        F.coalesce(F.min_by("prob_pos", ends), F.lit(0.0)).alias("prob"),
        F.coalesce(F.min_by("action", ends) == POSITIVE, F.lit(False)).alias("predicted"),
        F.count_if(is_test & paid).alias("n_tests"),
    )


def budget_curve(log: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """Metrics and mean number of tests at every budget."""
    stops = materialize(budget_stops(log, budgets))
    scored = long_scores(stops, ["prob"], "label", keep=["budget"])
    ranking = ranking_metrics(cumulative(scored, ["budget"]), ["budget"])
    counts = confusion(stops, F.col("predicted"), F.col("label") == 1, ["budget"]).select("budget", "f1")
    tests = stops.groupBy("budget").agg(F.avg("n_tests").alias("mean_tests"))
    return ranking.join(counts, "budget").join(tests, "budget").select(
        "budget", "f1", "auroc", "ap", "sensitivity", "specificity", "threshold", "mean_tests"
    )


def draw_patients(log: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """The log of ``draws`` episodes whose patients are drawn with replacement.

    ``patient_id`` becomes the number of the draw and ``drawn_from`` the patient. Patients
    are numbered in order (:func:`codes.code_index`), and a hash of (seed, draw) picks a
    number, so draws repeat on any partitioning and no list of patients is collected.
    """
    numbered = code_index(log, "patient_id").select(F.col("code").alias("drawn_from"), "code_idx")
    total = numbered.count()
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)
    picked = log.sparkSession.range(1, draws + 1).select(F.col("id").alias("draw"), F.floor(share * total).alias("code_idx"))
    chosen = picked.join(numbered, "code_idx").drop("code_idx")
    return log.withColumnRenamed("patient_id", "drawn_from").join(chosen, "drawn_from").withColumnRenamed("draw", "patient_id")


def drawn_policy_report(log: DataFrame, patients: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """:func:`policy_report` over drawn episodes: each draw is an episode of its own."""
    log = materialize(draw_patients(log, draws, seed))
    who = log.select("patient_id", "drawn_from").distinct()
    own = who.join(patients.withColumnRenamed("patient_id", "drawn_from"), "drawn_from").drop("drawn_from")
    return policy_report(log.drop("drawn_from"), own)


def legal_along_log(log: DataFrame, patients: DataFrame) -> DataFrame:
    """Adds ``legal``, the 14 booleans of the actions open before each step, and ``was_legal`` of the step taken.

    ``patients`` has ``patient_id, lab_group_idx``; panels ordered in earlier steps are closed.
    A patient orders each of the panels once, so what a step looks back on stays short.
    """
    first = log.filter(F.col("action") < N_PANELS).groupBy("patient_id", "action").agg(F.min("step").alias("step"))
    done = first.groupBy("patient_id").agg(F.collect_list(F.struct("step", "action")).alias("_done"))
    joined = log.join(patients, "patient_id", "left").join(done, "patient_id", "left")
    earlier = F.transform(F.filter("_done", lambda d: d["step"] < F.col("step")), lambda d: d["action"])
    none = F.array().cast("array<int>")
    mask = legal_actions(F.coalesce("lab_group_idx", none), F.coalesce(earlier, none))
    out = joined.withColumn("legal", mask).withColumn("was_legal", F.get("legal", F.col("action")))
    return out.select(*log.columns, "legal", "was_legal")
