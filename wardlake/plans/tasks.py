"""The prediction tasks: which visits, which variables, which outcome."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import discharged, ed_minutes
from ..functions.parse import COMPLAINTS
from ..operators.comorbidity_groups import CCI_FLAGS, ECI_FLAGS
from ..operators.metrics import evaluate_scores
from ..operators.models import fit_model, predict
from ..operators.splits import class_ratio
from ..session import materialize

HISTORY = [f"n_{what}_{days}d" for what in ("ed", "hosp", "icu") for days in (30, 90, 365)]
TRIAGE = [f"triage_{v}" for v in ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp")]
LAST_VITALS = [f"ed_{v}_last" for v in ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp")]
#: Elixhauser flags that repeat a Charlson flag stay out of the variable lists.
_REPEATED = {"CHF", "PVD", "Paralysis", "Pulmonary", "DM1", "DM2", "Renal", "Liver", "PUD", "HIV", "Tumor2", "Tumor1", "Rheumatic"}
EXTRA_ECI = [f for f in ECI_FLAGS if f.removeprefix("eci_") not in _REPEATED]

TRIAGE_VARIABLES = [
    "age", "gender", *HISTORY, *TRIAGE, "triage_pain", "triage_acuity", *COMPLAINTS, *CCI_FLAGS, *EXTRA_ECI,
]
DISPOSITION_VARIABLES = [
    "age", "gender", *HISTORY, "triage_pain", "triage_acuity", *COMPLAINTS, *CCI_FLAGS, *EXTRA_ECI,
    *LAST_VITALS, "ed_los", "n_med", "n_medrecon",
]


def everyone(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Task:
    name: str
    outcome: str
    variables: Sequence[str]
    cohort: Callable[[DataFrame], DataFrame] = everyone


TASKS = {
    t.name: t
    for t in (
        Task("hospitalization_at_triage", "outcome_hospitalization", TRIAGE_VARIABLES),
        Task("critical_at_triage", "outcome_critical", TRIAGE_VARIABLES),
        Task("revisit_at_disposition", "outcome_ed_revisit_3d", DISPOSITION_VARIABLES, discharged),
        Task("critical_at_disposition", "outcome_critical", DISPOSITION_VARIABLES),
    )
}


def task_rows(df: DataFrame, task: Task, wrap_days: bool = True) -> DataFrame:
    """The task's cohort; ``ed_los`` becomes minutes where it is a variable."""
    rows = task.cohort(df)
    if "ed_los" in task.variables:
        rows = rows.withColumn("ed_los", ed_minutes(wrap_days))
    return rows


def run_task(train: DataFrame, test: DataFrame, task: Task, kind: str, key: str = "stay_id", replicates: int = 20, seed: int = 0, **params):
    """Fits one model on the train cohort and evaluates it on the test cohort.

    The predictions are written once, since the metrics read them several times.
    """
    train, test = task_rows(train, task), task_rows(test, task)
    model = fit_model(train, task.variables, task.outcome, kind, seed, **params)
    scored = materialize(predict(model, test, task.variables, task.outcome, [key]))
    result = evaluate_scores(scored, ["score"], "label", key, replicates, seed)
    return model, result.withColumn("group", F.lit(kind))


def task_ratio(train: DataFrame, task: Task) -> DataFrame:
    return class_ratio(task_rows(train, task), task.outcome)
