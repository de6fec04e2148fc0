"""Master table -> cleaned train and test rows; labs -> anonymous training rows and their texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import outcomes, scores, text, vitals
from ..functions.panels import LAB_LABELS, PANELS, panel_feature_numbers
from ..operators import events, joins, splits
from ..operators.comorbidity_groups import CCI_FLAGS
from ..session import STAY_PUT, materialize
from .tasks import EXTRA_ECI, HISTORY, TRIAGE

RECORD = [
    "age", "gender", *HISTORY, *CCI_FLAGS, *EXTRA_ECI, *TRIAGE, "triage_pain", "triage_acuity", "chiefcomplaint",
]
OUTCOMES = ["outcome_critical", "outcome_ed_los", "lab_group_idx"]


def clean_cohort(master: DataFrame) -> DataFrame:
    """Adults with an acuity, temperatures in Celsius, outliers removed."""
    cohort = outcomes.with_acuity(outcomes.adults(master))
    return vitals.remove_outliers(vitals.to_celsius(cohort))


def train_test(master: DataFrame, key: str = "stay_id", seed: int = 10, with_scores: bool = True) -> dict[str, DataFrame]:
    """Clean, split 80/20, impute medians of the train rows, add the risk scores.

    The cleaned rows are written once: the medians and both parts read them.
    """
    parts = splits.split_parts(materialize(clean_cohort(master)), key, test_seed=seed, valid_seed=None)
    medians = splits.fit_medians(parts["train"], vitals.family_columns(parts["train"]))
    filled = {name: splits.fill_medians(part, medians) for name, part in parts.items()}
    if not with_scores:
        return filled
    return {name: scores.add_scores(vitals.add_map(part)) for name, part in filled.items()}


def lab_results(master: DataFrame, labs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (stay, item, value) of hospitalized stays without repeated items."""
    return events.single_measures(events.stay_labs(outcomes.hospitalized(master), labs, items))


def lab_master(
    master: DataFrame,
    single: DataFrame,
    items: DataFrame,
    labels: Sequence[str] = tuple(LAB_LABELS),
    fit_on: str = "all",
    key: str = "stay_id",
    seed: int = 42,
) -> DataFrame:
    """Visit record + lab columns of the stays with labs, cleaned and imputed.

    ``fit_on='all'`` takes the medians over all rows, ``'train'`` over the train rows only.
    """
    pivot = events.lab_pivot(single, items, labels)
    rows = joins.keep_right(outcomes.hospitalized(master), pivot, events.STAY_KEYS)
    cleaned = materialize(clean_cohort(rows), STAY_PUT)
    columns = vitals.family_columns(cleaned, skip=("acuity",))
    if fit_on == "all":
        base = cleaned
    elif fit_on == "train":
        base = cleaned.filter(splits.split_name(key, test_seed=seed) == "train")
    else:
        raise ValueError("fit_on must be 'all' or 'train'")
    return outcomes.add_long_stay(splits.fill_medians(cleaned, splits.fit_medians(base, columns)))


def training_rows(lab_rows: DataFrame, key: str = "stay_id", labels: Sequence[str] = tuple(LAB_LABELS)) -> DataFrame:
    """``feature1`` ... plus the outcomes; the key stays for the split and is dropped by the writer."""
    return splits.anonymous_columns(vitals.round_temperature(lab_rows), [*RECORD, *labels], [*OUTCOMES, key])


def training_parts(lab_rows: DataFrame, key: str = "stay_id") -> dict[str, DataFrame]:
    parts = splits.split_parts(training_rows(lab_rows, key), key)
    return {name: part.drop(key) for name, part in parts.items()}


def label_rows(df: DataFrame, task: str) -> DataFrame:
    """The outcome as 0/1 and the lab groups as an integer array, also when they were read as text."""
    groups = F.col("lab_group_idx")
    if df.schema["lab_group_idx"].dataType.simpleString() == "string":
        groups = F.from_json(groups, "array<int>")
    return df.withColumns({"label": F.col(task).cast("boolean").cast("int"), "lab_group_idx": groups.cast("array<int>")})


def row_texts(rows: DataFrame, end_mark: str, record: int = len(RECORD)) -> DataFrame:
    """Adds ``parts`` (segments) and ``text`` to anonymous training rows."""
    names = [f"feature{i}" for i in range(1, record + 1)]
    panels = [[f"feature{i}" for i in numbers] for numbers in panel_feature_numbers(record + 1)]
    with_parts = rows.withColumn("parts", text.segments(rows, names, panels, "lab_group_idx"))
    return with_parts.withColumn("text", text.segmented_row_text(F.col("parts"), end_mark))


__all__ = [
    "RECORD", "OUTCOMES", "PANELS", "clean_cohort", "train_test", "lab_results", "lab_master",
    "training_rows", "training_parts", "label_rows", "row_texts",
]
