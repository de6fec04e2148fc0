"""Nine tables -> one row per stay."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions import outcomes
from ..functions.parse import COMPLAINTS, complaint_flags
from ..operators import codes, events, history, joins
from ..operators.comorbidity_groups import prefix_dimension
from ..operators.prefix import group_sizes, strategy_and_rows, task_count
from ..session import STAY_PUT, materialize
from ..sources.sinks import write_code_index, write_table
from ..sources.tables import FOLDERS, load

LOOKBACKS = (30, 90, 365)
MASTER_TABLES = [t for t in FOLDERS if t != "labevents"]


def load_tables(spark: SparkSession, root: str, extension: str = "csv") -> dict[str, DataFrame]:
    return {t: load(spark, root, t, extension) for t in MASTER_TABLES}


def build_master(
    tables: Mapping[str, DataFrame],
    dimension: DataFrame | None = None,
    icu_hours: int = 12,
    revisit_days: int = 3,
    lookback_days: int = codes.LOOKBACK_DAYS,
    strategy: str = "auto",
) -> DataFrame:
    """The master table.

    Where every subject fits a task, steps that share a key stand next to each other and
    a row stays narrow (:func:`_by_key`). With a larger subject the steps follow one by one.
    """
    # Asked on the raw tables: one narrow scan each, before any join.
    timed = [tables[name] for name in ("edstays", "admissions", "icustays")]
    strategy, rows = strategy_and_rows(strategy, "subject_id", *timed)
    dimension = prefix_dimension(timed[0].sparkSession) if dimension is None else dimension
    if strategy == "window":
        return _by_key(tables, dimension, icu_hours, revisit_days, lookback_days, rows)
    stays = joins.with_patients(tables["edstays"], tables["patients"])
    stays = joins.with_admissions(stays, tables["admissions"])
    stays = outcomes.add_age(stays)
    stays = outcomes.add_inhospital_mortality(stays)
    stays = outcomes.add_ed_los(stays)
    stays = history.transfer_outcome(stays, tables["icustays"], icu_hours)
    stays = outcomes.add_hospitalization(stays)
    stays = outcomes.add_critical(stays, icu_hours)

    stays = history.fill_from_subject(stays, "ethnicity")
    stays = history.visit_history(
        stays,
        **_time_line(tables, revisit_days),
        strategy=strategy,
        rows=rows,
    )
    stays = outcomes.add_numeric_spans(stays)

    stays = codes.comorbidity_flags(stays, tables["diagnoses_icd"], tables["admissions"], dimension, lookback_days)

    stays = complaint_flags(joins.with_triage(stays, tables["triage"]))
    stays = events.merge_vital_summaries(stays, tables["vitalsign"], ["last"])
    stays = events.merge_medication_count(stays, tables["pyxis"], "n_med")
    return events.merge_medication_count(stays, tables["medrecon"], "n_medrecon", fill_from=None)


def written_master(tables: Mapping[str, DataFrame], **options) -> DataFrame:
    """:func:`build_master`, written once for all later reads.

    Its rows are dealt by subject, and while it is planned, joins by subject and stay or admission may leave them there.
    """
    return materialize(build_master(tables, **options), STAY_PUT)


def _time_line(tables: Mapping[str, DataFrame], revisit_days: int) -> dict:
    return {
        "past_visits": {f"n_ed_{d}d": d for d in LOOKBACKS},
        "past_events": {
            "hosp": (tables["admissions"], "admittime", LOOKBACKS),
            "icu": (tables["icustays"], "intime", LOOKBACKS),
        },
        "next_visit": revisit_days,
    }


def _by_key(
    tables: Mapping[str, DataFrame], dimension: DataFrame, icu_hours: int, revisit_days: int, lookback_days: int, rows: int
) -> DataFrame:
    """:func:`build_master` where every subject fits a task.

    Medication comes first, while a row is narrow. Then visits and all side tables are dealt by
    subject to one number of tasks, so a wide row moves once: joins by admission and by stay
    hold the subject, too, and find their rows in the same task. Look-backs start from the visits
    themselves, so nothing joined so far is made again. Flags stay bits up to the
    end, which keeps a row below the number of columns that Spark compiles.
    """
    visits, readings = tables["edstays"], tables["vitalsign"]
    most, total = group_sizes(readings.select("subject_id"), ["subject_id"])
    rows = max(rows, total)
    tasks = task_count(visits, rows)
    deal = lambda df: df.repartition(tasks, "subject_id")

    counted = events.merge_medication_count(visits, tables["pyxis"], "n_med")
    counted = events.merge_medication_count(counted, tables["medrecon"], "n_medrecon", fill_from=None)
    line = history.visit_history(counted, **_time_line(tables, revisit_days), strategy="window", rows=rows, along=True)

    stays = joins.with_admissions(line, deal(tables["admissions"]))
    stays = history.transfer_outcome(stays, tables["icustays"], icu_hours, deal=deal)
    stays = joins.with_patients(stays, deal(tables["patients"]))
    stays = history.fill_from_subject(stays, "ethnicity", along=True)

    masks = codes.comorbidity_masks(
        visits.select("subject_id", "stay_id", "intime"), tables["diagnoses_icd"], tables["admissions"], dimension, lookback_days,
        deal=deal,
    )
    if most <= events.STAY_ROWS:
        summaries = events.vital_summaries(deal(readings), ["last"], along=True)
    else:
        summaries = deal(events.vital_summaries(readings, ["last"]))
    wide = stays.join(masks, ["subject_id", "stay_id"], "left")
    wide = joins.with_triage(wide, deal(tables["triage"]))
    wide = wide.join(summaries, ["subject_id", "stay_id"], "left")
    outcome_steps = (
        outcomes.add_age, outcomes.add_inhospital_mortality, outcomes.add_ed_los, outcomes.add_hospitalization,
        lambda df: outcomes.add_critical(df, icu_hours), outcomes.add_numeric_spans, complaint_flags,
    )
    for step in outcome_steps:
        wide = step(wide)
    return wide.select(*_column_order(tables, wide.columns, line.columns, summaries.columns))


def _column_order(tables, made: list[str], line: list[str], summaries: list[str]) -> list:
    """Visits, their side tables, outcomes, time line, flags, and the per-stay tables, as the joins by key leave them."""
    flags = codes.flag_names(("charlson", "elixhauser"))
    counts = ["n_med", "n_medrecon"]
    visits = ["stay_id", "subject_id", "hadm_id", *tables["edstays"].columns]
    timed = [c for c in line if c not in (*visits, *counts)]
    per_stay = [*tables["triage"].columns, *COMPLAINTS, *summaries, *counts]
    patients = [c for c in made if c in tables["patients"].columns and c not in visits]
    masks = [c for c in made if c.startswith("_mask_")]
    spans = ["ed_los_hours", "time_to_icu_transfer_hours", "next_ed_visit_time_diff_days"]
    late = {*timed, *spans, *per_stay, *masks}
    transfer = [c for c in made if c in ("intime_icu", "time_to_icu_transfer") or c.startswith("outcome_icu_transfer_")]
    early = [c for c in made if c not in (*late, *transfer)]
    after = early.index("ed_los") + 1
    first = dict.fromkeys([*visits, *patients, *early[:after], *transfer, *early[after:]])
    return [*first, *timed, *spans, *codes.flags_of_masks(flags), *[c for c in per_stay if c not in first]]


def build_code_lists(
    tables: Mapping[str, DataFrame],
    maps: Mapping[str, DataFrame],
    lookback_days: int = codes.LOOKBACK_DAYS,
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Code lists and indexes of the three variants; ``maps``: ``9to10`` and ``10to9`` code maps."""
    unique = {name: codes.unique_code_map(m) for name, m in maps.items()}
    dated = codes.dated_diagnoses(tables["diagnoses_icd"], tables["admissions"])
    return codes.lookback_lists(tables["edstays"], dated, unique, list(codes.LIST_VARIANTS), lookback_days)


def write_master(spark: SparkSession, root: str, out: str, extension: str = "csv", fmt: str = "parquet", **options) -> None:
    tables = load_tables(spark, root, extension)
    write_table(build_master(tables, **options), f"{out.rstrip('/')}/master_dataset", fmt)


def write_code_lists(lists: Mapping[str, tuple[DataFrame, DataFrame]], out: str, fmt: str = "parquet") -> None:
    for variant, (rows, index) in lists.items():
        write_table(rows, f"{out.rstrip('/')}/icd_list_dataset_{variant}", fmt)
        write_code_index(index, f"{out.rstrip('/')}/icd_encode_map_{variant}", fmt)
