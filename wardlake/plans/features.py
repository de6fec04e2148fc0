"""The master table from narrow feature tables that lie side by side.

Each part has one row per stay and its own columns only, so no shuffle carries the wide
row: histories move subject, stay and times; flags a subject's codes; readings a stay's.
Parts are written as tables bucketed by stay, one file a bucket, and the final join finds
every stay's rows in the same bucket: it needs no shuffle, and a part can be built again
alone. ``stay_id`` must be unique.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions import outcomes
from ..functions.parse import complaint_flags
from ..operators import codes, events, history, joins
from ..operators.comorbidity_groups import prefix_dimension
from ..operators.prefix import strategy_and_rows
from .master import LOOKBACKS


def feature_parts(
    tables: Mapping[str, DataFrame],
    dimension: DataFrame | None = None,
    icu_hours: int = 12,
    revisit_days: int = 3,
    lookback_days: int = codes.LOOKBACK_DAYS,
    strategy: str = "auto",
) -> dict[str, DataFrame]:
    """Part name -> one row per stay with ``stay_id`` and the part's columns; ``stay`` holds the visits themselves."""
    visits = tables["edstays"]
    strategy, rows = strategy_and_rows(strategy, "subject_id", *[tables[t] for t in ("edstays", "admissions", "icustays")])
    stay = joins.with_admissions(joins.with_patients(visits, tables["patients"]), tables["admissions"])
    stay = outcomes.add_ed_los(outcomes.add_inhospital_mortality(outcomes.add_age(stay)))
    stay = outcomes.add_hospitalization(history.transfer_outcome(stay, tables["icustays"], icu_hours))
    stay = history.fill_from_subject(outcomes.add_critical(stay, icu_hours), "ethnicity")

    timeline = history.visit_history(
        visits.select("subject_id", "stay_id", "intime", "outtime"),
        past_visits={f"n_ed_{d}d": d for d in LOOKBACKS},
        past_events={
            "hosp": (tables["admissions"], "admittime", LOOKBACKS),
            "icu": (tables["icustays"], "intime", LOOKBACKS),
        },
        next_visit=revisit_days,
        strategy=strategy,
        rows=rows,
    ).drop("subject_id", "intime", "outtime")

    dimension = prefix_dimension(visits.sparkSession) if dimension is None else dimension
    asked = visits.select("subject_id", "stay_id", "intime")
    flags = codes.comorbidity_flags(asked, tables["diagnoses_icd"], tables["admissions"], dimension, lookback_days)
    keys = visits.select("subject_id", "stay_id")
    medication = events.merge_medication_count(visits.select("stay_id"), tables["pyxis"], "n_med")
    return {
        "stay": stay,
        "timeline": timeline,
        "flags": flags.drop("subject_id", "intime"),
        "triage": complaint_flags(joins.with_triage(keys, tables["triage"])).drop("subject_id"),
        "vitals": events.merge_vital_summaries(keys, tables["vitalsign"], ["last"]).drop("subject_id"),
        "medication": events.merge_medication_count(medication, tables["medrecon"], "n_medrecon", fill_from=None),
    }


def write_features(parts: Mapping[str, DataFrame], out: str, buckets: int | None = None) -> dict[str, str]:
    """Writes every part below ``out`` as a table bucketed by stay; returns the names of the tables."""
    names = {}
    for part, rows in parts.items():
        spark = rows.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        names[part] = f"wardlake_{part}_{uuid.uuid4().hex}"
        # Dealt as the buckets are, so each task writes the one file of its bucket.
        dealt = rows.repartition(buckets, "stay_id")
        writer = dealt.write.format("parquet").option("path", f"{out.rstrip('/')}/{part}")
        writer.bucketBy(buckets, "stay_id").sortBy("stay_id").saveAsTable(names[part])
    return names


def join_features(spark: SparkSession, names: Mapping[str, str]) -> DataFrame:
    """The master table from the tables of :func:`write_features`."""
    rows = spark.table(names["stay"])
    for part, name in names.items():
        if part != "stay":
            rows = rows.join(spark.table(name), "stay_id", "left")
    return outcomes.add_numeric_spans(rows)


def build_master_from_features(tables: Mapping[str, DataFrame], out: str, buckets: int | None = None, **options) -> DataFrame:
    """:func:`master.build_master` by way of bucketed parts below ``out``."""
    names = write_features(feature_parts(tables, **options), out, buckets)
    return join_features(tables["edstays"].sparkSession, names)
