"""Whole plans: master table, training rows, prediction tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outcomes
from ..functions.parse import COMPLAINTS
from ..operators import codes, joins, models, splits
from ..operators.comorbidity_groups import CCI_FLAGS, ECI_FLAGS
from ..plans import features, master, tasks, training
from ..session import checkpoint_dir, materialize
from ..sources.sinks import write_code_index, write_parts, write_table
from ..sources.tables import conform, parse_list_text, read_table
from .clinical import _clamp_sql, _score_sql
from .coding import _HITS, _RECENT, _flag_sql
from .derived import MAP_10_TO_9, Derived, with_tables
from .readings import V, _summary_sql, small_master
from .registry import query
from .visits import _ICU, _NEXT, _PAST, _PAST_HOSP, _PAST_ICU, LOOKBACKS

COUNTS = [f"n_{w}_{n}d" for w in ("ed", "hosp", "icu") for n in LOOKBACKS]
_MASTER = {
    **_ICU, **_PAST, **_PAST_HOSP, **_PAST_ICU, **_HITS,
    "recent": _RECENT,
    "flags": f"""SELECT e.stay_id, {_flag_sql('charlson')}, {_flag_sql('elixhauser')} FROM edstays e
      LEFT JOIN recent USING (stay_id) LEFT JOIN hits USING (icd_code, icd_version) GROUP BY e.stay_id""",
    "vit": "SELECT subject_id, stay_id, " + ", ".join(_summary_sql("last", c) for c in V) + " FROM vitalsign GROUP BY ALL",
    "med": "SELECT stay_id, count(DISTINCT coalesce(gsn, name)) AS n_med, count(DISTINCT gsn) AS n_medrecon FROM pyxis GROUP BY 1",
    "best": """SELECT subject_id, ethnicity AS usual FROM (
        SELECT subject_id, ethnicity, count(*) AS n, min(epoch_us(intime)) AS t FROM edstays JOIN admissions USING (subject_id, hadm_id)
        WHERE ethnicity IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, t) = 1""",
    "base": f"""SELECT *, {_NEXT} AS next_in FROM edstays LEFT JOIN patients USING (subject_id)
      LEFT JOIN admissions USING (subject_id, hadm_id) LEFT JOIN first_icu USING (subject_id, hadm_id)""",
    "master": "SELECT b.stay_id, b.subject_id, CAST(year(intime) - anchor_year + anchor_age AS INTEGER) AS age, gender, "
    "coalesce(ethnicity, usual) AS ethnicity, hadm_id IS NOT NULL AS outcome_hospitalization, "
    "coalesce(dod IS NOT NULL AND dischtime >= dod, FALSE) OR coalesce(intime_icu - outtime <= INTERVAL 12 HOUR, FALSE) AS outcome_critical, "
    "coalesce(next_in - outtime < INTERVAL 3 DAY, FALSE) AS outcome_ed_revisit_3d, "
    "coalesce(dod IS NOT NULL AND dischtime >= dod, FALSE) AS outcome_inhospital_mortality, "
    "coalesce(intime_icu - outtime <= INTERVAL 12 HOUR, FALSE) AS outcome_icu_transfer_12h, "
    "round((epoch_us(outtime) - epoch_us(intime)) / 3600000000.0::DOUBLE, 2) AS ed_los_hours, "
    "round((epoch_us(intime_icu) - epoch_us(outtime)) // 60000000 / 60.0::DOUBLE, 2) AS time_to_icu_transfer_hours, "
    "sign((epoch_us(next_in) - epoch_us(outtime)) // 60000000) * ((abs((epoch_us(next_in) - epoch_us(outtime)) // 60000000) * 200 + 1440) // 2880)"
    " / 100.0::DOUBLE AS next_ed_visit_time_diff_days, "
    + ", ".join(COUNTS + CCI_FLAGS + ECI_FLAGS + [f"{c}_last" for c in V])
    + ", triage_temperature, triage_heartrate, triage_resprate, triage_o2sat, triage_sbp, triage_dbp, triage_pain, triage_acuity, "
    + ", ".join(f"coalesce(regexp_matches(chiefcomplaint, '(?i){p}'), FALSE) AS {n}" for n, p in COMPLAINTS.items())
    + """, coalesce(n_med, 0) AS n_med, coalesce(n_medrecon, 0) AS n_medrecon
      FROM base b LEFT JOIN best USING (subject_id) JOIN past_ed USING (stay_id) JOIN past_hosp USING (stay_id) JOIN past_icu USING (stay_id)
      JOIN flags USING (stay_id) LEFT JOIN triage USING (subject_id, stay_id) LEFT JOIN vit USING (subject_id, stay_id) LEFT JOIN med USING (stay_id)""",
}
_MASTER_NEEDS = ("edstays", "patients", "admissions", "icustays", "triage", "vitalsign", "pyxis", "dated")
_MASTER_COLUMNS = [
    "stay_id", "subject_id", "age", "gender", "ethnicity", "outcome_hospitalization", "outcome_critical", "outcome_ed_revisit_3d",
    "outcome_inhospital_mortality", "outcome_icu_transfer_12h", "ed_los_hours", "time_to_icu_transfer_hours",
    "next_ed_visit_time_diff_days", *COUNTS, *CCI_FLAGS, *ECI_FLAGS, *[f"{c}_last" for c in V], "triage_temperature",
    "triage_heartrate", "triage_resprate", "triage_o2sat", "triage_sbp", "triage_dbp", "triage_pain", "triage_acuity",
    *COMPLAINTS, "n_med", "n_medrecon",
]


@query("master_dataset", with_tables(*_MASTER_NEEDS, extra=_MASTER, body="SELECT * FROM master"))
def master_dataset(d: Derived):
    return master.build_master(d.tables).select(*_MASTER_COLUMNS)


@query("master_from_features", with_tables(*_MASTER_NEEDS, extra=_MASTER, body="SELECT * FROM master"))
def master_from_features(d: Derived):
    """The same table from narrow parts that are bucketed by stay."""
    import uuid

    out = f"{checkpoint_dir(d.spark).rstrip('/')}/features-{uuid.uuid4().hex}"
    return features.build_master_from_features(d.tables, out).select(*_MASTER_COLUMNS)


@query("task_cohorts", with_tables(*_MASTER_NEEDS, extra=_MASTER, body=" UNION ALL ".join(
    f"""SELECT '{t.name}' AS task, count(*) FILTER ({t.outcome}) AS n_positive, count(*) FILTER (NOT {t.outcome}) AS n_negative,
      count(*) FILTER ({t.outcome}) / count(*) FILTER (NOT {t.outcome})::DOUBLE AS ratio FROM master
      WHERE {'NOT outcome_hospitalization' if t.cohort is outcomes.discharged else 'TRUE'}""" for t in tasks.TASKS.values())))
def task_cohorts(d: Derived):
    rows = master.written_master(d.tables)
    out = None
    for task in tasks.TASKS.values():
        ratio = tasks.task_ratio(rows, task).withColumn("task", F.lit(task.name))
        out = ratio if out is None else out.unionByName(ratio)
    return out


_TT = {
    "m": """SELECT e.stay_id, year(intime) - anchor_year + anchor_age AS age, t.* EXCLUDE (subject_id, stay_id)
      FROM edstays e LEFT JOIN patients USING (subject_id) LEFT JOIN triage t USING (subject_id, stay_id)""",
    "clean": "SELECT stay_id, " + ", ".join(_clamp_sql(f"triage_{v}", v) for v in ("heartrate", "resprate", "o2sat", "sbp", "dbp"))
    + """, ('0x' || substr(md5('10:' || stay_id), 1, 8))::BIGINT % 1000000 < 800000 AS train
      FROM m WHERE age >= 18 AND triage_acuity IS NOT NULL""",
    "filled": "SELECT stay_id, train, " + ", ".join(
        f"coalesce(triage_{v}, (SELECT median(triage_{v}) FROM clean WHERE train)) AS triage_{v}"
        for v in ("heartrate", "resprate", "o2sat", "sbp", "dbp")) + " FROM clean",
}


@query("train_test_rows", with_tables("edstays", "patients", "triage", extra=_TT, body=f"""
    SELECT stay_id, CASE WHEN train THEN 'train' ELSE 'test' END AS part, triage_heartrate, triage_resprate, triage_o2sat, triage_sbp,
      triage_dbp FROM filled"""))
def train_test_rows(d: Derived):
    parts = training.train_test(small_master(d), with_scores=False)
    columns = ["stay_id", *[f"triage_{v}" for v in ("heartrate", "resprate", "o2sat", "sbp", "dbp")]]
    pick = lambda name: parts[name].select(*columns).withColumn("part", F.lit(name))
    return pick("train").unionByName(pick("test"))


_SCORED_VITALS = ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp")
_SCORE_NAMES = ("CCI", "CART", "REMS", "NEWS", "NEWS2", "MEWS")
_STT = {
    "m": """SELECT e.stay_id, year(intime) - anchor_year + anchor_age AS age,
        t.* EXCLUDE (subject_id, stay_id) REPLACE ((triage_temperature - 32) * (5.0::DOUBLE / 9) AS triage_temperature)
      FROM edstays e LEFT JOIN patients USING (subject_id) LEFT JOIN triage t USING (subject_id, stay_id)""",
    "clean": "SELECT stay_id, age, " + ", ".join(_clamp_sql(f"triage_{v}", v) for v in _SCORED_VITALS)
    + """, ('0x' || substr(md5('10:' || stay_id), 1, 8))::BIGINT % 1000000 < 800000 AS train
      FROM m WHERE age >= 18 AND triage_acuity IS NOT NULL""",
    "filled": "SELECT stay_id, age, " + ", ".join(
        f"coalesce(triage_{v}, (SELECT median(triage_{v}) FROM clean WHERE train)) AS triage_{v}" for v in _SCORED_VITALS
    ) + ", " + ", ".join(f"(stay_id % {k + 3} = 0)::INTEGER AS {c}" for k, c in enumerate(CCI_FLAGS)) + " FROM clean",
    "ready": "SELECT *, triage_sbp * 1 / 3 + triage_dbp * 2 / 3 AS triage_MAP FROM filled",
}


@query("scored_train_test", with_tables("edstays", "patients", "triage", extra=_STT, body="SELECT stay_id, " + ", ".join(
    map(_score_sql, _SCORE_NAMES)) + " FROM ready"))
def scored_train_test(d: Derived):
    flags = {c: F.expr(f"cast(stay_id % {k + 3} = 0 as int)") for k, c in enumerate(CCI_FLAGS)}
    parts = training.train_test(small_master(d).withColumns(flags))
    names = ["stay_id", *[f"score_{n}" for n in _SCORE_NAMES]]
    return parts["train"].select(*names).unionByName(parts["test"].select(*names))


@query("split_files", with_tables("edstays", "patients", "triage", extra=_TT, body="""
    SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(stay_id)::BIGINT AS keys FROM filled GROUP BY 1"""))
def split_files(d: Derived):
    """Train and test rows written part by part and read back."""
    import uuid

    out = f"{checkpoint_dir(d.spark).rstrip('/')}/parts-{uuid.uuid4().hex}"
    write_parts(training.train_test(small_master(d), with_scores=False), out)
    rows = None
    for name in ("train", "test"):
        part = read_table(d.spark, f"{out}/{name}").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("stay_id").alias("keys"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("training_texts")
def training_texts(d: Derived):
    """Labs and master table to anonymous rows, split, and their texts."""
    rows = master.written_master(d.tables)
    single = training.lab_results(rows, d.labevents, d.lab_items)
    parts = training.training_parts(training.lab_master(rows, single, d.lab_items))
    texts = None
    for name, part in parts.items():
        out = training.row_texts(training.label_rows(part, "outcome_critical"), "</s>").select(
            F.lit(name).alias("part"), "label", "lab_group_idx", "text"
        )
        texts = out if texts is None else texts.unionByName(out)
    return texts


# ---- sinks --------------------------------------------------------------------------


@query("csv_and_parquet_sinks", """
    SELECT o_custkey, count(*)::INTEGER AS n, max(o_totalprice) AS top, min(o_totalprice) AS low FROM orders GROUP BY o_custkey""")
def csv_and_parquet_sinks(d: Derived):
    """Per-customer distinct prices as arrays, through CSV text and through parquet."""
    import uuid

    folder = f"{checkpoint_dir(d.spark).rstrip('/')}/sinks-{uuid.uuid4().hex}"
    spread = d.table("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.array(F.min("o_totalprice"), F.max("o_totalprice")).alias("ends")
    )
    write_table(spread, f"{folder}/csv", "csv")
    back = read_table(d.spark, f"{folder}/csv", fmt="csv").select(
        F.col("o_custkey").cast("long"), F.col("n").cast("int"), parse_list_text("ends").alias("ends")
    )
    write_table(back, f"{folder}/parquet")
    rows = read_table(d.spark, f"{folder}/parquet")
    return rows.select("o_custkey", "n", F.element_at("ends", 2).alias("top"), F.element_at("ends", 1).alias("low"))


@query("code_index_sink", """
    SELECT p_name AS code, row_number() OVER (ORDER BY p_name) - 1 AS code_idx FROM (SELECT DISTINCT p_name FROM part)""")
def code_index_sink(d: Derived):
    import uuid

    path = f"{checkpoint_dir(d.spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    write_code_index(codes.code_index(d.table("part"), "p_name"), path)
    return read_table(d.spark, path)


@query("csv_schema_read", """
    SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, epoch_us(o_orderdate) AS in_us FROM orders""")
def csv_schema_read(d: Derived):
    from ..functions.clock import micros

    text = d.table("orders").selectExpr(
        "cast(o_orderkey as string) AS hadm_id", "cast(o_custkey as string) AS subject_id", "cast(o_orderdate as string) AS intime"
    )
    return conform(text, "icustays").select("subject_id", "hadm_id", micros("intime").alias("in_us"))


# ---- models -------------------------------------------------------------------------

DOC_VARIABLES = ["n_chars", "lang", "source"]
DOC_TASK = tasks.Task("document_quality", "quality", DOC_VARIABLES)


def _documents(d: Derived):
    rows = d.table("labels").join(d.table("documents"), "doc_id").select(
        "doc_id", F.col("n_chars").cast("double"), "lang", "source", F.col("quality").cast("boolean").alias("quality")
    )
    return splits.split_parts(rows, "doc_id", test_seed=10, valid_seed=None)


def _register_model(kind: str, **params) -> None:
    @query(f"model_{kind}")
    def build(d: Derived):
        parts = _documents(d)
        _, result = tasks.run_task(parts["train"], parts["test"], DOC_TASK, kind, "doc_id", **params)
        return result


_register_model("logistic")
_register_model("forest")
_register_model("boosting")
_register_model("perceptron")


@query("model_rows", """
    SELECT doc_id, quality::INTEGER AS label, TRUE AS in_range FROM labels
    WHERE ('0x' || substr(md5('10:' || doc_id), 1, 8))::BIGINT % 1000000 >= 800000""")
def model_rows(d: Derived):
    """A prediction has every row of the test part once, also those with missing inputs."""
    parts = _documents(d)
    holes = lambda df: df.withColumn("n_chars", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")))
    model = models.fit_model(holes(parts["train"]), DOC_VARIABLES, "quality", "logistic")
    result = models.predict(model, holes(parts["test"]), DOC_VARIABLES, "quality", ["doc_id"])
    return result.select("doc_id", "label", F.col("score").between(0, 1).alias("in_range"))


_TEST_DOCS = "SELECT * FROM labels WHERE ('0x' || substr(md5('10:' || doc_id), 1, 8))::BIGINT % 1000000 >= 800000"
_KINDS = {"forest": {"numTrees": 10, "maxDepth": 5}, "boosting": {"maxIter": 5}, "perceptron": {"maxIter": 10}}


def _in_range():
    return F.min(F.col("score").between(0, 1) & ~F.isnan("score")).alias("in_range")


@query("model_kinds", " UNION ALL ".join(
    f"SELECT '{k}' AS model, count(*) AS n, sum(quality)::BIGINT AS n_positive, count(DISTINCT doc_id) AS n_keys, TRUE AS in_range FROM ({_TEST_DOCS})"
    for k in _KINDS))
def model_kinds(d: Derived):
    """Each kind of model scores every row of the test part once, with probabilities."""
    parts = {k: materialize(p) for k, p in _documents(d).items()}
    out = None
    for kind, params in _KINDS.items():
        model = models.fit_model(parts["train"], DOC_VARIABLES, "quality", kind, **params)
        result = models.predict(model, parts["test"], DOC_VARIABLES, "quality", ["doc_id"])
        row = result.agg(
            F.lit(kind).alias("model"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"),
            F.count_distinct("doc_id").alias("n_keys"), _in_range(),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("importance_shares", """
    SELECT v AS variable, TRUE AS in_range, 1::DOUBLE AS total FROM (VALUES ('n_chars'), ('lang'), ('source')) t(v)""")
def importance_shares(d: Derived):
    """Importances are shares: every variable has one, and they add up to 1."""
    parts = _documents(d)
    model = models.fit_model(parts["train"], DOC_VARIABLES, "quality", "forest", numTrees=10, maxDepth=5)
    ranked = models.importance_ranking(model, DOC_VARIABLES, parts["train"])
    total = ranked.agg(F.round(F.sum("importance"), 9).alias("total"))
    return ranked.select("variable", F.col("importance").between(0, 1).alias("in_range")).join(total)


@query("task_models", with_tables(*_MASTER_NEEDS, extra={**_MASTER, "test": """SELECT * FROM master
    WHERE ('0x' || substr(md5('10:' || stay_id), 1, 8))::BIGINT % 1000000 >= 800000"""}, body=" UNION ALL ".join(
    f"""SELECT '{t.name}' AS task, count(*) AS n, sum({t.outcome}::INTEGER)::BIGINT AS n_positive, count(DISTINCT stay_id) AS n_keys, TRUE AS in_range
      FROM test WHERE {'NOT outcome_hospitalization' if t.cohort is outcomes.discharged else 'TRUE'}""" for t in tasks.TASKS.values())))
def task_models(d: Derived):
    """The four prediction tasks on the master table: fitted on train, every test row of the cohort scored."""
    parts = splits.split_parts(master.written_master(d.tables), "stay_id", test_seed=10, valid_seed=None)
    out = None
    for task in tasks.TASKS.values():
        train, test = (tasks.task_rows(parts[p], task) for p in ("train", "test"))
        model = models.fit_model(train, task.variables, task.outcome, "logistic")
        result = models.predict(model, test, task.variables, task.outcome, ["stay_id"])
        row = result.agg(
            F.lit(task.name).alias("task"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"),
            F.count_distinct("stay_id").alias("n_keys"), _in_range(),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("importance_ranking")
def importance_ranking(d: Derived):
    parts = _documents(d)
    model = models.fit_model(parts["train"], DOC_VARIABLES, "quality", "forest")
    return models.importance_ranking(model, DOC_VARIABLES, parts["train"])


@query("model_with_code_lists")
def model_with_code_lists(d: Derived):
    """Hospitalisation from age, gender and the codes of earlier discharges."""
    dated = codes.dated_diagnoses(d.diagnoses, d.admissions)
    lists, _ = codes.code_lists(d.edstays, dated, codes.unique_code_map(d.code_map(MAP_10_TO_9)), "v9_3digit")
    rows = outcomes.add_hospitalization(outcomes.add_age(joins.with_patients(d.edstays, d.patients)))
    rows = codes.merge_code_lists(rows, lists).select("stay_id", "age", "gender", "icd_list", "outcome_hospitalization")
    parts = splits.split_parts(rows, "stay_id", written=True, test_seed=10, valid_seed=None)
    ratio = splits.class_ratio(parts["train"], "outcome_hospitalization").first()["ratio"]
    model = models.fit_model(
        parts["train"], ["age", "gender"], "outcome_hospitalization", "logistic", code_list="icd_list", positive_weight=ratio
    )
    return models.predict(model, parts["test"], ["age", "gender"], "outcome_hospitalization", ["stay_id"])


