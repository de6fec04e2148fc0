"""The master table by key and step by step."""

import re
import time

from pyspark.sql import functions as F
from wardlake import session
from wardlake.checks.derived import Derived
from wardlake.operators import events, history, joins, prefix
from wardlake.plans import master


def test_by_key_equals_step_by_step_and_moves_rows_less(spark, sf_dir):
    tables = dict(Derived(spark, sf_dir).tables)
    # Visits without a subject or an admission, too.
    tables["edstays"] = tables["edstays"].withColumn("subject_id", F.expr("CASE WHEN stay_id % 50 <> 0 THEN subject_id END"))
    by_key = master.build_master(tables, strategy="window")
    steps = master.build_master(tables, strategy="blocks")
    assert by_key.columns == steps.columns
    assert by_key.exceptAll(steps).isEmpty() and steps.exceptAll(by_key).isEmpty()
    # 22 shuffles when every step followed the one before.
    assert by_key._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 11


def test_fill_along_equals_the_join(spark):
    rows = [(1, 1, 5, "a"), (1, 2, 3, "b"), (1, 3, 1, None), (2, 4, 1, "a"), (2, 5, 2, "b"), (2, 6, 3, "b"), (2, 7, 4, None),
            (3, 8, 1, None), (None, 9, 1, "a"), (None, 10, 2, None)]
    visits = spark.createDataFrame(rows, "subject_id long, stay_id long, intime long, ethnicity string")
    filled = {r.stay_id: r.ethnicity for r in history.fill_from_subject(visits, "ethnicity", along=True).collect()}
    assert filled == {r.stay_id: r.ethnicity for r in history.fill_from_subject(visits, "ethnicity").collect()}
    assert (filled[3], filled[7], filled[8], filled[10]) == ("b", "b", None, None)


def exchanged(df, *keys):
    """Deals of the plan by all of ``keys``, in their order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(rf"Exchange hashpartitioning\({', '.join(rf'{k}#\d+L?' for k in keys)}, \d+\)", plan)


def test_written_rows_are_dealt_by_subject_once(spark, sf_dir, monkeypatch):
    """A wide row goes to its subject and stays there: no deal by admission or stay follows."""
    tables = Derived(spark, sf_dir).tables
    monkeypatch.setattr(prefix, "LEAST_ROWS", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with session.planned_with(spark, session.STAY_PUT):
            table = master.build_master(tables, strategy="window")
            assert not exchanged(table, "subject_id", "stay_id")
            # Bits of an admission are put together before they are dealt by subject.
            assert len(exchanged(table, "subject_id", "hadm_id")) == 1
        written = master.written_master(tables, strategy="window")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    steps = master.build_master(tables, strategy="blocks")
    assert written.columns == steps.columns
    assert written.exceptAll(steps).isEmpty() and steps.exceptAll(written).isEmpty()


def test_a_subject_with_many_readings_is_summed_up_by_stay(spark, sf_dir, monkeypatch):
    tables = Derived(spark, sf_dir).tables
    monkeypatch.setattr(events, "STAY_ROWS", 3)
    assert master.build_master(tables, strategy="window").exceptAll(master.build_master(tables, strategy="blocks")).isEmpty()


def test_writing_leaves_no_shuffle_files_and_no_settings(spark):
    """The shuffle files of a written frame and of counting jobs go when these end."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    start = files()
    rows = spark.range(0, 1000, 1, 4).selectExpr("id % 10 AS k", "id AS v")
    session.materialize(rows.groupBy("k").sum("v"))
    assert prefix.group_sizes(rows, ["k"]) == (100, 1000)
    assert joins._few_pairs(rows.filter("v < 20"), rows.filter("v < 50"), ["k"])
    until = time.time() + 20
    while files() - start and time.time() < until:
        time.sleep(0.2)
    assert not files() - start
    assert spark.conf.get(next(iter(session.RELEASE)), "false") == "false"
