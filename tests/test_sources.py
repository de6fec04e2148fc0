import csv
from datetime import datetime

from wardlake.functions.panels import PANEL_GROUPS
from wardlake.operators.comorbidity_groups import CCI_FLAGS
from wardlake.plans import master, training
from wardlake.sources import sinks, tables


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


def make_root(root):
    write(root / "ed/edstays.csv", ["subject_id", "hadm_id", "stay_id", "intime", "outtime", "gender", "race", "disposition"], [
        [1, 11, 101, "2180-01-05 10:00:00", "2180-01-05 20:30:00", "F", "X", "HOME"],
        [1, "", 102, "2180-01-20 10:00:00", "2180-01-20 11:00:00", "F", "X", "HOME"],
        [2, 21, 201, "2181-03-01 00:00:00", "2181-03-02 12:00:00", "M", "X", "ADMITTED"],
    ])
    write(root / "hosp/patients.csv", ["subject_id", "gender", "anchor_age", "anchor_year", "dod"], [
        [1, "F", 50, 2178, ""], [2, "M", 80, 2181, "2181-03-05"],
    ])
    write(root / "hosp/admissions.csv", ["subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "insurance", "race", "edregtime", "edouttime"], [
        [1, 11, "2180-01-05 19:00:00", "2180-01-08 09:00:00", "", "Other", "WHITE", "", ""],
        [2, 21, "2181-03-02 11:00:00", "2181-03-05 00:00:00", "", "Other", "", "", ""],
    ])
    write(root / "icu/icustays.csv", ["subject_id", "hadm_id", "intime", "outtime"], [[2, 21, "2181-03-03 00:00:00", "2181-03-04 00:00:00"]])
    write(root / "ed/triage.csv", ["subject_id", "stay_id", "temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "acuity", "chiefcomplaint"], [
        [1, 101, 98.6, 80, 16, 99, 120, 80, "7-8", 2, "Chest pain, nausea"],
        [1, 102, "", "", "", "", "", "", "unable", 3, ""],
        [2, 201, 101.3, 120, 24, 90, 95, 55, "3", 1, "Syncope"],
    ])
    write(root / "ed/vitalsign.csv", ["subject_id", "stay_id", "charttime", "temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "rhythm", "pain"], [
        [1, 101, "2180-01-05 11:00:00", 98.0, 81, 17, 98, 121, 81, "", 2],
        [1, 101, "2180-01-05 12:00:00", "", 82, "", 97, 122, "", "", "bad"],
    ])
    write(root / "ed/pyxis.csv", ["subject_id", "stay_id", "charttime", "name", "gsn"], [[1, 101, "2180-01-05 11:00:00", "a", "1"], [1, 101, "2180-01-05 11:00:00", "b", ""]])
    write(root / "ed/medrecon.csv", ["subject_id", "stay_id", "charttime", "name", "gsn"], [[1, 101, "2180-01-05 11:00:00", "a", "1"], [1, 101, "2180-01-05 11:00:00", "b", ""]])
    write(root / "hosp/diagnoses_icd.csv", ["subject_id", "hadm_id", "icd_code", "icd_version"], [
        [1, 11, "I501", 10], [1, 11, "2504", 9], [2, 21, "I21", 10],
    ])
    write(root / "hosp/labevents.csv", ["subject_id", "hadm_id", "itemid", "charttime", "storetime", "valuenum"], [
        [1, 11, 1, "2180-01-05 11:00:00", "2180-01-05 11:30:00", 5.5], [1, 11, 2, "2180-01-05 11:00:00", "2180-01-05 20:30:00", 7],
        [2, 21, 1, "2181-03-01 00:00:00", "2181-03-01 01:00:00", 1], [2, 21, 1, "2181-03-01 00:00:00", "2181-03-01 02:00:00", 2],
    ])


def test_csv_tables_to_master_and_training_rows(spark, tmp_path):
    make_root(tmp_path)
    data = master.load_tables(spark, str(tmp_path))
    rows = {r["stay_id"]: r for r in master.build_master(data).collect()}
    assert len(rows) == 3
    first, second, other = rows[101], rows[102], rows[201]
    assert (first["age"], first["gender"], first["ethnicity"]) == (52, "F", "WHITE")
    assert second["ethnicity"] == "WHITE" and other["ethnicity"] is None
    assert (first["n_ed_30d"], second["n_ed_30d"], second["n_hosp_30d"]) == (0, 1, 1)
    assert first["next_ed_visit_time"] == datetime(2180, 1, 20, 10) and first["outcome_ed_revisit_3d"] is False
    assert first["next_ed_visit_time_diff_days"] == 14.56 and first["ed_los_hours"] == 10.5
    # The code of the first admission counts for the second stay, and only there.
    assert (second["cci_CHF"], second["cci_DM2"], second["eci_CHF"]) == (1, 1, 1)
    assert sum(first[f] for f in CCI_FLAGS) == 0 and sum(other[f] for f in CCI_FLAGS) == 0
    assert other["outcome_inhospital_mortality"] is True and other["outcome_icu_transfer_12h"] is True
    assert first["outcome_critical"] is False and second["outcome_hospitalization"] is False
    assert (first["triage_pain"], second["triage_pain"], first["ed_pain_last"]) == (7.5, None, 2.0)
    assert (first["ed_heartrate_last"], first["ed_temperature_last"]) == (82.0, 98.0)
    assert (first["n_med"], first["n_medrecon"], other["n_med"]) == (2, 1, 0)
    assert first["chiefcom_chest_pain"] and first["chiefcom_nausea_vomiting"] and not second["chiefcom_cough"]

    items = spark.createDataFrame(
        [(1, "Glucose (Chemistry)", 1, 50, "chem"), (2, "Hematocrit", 1, 90, "cbc"), (3, "Other", 0, 5, "cbc")],
        "itemid long, label string, ed_labs int, frequency long, grouping string",
    )
    dimension = tables.lab_dimension(items, PANEL_GROUPS)
    assert dimension.count() == 2
    table = master.build_master(data)
    labs = tables.load(spark, str(tmp_path), "labevents")
    single = training.lab_results(table, labs, dimension)
    done = training.lab_master(table, single, dimension, fit_on="train")
    row = done.collect()
    assert len(row) == 1 and row[0]["hematocrit"] == 7.0 and row[0]["lab_group_idx"] == [0, 1]
    assert row[0]["triage_temperature"] == (98.6 - 32) * (5 / 9)
    texts = training.row_texts(training.label_rows(training.training_rows(done), "outcome_critical"), "</s>").first()
    assert texts["text"].startswith("feature1 : 52 | feature2 : F | ") and texts["text"].count("</s>") == 3
    assert "feature56 : 7.0" in texts["text"] and "feature47 : 37.0" in texts["text"]
    assert texts["label"] == 0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.sql("SELECT 1L AS id, array(1, 2) AS g, timestamp_ntz'2020-01-02 00:00:00' - timestamp_ntz'2020-01-01 00:00:00' AS span")
    sinks.write_table(df, str(tmp_path / "c"), "csv")
    back = tables.read_table(spark, str(tmp_path / "c"), fmt="csv").first()
    assert back["g"] == "[1,2]"
    sinks.write_table(df, str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p")).first()["g"] == [1, 2]
    index = spark.createDataFrame([("a", 0)], "code string, code_idx long")
    sinks.write_code_index(index, str(tmp_path / "i"))
    assert tables.read_table(spark, str(tmp_path / "i")).count() == 1


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert [r["x"] for r in tables.nan_to_null(df).orderBy("k").collect()] == [None, 2.0]


def test_bad_cells_become_null(spark):
    raw = spark.createDataFrame([("1", "x", "oops")], "subject_id string, hadm_id string, intime string")
    r = tables.conform(raw, "icustays").first()
    assert (r["subject_id"], r["hadm_id"], r["intime"]) == (1, None, None)


def test_csv_cells_as_other_tools_write_them(spark, tmp_path):
    from wardlake.sources import tables

    folder = tmp_path / "ed"
    folder.mkdir()
    (folder / "edstays.csv").write_text(
        "race,subject_id,hadm_id,stay_id,intime,outtime,gender\n"
        "A,1,2345.0,10,2024-01-01 10:00:00,2024-01-01 12:00:00,F\n"
        "B,2,NaN,11,2024-01-02 10:00:00,bad,M\n"
        "C,3,,12,2024-01-03 10:00:00,2024-01-03 12:00:00,M\n"
        "D,4,23.5,13,2024-01-03 10:00:00,2024-01-03 12:00:00,M\n"
    )
    (folder / "triage.csv").write_text(
        "subject_id,stay_id,temperature,heartrate,resprate,o2sat,sbp,dbp,pain,acuity,chiefcomplaint\n"
        '1,10,98.6,nan,16,99,120,80,3,2.0,"chest pain,\n""since"" noon"\n'
        "2,11,x,80,NaN,99,120,80,unable,3,fall\n"
    )
    stays = {r.stay_id: r for r in tables.load(spark, str(tmp_path), "edstays").collect()}
    assert [stays[i].hadm_id for i in (10, 11, 12, 13)] == [2345, None, None, None]
    assert stays[11].outtime is None and stays[10].outtime is not None
    triage = {r.stay_id: r for r in tables.load(spark, str(tmp_path), "triage").collect()}
    assert len(triage) == 2 and triage[10].chiefcomplaint == 'chest pain,\n"since" noon'
    assert triage[10].triage_heartrate is None and triage[11].triage_resprate is None and triage[11].triage_temperature is None
    raw = spark.read.option("header", True).csv(str(folder / "edstays.csv"))
    bad = {r["column"]: r.rejected for r in tables.rejected_cells(raw, "edstays").collect()}
    assert bad["hadm_id"] == 1 and bad["subject_id"] == 0
