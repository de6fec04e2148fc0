"""Input table schemas. Clocks carry no zone, so they are TIMESTAMP_NTZ."""

from __future__ import annotations

SCHEMAS = {
    "edstays": "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz, "
    "gender string, race string",
    "patients": "subject_id long, gender string, anchor_age int, anchor_year int, dod date",
    "admissions": "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, "
    "deathtime timestamp_ntz, insurance string, race string, edregtime string, edouttime string",
    "icustays": "subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz",
    "triage": "subject_id long, stay_id long, temperature double, heartrate double, resprate double, "
    "o2sat double, sbp double, dbp double, pain string, acuity double, chiefcomplaint string",
    "vitalsign": "subject_id long, stay_id long, charttime timestamp_ntz, temperature double, heartrate double, "
    "resprate double, o2sat double, sbp double, dbp double, rhythm string, pain string",
    "pyxis": "subject_id long, stay_id long, charttime timestamp_ntz, name string, gsn string",
    "medrecon": "subject_id long, stay_id long, charttime timestamp_ntz, name string, gsn string",
    "diagnoses_icd": "subject_id long, hadm_id long, icd_code string, icd_version int",
    "labevents": "subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, storetime timestamp_ntz, "
    "valuenum double",
    "lab_items": "itemid long, label string, fluid string, category string, ed_labs int, "
    "ed_most_common_labs int, frequency long, grouping string",
    "code_map": "source_code string, target_code string",
    "atc": "level int, code string, description string",
}

#: The eight readings that get a prefix in the triage and in the vital-sign table (fixed values).
TRIAGE_VITALS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "acuity"]
SERIES_VITALS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "rhythm", "pain"]
ADMISSION_COLUMNS = [
    "subject_id", "hadm_id", "admittime", "dischtime", "deathtime",
    "ethnicity", "edregtime", "edouttime", "insurance",
]
