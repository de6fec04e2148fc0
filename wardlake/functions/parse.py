"""Text parsing: numbers in free text, complaint flags, code formats, drug classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Complaint flag -> pattern.
COMPLAINTS = {
    "chiefcom_chest_pain": "chest pain",
    "chiefcom_abdominal_pain": "abdominal pain|abd pain",
    "chiefcom_headache": "headache|lightheaded",
    "chiefcom_shortness_of_breath": "breath",
    "chiefcom_back_pain": "back pain",
    "chiefcom_cough": "cough",
    "chiefcom_nausea_vomiting": "nausea|vomit",
    "chiefcom_fever_chills": "fever|chill",
    "chiefcom_syncope": "syncope",
    "chiefcom_dizziness": "dizz",
}


def parse_number_text(column: str) -> Column:
    """A number at the start of a text: ``7`` -> 7, ``7-8`` -> 7.5, ``5/10`` -> 5, else NULL.

    The first run of letters, digits and dashes decides, so ``7.5`` gives 7 and ``-3`` NULL.
    """
    head = F.regexp_extract(F.col(column).cast("string"), r"^\s*([a-zA-Z0-9-]*)", 1)
    low = F.regexp_extract(head, r"^(\d+)-(\d+)$", 1).try_cast("double")
    high = F.regexp_extract(head, r"^(\d+)-(\d+)$", 2).try_cast("double")
    return F.coalesce((low + high) / 2, F.when(head.rlike(r"^\d+$"), head.try_cast("double")))


def complaint_flags(df: DataFrame, patterns: Mapping[str, str] = COMPLAINTS, text: str = "chiefcomplaint") -> DataFrame:
    """One boolean per pattern, case ignored; several may be true; missing text gives False."""
    return df.withColumns(
        {name: F.coalesce(F.col(text).rlike(f"(?iu){p}"), F.lit(False)) for name, p in patterns.items()}
    )


def clean_code(column: str | Column) -> Column:
    """A diagnosis code without dots and outer white space."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.replace(column, F.lit("."), F.lit("")), r"^\s+|\s+$", "")


def pharm_class(column: str) -> tuple[Column, Column]:
    """``(term, type)`` of a class text such as ``Beta Blocker [EPC]``: the last word is the type."""
    text = F.col(column)
    last = F.substring_index(text, " ", -1)
    before = F.substring(text, F.lit(1), F.length(text) - F.length(last) - 1)
    term = F.when(F.instr(text, " ") > 0, before).otherwise(F.lit(""))
    return term, F.regexp_replace(last, r"^[\[\]]+|[\[\]]+$", "")


# Length of the code prefix at each level of the drug classification.
ATC_PREFIX_LENGTHS = {1: 1, 2: 3, 3: 4, 4: 5, 5: 7}


def atc_levels(column: str) -> dict[int, Column]:
    """Level -> code prefix, upper case; level 5 only for a full code."""
    code = F.upper(column)
    out = {level: F.substring(code, 1, n) for level, n in ATC_PREFIX_LENGTHS.items()}
    out[5] = F.when(F.length(code) == ATC_PREFIX_LENGTHS[5], code)
    return out
