"""Writers. Parquet is the default; CSV stores arrays as list text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=()) -> None:
    if fmt == "csv":
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
        spans = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DayTimeIntervalType)]
        df = df.withColumns({c: F.to_json(c) for c in arrays}).withColumns(
            {c: F.col(c).cast("string") for c in spans}
        )
    writer = df.write.mode(mode).option("header", True)
    if fmt == "csv":
        # Quotes are doubled, as readers of plain CSV expect; blanks around a value are part of it.
        writer = writer.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def write_code_index(index: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The code -> number table (columns ``code``, ``code_idx``)."""
    write_table(index.select("code", "code_idx"), path, fmt)


def write_parts(parts: Mapping[str, DataFrame], out: str, fmt: str = "parquet") -> None:
    """One data set per part of a split: ``out/train``, ``out/valid``, ``out/test`` and so on."""
    for name, part in parts.items():
        write_table(part, f"{out.rstrip('/')}/{name}", fmt)


def write_lab_results(lists: DataFrame, out: str, fmt: str = "parquet") -> None:
    """The lab lists of the stays (:func:`events.lab_lists`)."""
    write_table(lists.select("subject_id", "hadm_id", "stay_id", "lab_measure", "lab_results"), f"{out.rstrip('/')}/lab_results", fmt)


def write_results(results: DataFrame, out: str, fmt: str = "csv") -> None:
    """A report of metrics with its formatted strings, in one file."""
    write_table(results.coalesce(1), f"{out.rstrip('/')}/results", fmt)
