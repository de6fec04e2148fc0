"""Reading a table, row keys, and frames written to the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import checkpoint_dir

__all__ = ["materialize", "read", "texts", "text_key", "fresh_name", "let_workers_import"]


def materialize(df: DataFrame) -> DataFrame:
    """Writes a frame once to the shared folder and reads it back.

    The files outlive a lost executor and end the lineage. They hold text and hashes, so
    the slower of the usual codecs pays.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/text-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key(text: str = "text") -> Column:
    """Tells rows of one id apart by their text; a null text has its own key."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that the operators need: ``doc_id`` (long) and ``text`` (string)."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def fresh_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, or with underscores in front if a column has that name (in any case)."""
    have = {c.lower() for c in taken}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def let_workers_import(spark: SparkSession) -> None:
    """Adds this checkout to the workers' module path, for runs that start from it.

    Where the package is installed or sent with ``--py-files`` this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [root, *paths] if p)
