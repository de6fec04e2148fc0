"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: UTC keeps zone-less clinical clocks unchanged when they are turned into micros;
#: AQE merges small shuffle partitions and splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "wardlake", **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` wins over them.

    On a cluster leave ``master`` unset, so that spark-submit decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one is made only for local sessions."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="wardlake-", dir=os.environ.get("TMPDIR"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


#: Rows that were dealt by one column of several join keys stay where they are.
STAY_PUT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
#: Shuffle files of a job go when it ends, not when the driver collects its garbage.
RELEASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def planned_with(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """``settings`` hold for what is planned inside; afterwards the session is as before."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(df: DataFrame, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Writes a frame once to the shared folder and reads it back as columnar files.

    The shuffle files of the writing go with its end; ``settings`` hold for it, too.
    Used where several jobs need the same expensive result: the files outlive a lost
    executor, end the lineage, and later reads still prune columns.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/wardlake-{uuid.uuid4().hex}"
    with planned_with(df.sparkSession, {**RELEASE, **(settings or {})}):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small constant table of known size (so the planner can see how small it is)."""
    fields = to_arrow_schema(T._parse_datatype_string(schema))
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(values, f.type) for values, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=fields))
