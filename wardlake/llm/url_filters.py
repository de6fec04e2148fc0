"""URL filters by a temporal list join.

Lists change: an entry is a dated action, ``add`` or ``remove``, on a list, for a host, a
domain (the host itself or any host below it) or a prefix (host and leading path
segments). Actions become validity intervals, and each capture is judged by the entries
that were active on the day it was fetched. A capture is blocked if a block list is
active for it and no allow list is.

A capture's keys are its host, the domains above it and its path prefixes. Keys are made
distinct per day before they meet the intervals, and what matched is joined back by key
and day, so a host with very many captures is spread over the days.

Edge cases: a null, empty or unparsable URL has no host and matches nothing; a capture
without a day matches nothing; entries with a null field are left out; on one day ``add``
counts after ``remove``; repeated rows are judged one by one; an empty list blocks
nothing; a repeated ``add`` or an early ``remove`` has no effect; columns beyond those
named do not matter, except that captures keep theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import fresh_name, materialize

#: scheme, user, host, port; then the path up to a query or fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a final dot; null if there is none."""
    found = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def domains_of(host: Column) -> Column:
    """The host and every domain above it, the last label alone included."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def prefixes_of(url: Column) -> Column:
    """Host and leading path segments, one prefix for each, as ``host/a/b``."""
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    many = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(many, lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def keys_of(url: Column) -> Column:
    """Everything that a list may say about a URL, as ``(kind, value)``."""

    def kind(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))

    host = host_of(url)
    some = F.concat(kind("host", F.array(host)), kind("domain", domains_of(host)), kind("prefix", prefixes_of(url)))
    return F.when(host.isNotNull(), some)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list, kind, value, from, to`` from ``list, kind, value, action, day``; ``to`` is open.

    A key's actions are first merged per day, so a window holds at most one row a day.
    """
    key = ["list", "kind", "value"]
    daily = entries.select(*key, "action", F.col("day").cast("date").alias("day")).na.drop()
    daily = daily.filter(F.col("action").isin("add", "remove"))
    daily = daily.groupBy(*key, "day").agg(F.max(F.col("action") == "add").alias("on"))
    order = Window.partitionBy(*key).orderBy("day")
    turns = daily.withColumn("_was", F.coalesce(F.lag("on").over(order), F.lit(False))).filter("on <> _was")
    return (
        turns.withColumn("to", F.lead("day").over(order))
        .filter("on")
        .select(*key, F.col("day").alias("from"), "to")
    )


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day", allow: str = "allow") -> DataFrame:
    """``captures`` with ``host, active, blocked``: the lists active for each, sorted by name.

    New columns whose name is taken get an underscore in front.
    """
    names = captures.columns
    row = fresh_name("row", names)
    rows = materialize(captures.withColumn(row, F.monotonically_increasing_id()))
    keys = rows.select(F.col(row).alias("row"), F.col(day).cast("date").alias("day"), F.explode(keys_of(F.col(url))).alias("k"))
    keys = keys.select("row", "day", "k.*").filter("day is not null")
    intervals = validity_intervals(entries)
    asked = keys.select("kind", "value", "day").distinct()
    valid = (F.col("day") >= F.col("from")) & (F.col("to").isNull() | (F.col("day") < F.col("to")))
    matched = (
        asked.join(intervals, ["kind", "value"])
        .filter(valid)
        .groupBy("kind", "value", "day")
        .agg(F.collect_set("list").alias("lists"))
    )
    found = keys.join(matched, ["kind", "value", "day"]).groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("lists")))).alias("active")
    )
    out = rows.join(found.withColumnRenamed("row", row).withColumnRenamed("active", fresh_name("active", names)), row, "left")
    active = F.coalesce(fresh_name("active", names), F.array().cast("array<string>"))
    blocked = (F.size(active) > 0) & ~F.array_contains(active, allow)
    return out.select(
        *names,
        host_of(F.col(url)).alias(fresh_name("host", names)),
        active.alias(fresh_name("active", names)),
        blocked.alias(fresh_name("blocked", names)),
    )
