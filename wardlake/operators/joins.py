"""Joins of the visit table with its side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY_US, micros, time_block
from ..session import RELEASE, planned_with

#: A key with at most this many spans times events is joined as a whole.
KEY_PAIRS = 10_000


def with_patients(visits: DataFrame, patients: DataFrame) -> DataFrame:
    """Left join on the subject; ``gender`` comes from the patient only if the visit lacks it."""
    wanted = ["subject_id", "anchor_age", "gender", "anchor_year", "dod"]
    if "gender" in visits.columns:
        wanted.remove("gender")
    return visits.join(patients.select(*wanted), "subject_id", "left")


def with_admissions(visits: DataFrame, admissions: DataFrame) -> DataFrame:
    """Left join on subject and admission; a visit without admission matches nothing."""
    return visits.join(admissions, ["subject_id", "hadm_id"], "left")


def with_triage(visits: DataFrame, triage: DataFrame) -> DataFrame:
    return visits.join(triage, ["subject_id", "stay_id"], "left")


def keep_members(df: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` value occurs in ``members``."""
    return df.join(members.select(column).distinct(), column, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """The complement of :func:`keep_members` (a NULL value is kept)."""
    return df.join(members.select(column).distinct(), column, "left_anti")


def keep_right(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Right join: only the rows of ``right``, with the columns of ``left`` where they match."""
    return left.join(right, keys, "right")


def dyadic_blocks(first: str, last: str) -> Column:
    """The slices ``first`` to ``last`` (columns, both ends included) as aligned blocks of doubling size.

    A list of ``(_level, _block)``; block ``b`` of level ``j`` holds the slices from
    ``b * 2**j`` on, ``2**j`` of them. At most two blocks of a size are needed, no two of
    them overlap, and an empty range has none.
    """
    low, high = f"-shiftright(-{first}, j)", f"shiftright({last} + 1, j)"
    return F.expr(
        f"""flatten(transform(
          sequence(0, cast(log2(greatest({last} - {first} + 1, 1)) as int) + 1),
          j -> transform(
            filter(
              array(
                case when {low} < {high} and {low} % 2 <> 0 then {low} end,
                case when {low} + abs({low} % 2) < {high} and {high} % 2 <> 0 then {high} - 1 end),
              b -> b is not null),
            b -> struct(j as _level, b as _block))))"""
    )


def _few_pairs(spans: DataFrame, events: DataFrame, keys: list[str]) -> bool:
    """Whether a join by key alone stays small: no key with many pairs, and few pairs for a row in all."""
    sides = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((spans, "_spans"), (events, "_events"))]
    both = sides[0].join(sides[1], keys).select("_spans", "_events", (F.col("_spans") * F.col("_events")).alias("_pairs"))
    found = both.agg(F.max("_pairs"), *[F.sum(c).cast("double") for c in ("_pairs", "_spans", "_events")])
    with planned_with(spans.sparkSession, RELEASE):
        most, pairs, left, right = found.first()
    return most is None or (most <= KEY_PAIRS and pairs <= 8 * (left + right))


def events_within(
    spans: DataFrame,
    events: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    time: str,
    slice_us: int = DAY_US,
) -> DataFrame:
    """Inner join of events to the spans that hold them, both ends included.

    Where no key has more than ``KEY_PAIRS`` pairs, and all together have a few for a row at
    most, this is a join by key, which moves every row once; two narrow counts per key tell.
    Otherwise a span is listed under the blocks of its dyadic cover, an event under its block of
    every size that some span uses, so each pair meets in exactly one block: a span of n
    slices has about ``2 log2 n`` copies, and spans and events of a huge key meet block by
    block instead of all with all. One narrow job over the spans finds the sizes in use.
    """
    number = lambda column: time_block(micros(column), slice_us)
    known = spans.filter(micros(start) <= micros(end))
    timed = events.filter(F.col(time).isNotNull())
    if _few_pairs(known, timed, keys):
        return known.join(timed, keys).filter(F.col(time).between(F.col(start), F.col(end)))
    placed = known.select("*", number(start).alias("_first"), number(end).alias("_last"))
    listed = placed.select("*", F.inline(dyadic_blocks("_first", "_last"))).drop("_first", "_last")
    narrow = placed.select(F.explode(dyadic_blocks("_first", "_last")["_level"]).alias("j"))
    used = narrow.agg(F.bit_or(F.pow(F.lit(2.0), "j").cast("long"))).first()[0] or 1
    at = timed.withColumn("_slice", number(time))
    blocks = [
        F.struct(F.lit(j).alias("_level"), F.shiftright("_slice", j).alias("_block")) for j in range(63) if used >> j & 1
    ]
    at = at.select("*", F.inline(F.array(*blocks))).drop("_slice")
    on = [*keys, "_level", "_block"]
    return listed.join(at, on).filter(F.col(time).between(F.col(start), F.col(end))).drop("_level", "_block")
