"""Look-back counts, look-ahead outcomes and fills along each subject's time line."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.clock import DAY_US, HOUR_US, micros, time_block
from .prefix import dealt, running_totals, strategy_and_rows

#: Time slice of the block strategy (one task scans one slice of a subject), and the number
#: of key slices that visits of one subject and instant are cut into.
BLOCK_US = DAY_US
KEY_BLOCKS = 4096


def visit_history(
    visits: DataFrame,
    *,
    subject: str = "subject_id",
    key: str = "stay_id",
    start: str = "intime",
    end: str = "outtime",
    past_visits: Mapping[str, int] | None = None,
    past_events: Mapping[str, tuple[DataFrame, str, Sequence[int]]] | None = None,
    next_visit: int | None = None,
    strategy: str = "auto",
    rows: int | None = None,
    along: bool = False,
) -> DataFrame:
    """Adds look-back counts and the next visit to every visit row.

    ``past_visits``: output column -> days. Counts the subject's rows that come before
    this one (order: start, then key) and start at most that many days earlier.

    ``past_events``: name -> (events, time column, days list). Adds ``n_<name>_<d>d``:
    events with ``0 < start - time <= d`` days.

    ``next_visit``: days. Adds ``next_ed_visit_time``, ``next_ed_visit_time_diff`` (from
    this visit's end) and ``outcome_ed_revisit_<d>d`` (gap strictly below the limit,
    False without a next visit).

    A row without a subject or a start has no history: counts of 0, no next visit, and it
    is in no other row's count. Rows with equal subject, start and key do not count each
    other. Keys may be numbers or text.

    All of them share one shuffle by subject. When a subject is too large for one task
    (``strategy='auto'`` checks), the same numbers come from day-sized blocks instead;
    tests hold both ways against each other. ``rows``, the rows of all tables together, decides
    the number of tasks; where it is not given it is counted. With ``along``, in windows, the
    result lies by subject alone, so that steps by subject need no other shuffle.
    """
    request = _Request(subject, key, start, end, past_visits or {}, past_events or {}, next_visit)
    chosen = strategy
    if rows is None or strategy not in ("window", "blocks"):
        chosen, rows = strategy_and_rows(strategy, subject, visits, *[e for e, _, _ in request.past_events.values()])
    return _by_window(visits, request, rows, along) if chosen == "window" else _by_blocks(visits, request)


def past_visit_counts(visits: DataFrame, days: Sequence[int], prefix: str = "n_ed", **names) -> DataFrame:
    """Earlier visits of the same subject within each look-back; adds ``<prefix>_<d>d``."""
    return visit_history(visits, past_visits={f"{prefix}_{d}d": d for d in days}, **names)


def past_event_counts(
    visits: DataFrame, events: DataFrame, time: str, days: Sequence[int], name: str, **names
) -> DataFrame:
    """Events of the same subject within each look-back; adds ``n_<name>_<d>d``."""
    return visit_history(visits, past_events={name: (events, time, days)}, **names)


def next_visit_outcome(visits: DataFrame, days: int, **names) -> DataFrame:
    return visit_history(visits, next_visit=days, **names)


class _Request:
    def __init__(self, subject, key, start, end, past_visits, past_events, next_visit):
        self.subject, self.key, self.start, self.end = subject, key, start, end
        self.past_visits, self.past_events, self.next_visit = past_visits, past_events, next_visit

    def outcome(self, df: DataFrame, next_us: Column) -> DataFrame:
        """Turns the next start (micros) into the three look-ahead columns."""
        if self.next_visit is None:
            return df
        next_start = F.timestamp_micros(next_us).cast(df.schema[self.start].dataType)
        gap = next_us - micros(self.end)
        return df.withColumns(
            {
                "next_ed_visit_time": next_start,
                "next_ed_visit_time_diff": next_start - F.col(self.end),
                f"outcome_ed_revisit_{self.next_visit}d": F.coalesce(
                    gap < F.lit(self.next_visit * DAY_US), F.lit(False)
                ),
            }
        )


def _by_window(visits: DataFrame, q: _Request, rows: int, along: bool = False) -> DataFrame:
    columns = visits.columns
    placed = F.col("_subject").isNotNull() & F.col("_t").isNotNull()
    stream = visits.select(
        F.col(q.subject).alias("_subject"),
        micros(q.start).alias("_t"),
        F.col(q.key).alias("_key"),
        F.struct(*columns).alias("_row"),
        F.lit("").alias("_kind"),
    )
    # Rows that have no place on a time line are spread over windows of their own.
    stream = stream.withColumn("_apart", F.when(~placed, F.xxhash64("_key", "_t", "_subject")).otherwise(F.lit(0)))
    for name, (events, time, _) in q.past_events.items():
        stream = stream.unionByName(
            events.filter(F.col(time).isNotNull() & F.col(q.subject).isNotNull()).select(
                F.col(q.subject).alias("_subject"),
                micros(time).alias("_t"),
                F.lit(name).alias("_kind"),
                F.lit(0).cast("long").alias("_apart"),
            ),
            allowMissingColumns=True,
        )
    stream = dealt(stream, ["_subject"] if along else ["_subject", "_apart"], rows)

    # Growing frames only: each row is added once, however wide the look-back is.
    line = Window.partitionBy("_subject", "_apart").orderBy("_t")
    until = lambda last: line.rangeBetween(Window.unboundedPreceding, last)
    in_order = Window.partitionBy("_subject", "_apart", "_kind").orderBy("_t", "_key")
    is_visit = (F.col("_kind") == "") & placed

    def counted(what: Column, frame) -> Column:
        return F.coalesce(F.sum(F.when(what, 1)).over(frame), F.lit(0))

    added: dict[str, Column] = {out: counted(is_visit, until(-(days * DAY_US) - 1)) for out, days in q.past_visits.items()}
    for name, (_, _, days_list) in q.past_events.items():
        hit = F.col("_kind") == name
        for days in days_list:
            added[f"n_{name}_{days}d"] = counted(hit, until(-1)) - counted(hit, until(-(days * DAY_US) - 1))
    stream = stream.withColumns(added)
    if q.past_visits:
        # Rows equal in start and key have one rank, so they do not count each other.
        earlier = F.when(is_visit, F.rank().over(in_order).cast("long") - 1).otherwise(F.lit(0).cast("long"))
    if q.next_visit is not None:
        # One step after the other, so that a sort serves all steps that can use it.
        last_key = F.max(F.when(is_visit, F.col("_key"))).over(Window.partitionBy("_subject", "_apart", "_t"))
        stream = stream.withColumns({"_visit_t": F.when(is_visit, F.col("_t")), "_last_key": last_key})
    if q.past_visits:
        stream = stream.withColumn("_earlier", earlier).withColumns({c: F.col("_earlier") - F.col(c) for c in q.past_visits})
    if q.next_visit is not None:
        # Rows of one instant see it in each other, in key order; of equal keys all see the next.
        # Read backwards, so that this frame grows as well.
        backwards = Window.partitionBy("_subject", "_apart").orderBy(F.desc("_t"))
        later = F.min("_visit_t").over(backwards.rangeBetween(Window.unboundedPreceding, -1))
        stream = stream.withColumn("_next", F.when(F.col("_key") < F.col("_last_key"), F.col("_visit_t")).otherwise(later))
    kept = list(added)
    # The subject by which the rows lie, so that the planner knows where they are.
    own = {q.subject: F.col("_subject").cast(visits.schema[q.subject].dataType).alias(q.subject)}
    fields = [own.get(c, F.col("_row")[c].alias(c)) for c in columns]
    flat = stream.filter(F.col("_row").isNotNull()).select(*fields, *kept, *(["_next"] if q.next_visit is not None else []))
    if q.next_visit is None:
        return flat
    return q.outcome(flat, F.col("_next")).drop("_next").select(
        *columns, *kept, "next_ed_visit_time", "next_ed_visit_time_diff", f"outcome_ed_revisit_{q.next_visit}d"
    )


#: Where a visit stands: several rows may share one place.
PLACE = ["_subject", "_t", "_key"]


def _by_blocks(visits: DataFrame, q: _Request) -> DataFrame:
    """The same columns from look-ups in block-wise running totals.

    Every count is a difference of two ranks, and a rank is "how many lie before this
    instant": looked up by (subject, instant), brought back by place.
    """
    rows = visits.select(
        F.col(q.subject).alias("_subject"), micros(q.start).alias("_t"), F.col(q.key).alias("_key")
    ).filter("_subject is not null and _t is not null")
    places = rows.distinct()
    parts: list[DataFrame] = []
    points = rows.select("_subject", "_t", F.lit(1).alias("n"), F.col("_key").alias("_last"))

    if q.past_visits:
        probes = {out: -days * DAY_US for out, days in q.past_visits.items()}
        ranks = _ranks_at(points.select("_subject", "_t", "n"), places, {**probes, "_me": 0})
        ranked = _with_ties(ranks, rows)
        parts.append(
            ranked.select(*PLACE, *[(F.col("_me") + F.col("_tie") - F.col(out)).alias(out) for out in q.past_visits])
        )
    for name, (events, time, days_list) in q.past_events.items():
        seen = events.filter(F.col(time).isNotNull() & F.col(q.subject).isNotNull()).select(
            F.col(q.subject).alias("_subject"), micros(time).alias("_t"), F.lit(1).alias("n")
        )
        ranks = _ranks_at(seen, places, {**{f"_{d}": -d * DAY_US for d in days_list}, "_me": 0})
        parts.append(
            ranks.select(*PLACE, *[(F.col("_me") - F.col(f"_{d}")).alias(f"n_{name}_{d}d") for d in days_list])
        )
    if q.next_visit is not None:
        # The last key of an instant sees the next instant, its ties see their own.
        instants = points.groupBy("_subject", "_t").agg(F.max("_last").alias("_last"))
        following = running_totals(
            instants.withColumn("n", F.lit(1)),
            ["_subject"],
            "_t",
            ["n"],
            time_block(F.col("_t"), BLOCK_US),
            with_next=True,
        ).select("_subject", "_t", "next__t")
        per_row = places.join(following, ["_subject", "_t"]).join(instants, ["_subject", "_t"])
        parts.append(
            per_row.select(
                *PLACE, F.when(F.col("_key") < F.col("_last"), F.col("_t")).otherwise(F.col("next__t")).alias("_next")
            )
        )
    joined = reduce(_join_places, parts)
    own = (
        F.col(q.subject).eqNullSafe(F.col("_subject"))
        & micros(q.start).eqNullSafe(F.col("_t"))
        & F.col(q.key).eqNullSafe(F.col("_key"))
    )
    wide = visits.join(joined, own, "left").drop(*PLACE)
    counts = [*q.past_visits, *[f"n_{n}_{d}d" for n, (_, _, days) in q.past_events.items() for d in days]]
    wide = wide.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    if q.next_visit is not None:
        wide = q.outcome(wide, F.col("_next")).drop("_next")
    return wide.select(*visits.columns, *[c for c in wide.columns if c not in visits.columns])


def _join_places(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joins two frames by place; a place without a key is one, too."""
    other = right.withColumnsRenamed({c: f"{c}_other" for c in PLACE})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_other")) for c in PLACE])
    return left.join(other, same).drop(*[f"{c}_other" for c in PLACE])


def _ranks_at(points: DataFrame, places: DataFrame, shifts: Mapping[str, int]) -> DataFrame:
    """Per place: how many points lie strictly before ``start + shift``, one column per shift."""
    probe = F.explode(
        F.array(
            *[F.struct(F.lit(out).alias("what"), (F.col("_t") + F.lit(s)).alias("at")) for out, s in shifts.items()]
        )
    )
    probes = places.select(*PLACE, probe.alias("p")).select(
        "_subject", "_key", "p.what", F.col("_t").alias("_start"), F.col("p.at").alias("_t")
    )
    marks = points.unionByName(probes.select("_subject", "_t", F.lit(0).alias("n")))
    totals = running_totals(marks, ["_subject"], "_t", ["n"], time_block(F.col("_t"), BLOCK_US))
    looked_up = probes.join(totals.select("_subject", "_t", "n_before"), ["_subject", "_t"])
    return (
        looked_up.groupBy("_subject", "_start", "_key")
        .agg(*[F.sum(F.when(F.col("what") == out, F.col("n_before"))).alias(out) for out in shifts])
        .withColumnRenamed("_start", "_t")
    )


def _with_ties(ranks: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``_tie``: how many visits of the same subject and instant have a smaller key.

    A missing key comes first, and is in no block; it has no smaller key.
    """
    none = rows.filter("_key is null").groupBy("_subject", "_t").agg(F.count("*").alias("_none"))
    keyed = rows.filter("_key is not null")
    totals = running_totals(keyed.withColumn("n", F.lit(1)), ["_subject", "_t"], "_key", ["n"], _key_block(keyed))
    ties = totals.select("_subject", "_t", "_key", F.col("n_before").alias("_tie"))
    out = ranks.join(ties, PLACE, "left").join(none, ["_subject", "_t"], "left")
    before = F.coalesce("_tie", F.lit(0)) + F.when(F.col("_key").isNotNull(), F.coalesce("_none", F.lit(0))).otherwise(0)
    return out.withColumn("_tie", before).drop("_none")


def _key_block(rows: DataFrame) -> Column:
    """Slices of keys that never fall while keys rise: ranges of numbers, first letters of text."""
    if not isinstance(rows.schema["_key"].dataType, NumericType):
        return F.substring(F.col("_key").cast("string"), 1, 4)
    low, high = rows.agg(F.min("_key").cast("long"), F.max("_key").cast("long")).first()
    low, high = low or 0, high or 0
    width = (high - low) // KEY_BLOCKS + 1
    # Halves keep the distance of far-apart 64-bit keys inside a long.
    return F.expr(f"(cast(_key as long) div 2 - {low // 2}L) div {max(width // 2, 1)}L")


def fill_from_subject(
    visits: DataFrame,
    column: str,
    subject: str = "subject_id",
    start: str = "intime",
    key: str = "stay_id",
    along: bool = False,
) -> DataFrame:
    """Missing values take the subject's most frequent value; a tie goes to the one seen first.

    ``along`` is for visits that lie by subject already, none of them too large for a task.
    """
    if along:
        return _fill_along(visits, column, subject, start, key)
    seen = visits.filter(F.col(column).isNotNull())
    counted = seen.groupBy(subject, column).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(start, key)).alias("_first")
    )
    best = counted.groupBy(subject).agg(
        F.min_by(column, F.struct(-F.col("_n"), F.col("_first"))).alias("_usual")
    )
    filled = visits.join(best, subject, "left").withColumn(column, F.coalesce(column, "_usual"))
    return filled.select(*visits.columns)


def _fill_along(visits: DataFrame, column: str, subject: str, start: str, key: str) -> DataFrame:
    """The same by windows: rows that lie by subject stay where they are, and are read once."""
    equal, whole = Window.partitionBy(subject, column), Window.partitionBy(subject)
    order = F.struct((-F.count(F.lit(1)).over(equal)).alias("n"), F.min(F.struct(start, key)).over(equal).alias("first"))
    ranked = visits.withColumn("_order", F.when(F.col(column).isNotNull() & F.col(subject).isNotNull(), order))
    usual = F.min_by(column, "_order").over(whole)
    return ranked.withColumn(column, F.coalesce(column, usual)).select(*visits.columns)


def transfer_outcome(
    visits: DataFrame,
    transfers: DataFrame,
    hours: int,
    subject: str = "subject_id",
    admission: str = "hadm_id",
    end: str = "outtime",
    deal: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Earliest transfer of the admission, its delay after the visit, and whether it came in time.

    A transfer before the visit's end counts as in time; no transfer is False. ``deal`` puts
    the earliest transfers where the visits lie.
    """
    earliest = (
        transfers.filter(F.col(admission).isNotNull())
        .groupBy(admission)
        .agg(F.min_by(subject, F.struct("intime", subject)).alias(subject), F.min("intime").alias("intime_icu"))
    )
    delay_us = micros("intime_icu") - micros(end)
    joined = visits.join(deal(earliest), [subject, admission], "left")
    return joined.withColumns(
        {
            "time_to_icu_transfer": F.col("intime_icu") - F.col(end),
            f"outcome_icu_transfer_{hours}h": F.coalesce(delay_us <= F.lit(hours * HOUR_US), F.lit(False)),
        }
    )
