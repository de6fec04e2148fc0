"""Event tables folded into one row per stay: vitals, medication, labs, hourly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import HOUR_US, MINUTE_US, micros, time_block
from ..session import materialize
from .joins import events_within
from .prefix import carried, dealt, group_sizes, grouped_medians, null_safe

VITAL_COLUMNS = ["ed_temperature", "ed_heartrate", "ed_resprate", "ed_o2sat", "ed_sbp", "ed_dbp", "ed_pain"]


SIMPLE_SUMMARIES = {"max": F.max, "min": F.min, "mean": F.avg}
#: Readings of the same instant count as one: the least for ``first``, the greatest for ``last``.
ORDERED_SUMMARIES = {"first": (F.min, F.min_by), "last": (F.max, F.max_by)}
#: A stay with at most this many readings may be held by one buffer.
STAY_ROWS = 20_000


def vital_summaries(
    readings: DataFrame,
    options: Sequence[str],
    keys: Sequence[str] = ("subject_id", "stay_id"),
    time: str = "charttime",
    columns: Sequence[str] = tuple(VITAL_COLUMNS),
    along: bool = False,
) -> DataFrame:
    """One row per stay with ``<column>_<option>``.

    Readings are dealt by stay once, and one aggregation makes all summaries. Only a stay of
    at most ``STAY_ROWS`` readings is held by a buffer; those of larger ones (a counting job
    tells whether there are any) combine on the map side, with medians found by ranks.

    ``first`` and ``last`` skip missing values column by column. ``along`` is for readings of
    which every stay lies in one task already, with at most ``STAY_ROWS`` of it.
    """
    able = [*SIMPLE_SUMMARIES, "median", *ORDERED_SUMMARIES]
    if unknown := set(options) - set(able):
        raise ValueError(f"{sorted(unknown)} not among {able}")
    present = [c for c in columns if c in readings.columns]
    keys = list(keys)
    wanted = [*keys, *([time] if set(options) & set(ORDERED_SUMMARIES) else []), *present]
    rows = readings.select(*dict.fromkeys(wanted))
    if along:
        return _summaries_of_stays(rows, options, keys, time, present)
    largest, total = group_sizes(readings.select(*keys), keys)
    if largest <= STAY_ROWS:
        return _summaries_of_stays(dealt(rows, keys, total), options, keys, time, present)
    large = readings.groupBy(*keys).count().filter(F.col("count") > STAY_ROWS).select(*keys)
    usual = dealt(null_safe(rows, large, keys, "left_anti"), keys, total)
    usual = _summaries_of_stays(usual, options, keys, time, present)
    return usual.unionByName(_summaries_of_large(null_safe(rows, large, keys, "left_semi"), options, keys, time, present))


def _summaries_of_stays(
    readings: DataFrame, options: Sequence[str], keys: list[str], time: str, present: list[str]
) -> DataFrame:
    """:func:`vital_summaries` with one buffer for all readings of a stay, which lie in one task."""

    def summary(option: str, c: str) -> Column:
        value = F.col(c)
        if option in SIMPLE_SUMMARIES:
            return SIMPLE_SUMMARIES[option](c)
        if option == "median":
            number = value.cast("double")
            return F.sort_array(F.collect_list(F.when(~F.isnan(number), number)))
        timed = F.when(value.isNotNull() & F.col(time).isNotNull(), F.struct(micros(time).alias("t"), value.alias("v")))
        return ORDERED_SUMMARIES[option][0](timed)["v"]

    if present and options and set(options) <= set(ORDERED_SUMMARIES):
        # Plain numbers in the buffers: no sort. Instants and stays both lie in the task.
        return _summaries_of_large(readings, options, keys, time, present)
    summed = readings.groupBy(*keys)
    if not (options and present):
        return summed.agg(F.count(F.lit(1))).select(*keys)
    out = summed.agg(*[summary(o, c).alias(f"{c}_{o}") for o in options for c in present])
    if "median" not in options:
        return out
    # An even count takes the mean of its two middle values; get() of an empty list is NULL.
    middle = lambda c: (F.get(c, F.expr(f"(size(`{c}`) - 1) div 2")) + F.get(c, F.expr(f"size(`{c}`) div 2"))) / 2
    return out.withColumns({f"{c}_median": middle(f"{c}_median") for c in present})


def _summaries_of_large(
    readings: DataFrame, options: Sequence[str], keys: list[str], time: str, present: list[str]
) -> DataFrame:
    """:func:`vital_summaries` without a buffer that holds a stay; all of it combines on the map side.

    ``first`` and ``last`` are taken over one row per instant, which keeps the buffers plain
    numbers and so the aggregation hashed.
    """
    simple = [o for o in options if o in SIMPLE_SUMMARIES]
    if "median" in options and present:
        medians = grouped_medians(readings, list(keys), present)
        by_column = [F.max(F.when(F.col("variable") == c, F.col("median"))).alias(f"{c}_median") for c in present]
        medians = medians.groupBy(*keys).agg(*by_column)
    ordered = [o for o in options if o in ORDERED_SUMMARIES]
    parts = []
    if simple:
        parts.append(
            readings.groupBy(*keys).agg(
                *[SIMPLE_SUMMARIES[o](c).alias(f"{c}_{o}") for o in simple for c in present]
            )
        )
    if ordered:
        timed = readings.select(*keys, micros(time).alias("_t"), *present)
        instants = timed.groupBy(*keys, "_t").agg(
            *[ORDERED_SUMMARIES[o][0](c).alias(f"{c}_{o}") for o in ordered for c in present]
        )
        at = lambda name: F.when(F.col(name).isNotNull(), F.col("_t"))
        parts.append(
            instants.groupBy(*keys).agg(
                *[
                    ORDERED_SUMMARIES[o][1](f"{c}_{o}", at(f"{c}_{o}")).alias(f"{c}_{o}")
                    for o in ordered
                    for c in present
                ]
            )
        )
    if not parts:
        parts.append(readings.select(*keys).distinct())
    joined = parts[0] if len(parts) == 1 else null_safe(parts[0], parts[1], list(keys))
    if "median" in options and present:
        joined = null_safe(joined, medians, list(keys), "left")
    return joined.select(*keys, *[f"{c}_{o}" for o in options for c in present])


def merge_vital_summaries(visits: DataFrame, readings: DataFrame, options: Sequence[str]) -> DataFrame:
    return visits.join(vital_summaries(readings, options), ["subject_id", "stay_id"], "left")


def merge_medication_count(
    visits: DataFrame, medication: DataFrame, out: str, code: str = "gsn", fill_from: str | None = "name"
) -> DataFrame:
    """Distinct medications per stay, 0 without any. A missing code is replaced by
    ``fill_from``; with ``fill_from=None`` it is not counted."""
    what = F.coalesce(F.col(code).cast("string"), F.col(fill_from)) if fill_from else F.col(code)
    distinct = medication.select("stay_id", what.alias("_what")).filter(F.col("_what").isNotNull()).distinct()
    counts = distinct.groupBy("stay_id").agg(F.count(F.lit(1)).alias(out))
    return visits.join(counts, "stay_id", "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


#: Items that go into the scan as a list.
MOST_LISTED = 1_000


def wanted_labs(visits: DataFrame, labs: DataFrame, items: DataFrame) -> DataFrame:
    """The lab rows that can matter, by filters that a parquet scan can skip row groups with.

    Items of a small dimension become an IN list (a larger one is a semi join), and the
    admissions of the visits a range, both found by small jobs before the large table is read.
    """
    rows = labs.filter(F.col("hadm_id").isNotNull() & F.col("valuenum").isNotNull())
    listed = [r[0] for r in items.select("itemid").distinct().limit(MOST_LISTED + 1).collect()]
    if len(listed) <= MOST_LISTED:
        rows = rows.filter(F.col("itemid").isin([i for i in listed if i is not None]))
    else:
        rows = rows.join(items.select("itemid"), "itemid", "left_semi")
    low, high = visits.agg(F.min("hadm_id"), F.max("hadm_id")).first()
    return rows.filter(F.col("hadm_id").between(low, high) if low is not None else F.lit(False))


def stay_labs(visits: DataFrame, labs: DataFrame, items: DataFrame) -> DataFrame:
    """Lab values stored during the stay: rows (subject, admission, stay, item, value).

    ``items`` is the lab item dimension; only its items count.
    """
    inside = events_within(
        visits.select("subject_id", "hadm_id", "stay_id", "intime", "outtime"),
        wanted_labs(visits, labs, items).select("subject_id", "hadm_id", "itemid", "storetime", "valuenum"),
        ["subject_id", "hadm_id"],
        "intime",
        "outtime",
        "storetime",
    )
    return inside.select("subject_id", "hadm_id", "stay_id", "itemid", "valuenum")


STAY_KEYS = ["subject_id", "hadm_id", "stay_id"]


def single_measures(lab_rows: DataFrame) -> DataFrame:
    """Rows of the stays in which no item repeats.

    Rows are first merged to one per (stay, item), so a repeated item never builds a long list.
    """
    per_item = lab_rows.groupBy(*STAY_KEYS, "itemid").agg(
        F.count(F.lit(1)).alias("_n"), F.first("valuenum").alias("valuenum")
    )
    repeats = F.max("_n").over(Window.partitionBy(*STAY_KEYS))
    return per_item.withColumn("_most", repeats).filter("_most = 1").select(*STAY_KEYS, "itemid", "valuenum")


def lab_lists(single: DataFrame) -> DataFrame:
    """Paired lists ``lab_measure`` and ``lab_results`` per stay, in item order.

    Input is :func:`single_measures`, so a list is no longer than the item dimension.
    """
    lists = single.groupBy(*STAY_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("itemid", "valuenum"))).alias("_labs")
    )
    return lists.select(
        *STAY_KEYS, F.col("_labs.itemid").alias("lab_measure"), F.col("_labs.valuenum").alias("lab_results")
    )


def lab_pivot(single: DataFrame, items: DataFrame, labels: Sequence[str], groups: int = 12) -> DataFrame:
    """One column per lab label (0 when not measured) and the list of measured lab groups.

    Groups stand in the order in which their first measured item appears in the item
    file. Stays without any listed item are left out. The columns are known beforehand,
    so this is a single aggregation.
    """
    known = single.join(F.broadcast(items) if items.count() <= 10_000 else items, "itemid")
    seen = [
        F.min(F.when(F.col("group_idx") == g, F.struct("rank", "group_idx"))) for g in range(groups)
    ]
    wide = known.groupBy(*STAY_KEYS).agg(
        *[F.coalesce(F.max(F.when(F.col("label") == l, F.col("valuenum"))), F.lit(0.0)).alias(l) for l in labels],
        F.array_sort(F.array_compact(F.array(*seen))).alias("_order"),
    )
    return wide.withColumn("lab_group_idx", F.col("_order.group_idx")).drop("_order")


#: Steps of a block of the hourly series.
STEP_BITS = 10


def hourly_series(
    readings: DataFrame,
    columns: Sequence[str],
    key: str = "stay_id",
    time: str = "charttime",
    step_us: int = HOUR_US,
    grid_us: int = MINUTE_US,
) -> DataFrame:
    """Readings on a regular grid that starts at each stay's first reading.

    Values are interpolated between readings that lie on the fine grid (``grid_us`` from
    the first reading; others are ignored), held after the last reading, and missing
    leading steps take the value of the next step. Output: (key, time, step, columns).

    Only the first and last reading of each step are needed for its neighbours, so
    readings shrink to one row per (stay, step) with readings; the steps up to the next row
    with readings are made last, from that row alone. Readings are dealt by stay once, and
    all of this follows within their tasks. Where a stay has more than ``STAY_ROWS`` readings
    (a counting job tells), what lies around a row is carried along blocks of steps instead,
    so that no task orders a whole stay. No made step is shuffled.
    """
    zone = next(f.dataType for f in readings.schema.fields if f.name == time)
    at = readings.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).withColumn("_t", micros(time))
    largest, total = group_sizes(at.select(key), [key])
    small, whole = largest <= STAY_ROWS, Window.partitionBy(key)
    if small:
        placed = dealt(at.select(key, "_t", *columns), [key], total).withColumns(
            {"_origin": F.min("_t").over(whole), "_end": F.max("_t").over(whole)}
        )
    else:
        origin = at.groupBy(key).agg(F.min("_t").alias("_origin"), F.max("_t").alias("_end"))
        placed = at.join(origin, key)
    placed = placed.withColumn("_offset", F.col("_t") - F.col("_origin"))
    on_grid = placed.filter(F.pmod("_offset", F.lit(grid_us)) == 0)
    step_of = lambda offset: time_block(offset, step_us)

    def edge(column: str, pick) -> Column:
        value = F.col(column)
        return pick(F.when(value.isNotNull(), F.struct(F.col("_offset").alias("x"), value.cast("double").alias("y"))))

    # The first reading is on the grid, so every stay has a row at step 0.
    per_step = on_grid.groupBy(key, step_of(F.col("_offset")).alias("step")).agg(
        F.min("_origin").alias("_origin"),
        step_of(F.max(F.col("_end") - F.col("_origin"))).alias("_most"),
        *[edge(c, F.min).alias(f"first_{c}") for c in columns],
        *[edge(c, F.max).alias(f"last_{c}") for c in columns],
    ).withColumn("_step", F.col("step"))
    past, following = [f"last_{c}" for c in columns], ["_step", *[f"first_{c}" for c in columns]]
    if small:
        before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        ahead, back = before(whole.orderBy("step")), before(whole.orderBy(F.desc("step")))
        lined = per_step.select(
            "*",
            *[F.last(c, ignorenulls=True).over(ahead).alias(f"past_{c}") for c in past],
            *[F.last(c, ignorenulls=True).over(back).alias(f"next_{c}") for c in following],
        )
    else:
        # Written once: the leading values and the steps both come from it.
        lined = materialize(carried(per_step, [key], "step", F.shiftright("step", STEP_BITS), past, following))
    until = F.coalesce(F.col("next__step") - 1, F.col("_most"))

    def value(column: str, step: Column, own: bool) -> Column:
        """Value at ``step``: the step of the row itself, or one after it and before the next row."""
        last, first = F.col(f"last_{column}"), F.col(f"first_{column}")
        past, following = F.col(f"past_last_{column}"), F.col(f"next_first_{column}")
        if own:
            following = F.coalesce(first, following)
        else:
            past = F.coalesce(last, past)
        x = step * F.lit(step_us)
        slope = (following.y - past.y) / (following.x - past.x)
        return (
            F.when(following.x == x, following.y)
            .when(past.isNull(), F.lit(None).cast("double"))
            .when(following.isNull(), past.y)
            .otherwise(past.y + slope * (x - past.x))
        )

    # Missing leading steps: the first value at any step. It lies at a row's own step or the one after it.
    leading = {
        f"lead_{c}": F.min(
            F.coalesce(
                *[
                    F.when(v.isNotNull(), F.struct(s.alias("step"), v.alias("v")))
                    for s, v in (
                        (F.col("step"), value(c, F.col("step"), True)),
                        (F.col("step") + 1, F.when(until > F.col("step"), value(c, F.col("step") + 1, False))),
                    )
                ]
            )
        )
        for c in columns
    }
    if small:
        filled = lined.withColumns({name: first.over(whole)["v"] for name, first in leading.items()})
    else:
        of_stay = lined.groupBy(key).agg(*[first["v"].alias(name) for name, first in leading.items()])
        filled = null_safe(lined, of_stay, [key])
    made = filled.withColumn("_at", F.explode(F.sequence("step", until)))
    here = F.col("_at") == F.col("step")
    return made.select(
        key,
        F.timestamp_micros(F.col("_origin") + F.col("_at") * F.lit(step_us)).cast(zone).alias(time),
        F.col("_at").alias("step"),
        *[
            F.coalesce(F.when(here, value(c, F.col("_at"), True)).otherwise(value(c, F.col("_at"), False)), F.col(f"lead_{c}")).alias(c)
            for c in columns
        ],
    )
