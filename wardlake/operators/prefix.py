"""Ordered running totals whose tasks stay small when one group is huge.

A plain ``Window.partitionBy(group)`` puts a whole group into one task. Here a group
is cut into blocks along its order. Rows with the same group and order value are
merged first (on the map side), each block is scanned by its own task, and the
totals of the earlier blocks are carried in from a small per-block table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isfinite
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import RELEASE, planned_with

#: A group with at most this many rows is left to one task of a plain window.
HOT_ROWS = 4_000_000


#: Rows that one task of a keyed step gets, where the number of rows is known.
TASK_ROWS = 250_000
#: Smaller tables are not cut into tasks of fewer rows than this.
LEAST_ROWS = 10_000


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group of ``by``, and of all groups together (one counting job)."""
    with planned_with(df.sparkSession, RELEASE):
        largest, total = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return largest or 0, total or 0


def dealt(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """``df`` dealt by ``by`` to so many tasks that each has about ``TASK_ROWS`` of its ``rows`` rows.

    What a task holds then follows from this number, not from the size of the table.
    Steps that group or order within ``by`` need no other shuffle. For small groups only.
    """
    return df.repartition(task_count(df, rows), *by)


def task_count(df: DataFrame, rows: int) -> int:
    """The number of tasks that :func:`dealt` takes for ``rows`` rows."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // TASK_ROWS), min(usual, -(-rows // LEAST_ROWS)), 1)


def has_hot_group(df: DataFrame, by: Sequence[str], limit: int = HOT_ROWS) -> bool:
    """Whether any group of ``by`` has more than ``limit`` rows (one counting job)."""
    return group_sizes(df, by)[0] > limit


def pick_strategy(strategy: str, df: DataFrame, by: Sequence[str], limit: int = HOT_ROWS) -> str:
    """``auto`` becomes ``blocks`` when a group is too large for one task, else ``window``."""
    if strategy not in ("auto", "window", "blocks"):
        raise ValueError("strategy must be 'auto', 'window' or 'blocks'")
    if strategy != "auto":
        return strategy
    return "blocks" if has_hot_group(df, by, limit) else "window"


def strategy_and_rows(strategy: str, by: str, *tables: DataFrame) -> tuple[str, int]:
    """One strategy for several tables with the same key column, ``blocks`` if any needs it, and the rows of all of them."""
    if strategy not in ("auto", "window", "blocks"):
        raise ValueError("strategy must be 'auto', 'window' or 'blocks'")
    sizes = [group_sizes(t.select(by), [by]) for t in tables]
    if strategy == "auto":
        strategy = "blocks" if max(largest for largest, _ in sizes) > HOT_ROWS else "window"
    return strategy, sum(rows for _, rows in sizes)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Sequence[str],
    block: Column | str,
    with_next: bool = False,
    small: bool = False,
) -> DataFrame:
    """One row per distinct (``by``, ``order``).

    For every column ``c`` of ``sums`` the row holds ``c`` (total of the rows with this
    order value), ``c_before`` (total of all smaller order values in the group) and
    ``c_total`` (total of the group). ``with_next`` adds ``next_<order>`` and
    ``next_<c>``, taken from the next order value of the group. ``small`` says that the
    table of block totals may be broadcast, so that the rows stay where they are.

    Rows without a group or a block are left out. ``block`` must never fall while ``order`` rises; how even the blocks are decides the
    task sizes, never the result.
    """
    block = F.col(block) if isinstance(block, str) else block
    keys = [*by, "_block"]
    # Both uses of the grid get the same null filter, so the second one reuses its shuffle.
    usable = reduce(and_, [F.col(c).isNotNull() for c in keys])
    placed = df.select(*by, order, *sums, block.alias("_block")).filter(usable)
    grid = placed.groupBy(*keys, order).agg(*[F.sum(c).alias(c) for c in sums])

    first_row = F.min(F.struct(order, *sums)).alias("_first")
    per_block = grid.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], first_row)
    along = Window.partitionBy(*by).orderBy("_block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carried = per_block.select(
        *keys,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_carried") for c in sums],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums],
        *([F.lead("_first").over(along).alias("_next_block")] if with_next else []),
    )

    inside = Window.partitionBy(*keys).orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    scanned = grid.select(
        *keys,
        order,
        *sums,
        *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"_{c}_inside") for c in sums],
        *([F.lead(F.struct(order, *sums)).over(inside).alias("_next_inside")] if with_next else []),
    )
    joined = scanned.join(F.broadcast(carried) if small else carried, keys)
    out = [
        *by,
        order,
        *sums,
        *[(F.col(f"_{c}_carried") + F.col(f"_{c}_inside")).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums],
    ]
    if with_next:
        following = F.coalesce("_next_inside", "_next_block")
        out += [following[c].alias(f"next_{c}") for c in (order, *sums)]
    return joined.select(*out)


def block_count(df: DataFrame) -> int:
    """Four blocks per shuffle partition, within limits a driver-side edge list can bear."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(4 * partitions, 64), 4096)


def rank_blocks(df: DataFrame, values: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Adds ``<value>_block``: the number of the evenly filled value range a row falls in.

    Range edges come from the distributed quantile sketch (one job, at most ``blocks``
    numbers per column reach the driver). NULL values get a NULL block.
    """
    blocks = blocks or block_count(df)
    doubles = df.withColumns({v: F.col(v).cast("double") for v in values})
    probabilities = [i / blocks for i in range(1, blocks)]
    edges = doubles.approxQuantile(list(values), probabilities, 1.0 / (4 * blocks))
    inner = {v: sorted({x for x in e if isfinite(x)}) for v, e in zip(values, edges)}
    # A column without a finite value (empty, all NULL, all infinite) has one block.
    cut = [v for v in values if inner[v]]
    bucketed = doubles.withColumns({f"{v}_block": F.lit(0) for v in values if not inner[v]})
    if cut:
        bucketizer = Bucketizer(
            splitsArray=[[-float("inf"), *inner[v], float("inf")] for v in cut],
            inputCols=cut,
            outputCols=[f"{v}_block" for v in cut],
            handleInvalid="keep",
        )
        bucketed = bucketizer.transform(bucketed)
    return bucketed.withColumns(
        {f"{v}_block": F.when(F.col(v).isNotNull(), F.col(f"{v}_block").cast("int")) for v in values}
    )


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys come from ``left``."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, reduce(and_, same), how).drop(*[f"_r_{k}" for k in keys])


def grouped_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows (``keys``, ``variable``, ``median``): exact medians per group, missing values skipped.

    Rank selection in two steps: rows are counted per group and value block (on the map
    side first), which tells the block that holds the middle; only values of that block
    are counted one by one. A group is never gathered, however large it is: a block holds
    about as many rows of all groups together as any other. Groups without a value have
    no row.
    """
    if not columns:
        raise ValueError("no columns")
    ranked = rank_blocks(df.select(*keys, *columns), columns, blocks)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.col(c).alias("_value"), F.col(f"{c}_block").alias("_cell"))
            for c in columns
        ]
    )
    long = ranked.select(*keys, F.inline(cells)).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    group = [*keys, "variable"]
    along = Window.partitionBy(*group).orderBy("_cell")
    counted = long.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.select(
        "*",
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_all"),
    )
    # Ranks start at 1; an even count takes the mean of its two middle values.
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = lambda rank: (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_n"))
    middle = counted.filter(holds(low) | holds(high)).drop("_n")
    values = null_safe(long, middle, [*group, "_cell"]).groupBy(*group, "_cell", "_value").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_base"), F.first("_all").alias("_all")
    )
    inside = Window.partitionBy(*group, "_cell").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return (
        values.filter(holds(low) | holds(high))
        .groupBy(*group)
        .agg(((F.min("_value") + F.max("_value")) / 2).alias("median"))
    )


def exact_medians(df: DataFrame, columns: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows (``variable``, ``median``) for every column; the median of a column without values is NULL."""
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("variable")
    every = df.sparkSession.range(1).select(names)
    return every.join(grouped_medians(df, [], columns, blocks), "variable", "left")


def carried(df: DataFrame, by: Sequence[str], order: str, block: Column, past: Sequence[str], following: Sequence[str]) -> DataFrame:
    """``df`` with ``past_<c>``, the last value of ``c`` in an earlier row, and ``next_<c>``, the first in a later one.

    NULL values are passed over. (``by``, ``order``) is unique. Rows are scanned per
    ``block`` (which must not fall while ``order`` rises), and what a block hands on comes
    from a table with one row per block, so no task holds a whole group.
    """
    keys = [*by, "_block"]
    rows = df.withColumn("_block", block)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ahead, back = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.desc(order))
    # Looking ahead is a growing frame on the reversed order: one step per row.
    scanned = rows.select(
        "*",
        *[F.last(c, ignorenulls=True).over(earlier(ahead)).alias(f"_in_past_{c}") for c in past],
        *[F.last(c, ignorenulls=True).over(earlier(back)).alias(f"_in_next_{c}") for c in following],
    )
    held = lambda c: F.when(F.col(c).isNotNull(), F.struct(order, F.col(c).alias("v")))
    ends = rows.groupBy(*keys).agg(
        *[F.max(held(c))["v"].alias(f"_last_{c}") for c in past], *[F.min(held(c))["v"].alias(f"_first_{c}") for c in following]
    )
    along, against = Window.partitionBy(*by).orderBy("_block"), Window.partitionBy(*by).orderBy(F.desc("_block"))
    handed = ends.select(
        *keys,
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier(along)).alias(f"_on_past_{c}") for c in past],
        *[F.last(f"_first_{c}", ignorenulls=True).over(earlier(against)).alias(f"_on_next_{c}") for c in following],
    )
    joined = null_safe(scanned, handed, keys)
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_in_past_{c}", f"_on_past_{c}").alias(f"past_{c}") for c in past],
        *[F.coalesce(f"_in_next_{c}", f"_on_next_{c}").alias(f"next_{c}") for c in following],
    )
