"""Exact ranking metrics: curves, areas, operating points, bootstrap intervals.

Everything starts from one row per distinct score with its positives and negatives, so
the data shrinks before it is ordered, and ordering works in blocks of the score range
(see :mod:`wardlake.operators.prefix`): no task sees the whole ranking.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import exp, factorial, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import float_text
from .prefix import block_count, rank_blocks, running_totals

GROUP = ["group"]


def long_scores(df: DataFrame, scores: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep, ``group`` = score name, ``score``, ``positive``, ``_block``) from several score columns.

    Blocks count up while scores fall. Rows without a score or a label are left out; a NaN score is an error, as it has no rank.
    """
    no_rank = lambda s: F.when(F.isnan(s), F.raise_error(F.lit(f"{s} is NaN"))).otherwise(F.col(s).cast("double"))
    df = df.select(*keep, label, *[no_rank(s).alias(s) for s in scores])
    ranked = rank_blocks(df, scores)
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("group"), F.col(s).alias("score"), (-F.col(f"{s}_block")).alias("_block"))
            for s in scores
        ]
    )
    flat = ranked.select(*keep, F.col(label).cast("int").alias("positive"), F.explode(cells).alias("x"))
    return flat.select(*keep, "positive", "x.*").filter(F.col("score").isNotNull() & F.col("positive").isNotNull())


#: Rows of a table of block totals that may be sent to every task.
SMALL_TABLE = 200_000


def cumulative(scored: DataFrame, by: Sequence[str] = GROUP, weight: Column | None = None, small: bool = False) -> DataFrame:
    """One row per (group, distinct score), highest score first:

    ``pos``/``neg`` at this score, ``tp``/``fp`` down to and with it, ``*_before`` above it,
    ``P``/``N`` in total, and the counts of the next lower score.
    """
    weight = F.lit(1) if weight is None else weight
    counted = scored.select(
        *by,
        (-F.col("score")).alias("down"),
        "_block",
        (F.col("positive") * weight).cast("long").alias("pos"),
        ((1 - F.col("positive")) * weight).cast("long").alias("neg"),
    )
    totals = running_totals(counted, by, "down", ["pos", "neg"], "_block", with_next=True, small=small)
    return totals.select(
        *by,
        # 0.0 - x keeps a zero score from turning into -0.0.
        (F.lit(0.0) - F.col("down")).alias("score"),
        "pos",
        "neg",
        F.col("pos_before").alias("tp_before"),
        F.col("neg_before").alias("fp_before"),
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        (F.col("neg_before") + F.col("neg")).alias("fp"),
        F.col("pos_total").alias("P"),
        F.col("neg_total").alias("N"),
        "next_pos",
        "next_neg",
    )


def _turning() -> Column:
    """The points that are not on a line with their neighbours: first, last, and every change of step."""
    first = (F.col("tp_before") == 0) & (F.col("fp_before") == 0)
    turns = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    return first | F.col("next_pos").isNull() | turns


def roc_points(curve: DataFrame, by: Sequence[str] = GROUP, drop_collinear: bool = True) -> DataFrame:
    """ROC points with the start (0, 0) at an infinite threshold.

    ``drop_collinear`` leaves out a point when the counts at the next lower score repeat
    its own (the first and the last point stay).
    """
    start = curve.groupBy(*by).agg(F.max("P").alias("P"), F.max("N").alias("N")).select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "P", "N"
    )
    kept = curve
    if drop_collinear:
        kept = curve.filter(_turning())
    points = kept.select(*by, F.col("score").alias("threshold"), "tp", "fp", "P", "N")
    return start.unionByName(points).select(
        *by,
        "threshold",
        "tp",
        "fp",
        F.try_divide("fp", "N").alias("fpr"),
        F.try_divide("tp", "P").alias("tpr"),
    )


def pr_points(curve: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Precision and recall at every distinct score, and the end point (1, 0)."""
    points = curve.select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide("tp", "P"), F.lit(1.0)).alias("recall"),
    )
    end = curve.select(*by).distinct().select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def ranking_metrics(curve: DataFrame, by: Sequence[str] = GROUP, drop_collinear: bool = True) -> DataFrame:
    """Per group: auroc, ap, and sensitivity, specificity, threshold at the best point.

    The best point has the least distance to (0, 1); the highest threshold wins a tie. A
    group with one class only has NULL metrics.
    """
    tied = F.col("neg") * (F.col("tp_before") + F.col("pos") / 2)
    fpr, tpr = F.try_divide("fp", "N"), F.try_divide("tp", "P")
    distance = F.sqrt(fpr * fpr + (1 - tpr) * (1 - tpr))
    point = F.struct(
        distance.alias("distance"), (-F.col("score")).alias("down"), tpr.alias("tpr"), fpr.alias("fpr")
    )
    candidate = F.when(_turning(), point) if drop_collinear else point
    # One pass: both areas and the best point come from the same scan of the curve.
    folded = curve.groupBy(*by).agg(
        F.max("P").alias("P"),
        F.max("N").alias("N"),
        F.sum(tied).alias("_won"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
        F.min(candidate).alias("_best"),
    )
    both = (F.col("P") > 0) & (F.col("N") > 0)
    # The start of the curve has distance 1 and comes first, so it wins a tie.
    started = F.col("_best.distance") >= 1
    return folded.select(
        *by,
        F.col("P").alias("n_positive"),
        F.col("N").alias("n_negative"),
        F.when(both, F.try_divide(F.col("_won"), F.col("P").cast("double") * F.col("N"))).alias("auroc"),
        F.when(both, F.try_divide(F.col("_ap"), F.col("P"))).alias("ap"),
        F.when(both, F.when(started, 0.0).otherwise(F.col("_best.tpr"))).alias("sensitivity"),
        F.when(both, F.when(started, 1.0).otherwise(1 - F.col("_best.fpr"))).alias("specificity"),
        F.when(both, F.when(started, float("inf")).otherwise(0.0 - F.col("_best.down"))).alias("threshold"),
    )


def score_metrics(df: DataFrame, scores: Sequence[str], label: str) -> DataFrame:
    """Metrics of several score columns against one label, one row per score."""
    return ranking_metrics(cumulative(long_scores(df, scores, label)))


def confusion(df: DataFrame, predicted: Column, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy-free: tp, fp, fn, tn and F1 (0 without any hit)."""
    p, y = predicted.cast("boolean"), label.cast("boolean")
    counted = df.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"),
        F.count_if(~p & ~y).alias("tn"),
    )
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counted.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


#: Cells of up to so many rows draw their count by inversion, larger ones from a normal deviate.
SMALL_CELL = 30


def poisson_shares(mean: int) -> list[float]:
    """P(count <= k) of a Poisson count for k = 0, 1, 2, ... up to where 32 random bits tell no further count apart."""
    shares = list(accumulate(exp(-mean) * mean**k / factorial(k) for k in range(mean + 80)))
    return shares[: next(i for i, x in enumerate(shares) if 1 - x < 2**-33) + 1]


#: The shares of a single row's count.
POISSON_ONE = poisson_shares(1)


def score_cells(scored: DataFrame, key: str) -> DataFrame:
    """One row per (group, score, label) with its number of rows ``n`` and its least ``key``."""
    return scored.groupBy("group", "_block", "score", "positive").agg(
        F.count(F.lit(1)).alias("n"), F.min(key).cast("string").alias("_key")
    )


def bootstrap_weights(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Every cell once per replicate with the number of its rows that are drawn, above zero.

    Poisson(1) counts of n rows add up to a Poisson(n) count, so a cell is drawn as a
    whole: by inversion if n is small, else by a normal deviate with the skewness put
    right. Draws come from a hash of (seed, replicate, least key of the cell): a lost task
    draws the same again. Replicates are made after the shuffle to score blocks and stay there.
    """
    drawn = cells.repartition("group", "_block").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    text = F.concat(F.lit(f"{seed}:"), F.col("replicate").cast("string"), F.lit(":"), F.coalesce("_key", F.lit("")))
    drawn = drawn.withColumn("_digest", F.md5(text))
    bits = lambda first: F.conv(F.substring("_digest", first, 8), 16, 10).cast("double")
    table = F.array(*[F.array(*[F.lit(x) for x in poisson_shares(n)]) for n in range(1, SMALL_CELL + 1)])
    uniform = bits(1) / float(2**32)
    few = F.size(F.filter(F.get(table, F.col("n").cast("int") - 1), lambda share: uniform >= share))
    z = F.sqrt(-2 * F.log((bits(1) + 0.5) / float(2**32))) * F.cos(2 * pi * bits(9) / float(2**32))
    many = F.greatest(F.lit(0), F.floor(F.col("n") + F.sqrt("n") * z + (z * z - 1) / 6 + 0.5))
    weight = F.when(F.col("n") <= SMALL_CELL, few).otherwise(many)
    return drawn.withColumn("weight", weight.cast("long")).filter("weight > 0").drop("_digest")


def row_weights(df: DataFrame, scores: Sequence[str], label: str, key: str, replicates: int, seed: int) -> DataFrame:
    """Every cell once per replicate with the summed Poisson(1) counts of its rows, above zero.

    Each row is drawn by itself in each replicate, from a hash of (seed, replicate, key). A
    row's draws stay in one list up to the sums of its cell, so replicates never multiply
    rows, only cells.
    """

    def draw(replicate: Column) -> Column:
        text = F.concat(F.lit(f"{seed}:"), replicate.cast("string"), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit("")))
        uniform = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)
        return sum([F.when(uniform >= edge, 1).otherwise(0) for edge in POISSON_ONE], F.lit(0))

    drawn = df.withColumn("_draws", F.transform(F.sequence(F.lit(1), F.lit(replicates)), draw))
    rows = long_scores(drawn, scores, label, keep=["_draws"])
    cells = rows.groupBy("group", "_block", "score", "positive").agg(
        F.array(*[F.sum(F.get("_draws", F.lit(i))) for i in range(replicates)]).alias("_draws")
    )
    made = cells.repartition("group", "_block").select(
        "group", "_block", "score", "positive", F.posexplode("_draws").alias("replicate", "weight")
    )
    return made.withColumn("replicate", F.col("replicate") + 1).filter("weight > 0")


METRICS = ["auroc", "ap", "sensitivity", "specificity"]


def bootstrap_replicates(
    df: DataFrame, scores: Sequence[str], label: str, key: str, replicates: int = 200, seed: int = 10, draw: str = "rows"
) -> DataFrame:
    """Metrics of every bootstrap replicate; replicates with one class only are left out.

    ``draw`` says whether every row is drawn by itself (``rows``) or all equal rows of a
    cell with one count (``cells``).
    """
    if draw not in ("rows", "cells"):
        raise ValueError("draw must be 'rows' or 'cells'")
    by = ["group", "replicate"]
    if draw == "rows":
        drawn = row_weights(df, scores, label, key, replicates, seed)
    else:
        drawn = bootstrap_weights(score_cells(long_scores(df, scores, label, keep=[key]), key), replicates, seed)
    # What blocks hand on has a row per block, score column and replicate.
    small = block_count(df) * len(scores) * replicates <= SMALL_TABLE
    curve = cumulative(drawn, by, F.col("weight"), small)
    return ranking_metrics(curve, by).filter("auroc is not null")


def bootstrap_intervals(
    df: DataFrame, scores: Sequence[str], label: str, key: str, replicates: int = 200, seed: int = 10, level: float = 95, draw: str = "rows"
) -> DataFrame:
    """Percentile interval and standard deviation of each metric, one row per score."""
    low, high = (100 - level) / 200, 1 - (100 - level) / 200
    runs = bootstrap_replicates(df, scores, label, key, replicates, seed, draw)
    # One group holds one row per replicate, so the exact percentile stays small.
    return runs.groupBy("group").agg(
        *[
            part
            for m in METRICS
            for part in (
                F.percentile(m, low).alias(f"lower_{m}"),
                F.percentile(m, high).alias(f"upper_{m}"),
                F.stddev_pop(m).alias(f"std_{m}"),
            )
        ]
    )


def evaluate_scores(
    df: DataFrame, scores: Sequence[str], label: str, key: str, replicates: int = 20, seed: int = 0, level: float = 95, draw: str = "rows"
) -> DataFrame:
    """Metrics with their intervals, one row per score column."""
    return score_metrics(df, scores, label).join(
        bootstrap_intervals(df, scores, label, key, replicates, seed, level, draw), "group"
    )


def formatted_results(results: DataFrame) -> DataFrame:
    """Report strings ``value (low-high)``, three decimals."""
    text = lambda c: float_text(F.round(F.col(c), 3))
    names = {"auroc": "AUROC", "ap": "AUPRC", "sensitivity": "Sensitivity", "specificity": "Specificity"}
    return results.select(
        F.col("group").alias("Model"),
        F.round("threshold", 3).alias("Threshold"),
        *[
            F.concat(text(m), F.lit(" ("), text(f"lower_{m}"), F.lit("-"), text(f"upper_{m}"), F.lit(")")).alias(out)
            for m, out in names.items()
        ],
    )
