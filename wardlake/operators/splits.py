"""Repeatable splits, anonymous column names, missing-value reports and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vitals import VITAL_LIMITS, Limits, family, family_columns
from ..session import materialize
from .prefix import exact_medians


def hash_share(key: str | Column, seed: int | str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only (six digits)."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) / 1_000_000


def split_name(key: str, test_seed: int = 42, valid_seed: int | None = 10, train: float = 0.8, valid: float = 0.5) -> Column:
    """``train``, ``valid`` or ``test`` per row: by hash, so it needs no shuffle and never changes.

    With ``valid_seed=None`` there are only ``train`` and ``test``.
    """
    rest = F.lit("test")
    if valid_seed is not None:
        rest = F.when(hash_share(key, valid_seed) < valid, "valid").otherwise("test")
    return F.when(hash_share(key, test_seed) < train, "train").otherwise(rest)


def split_parts(df: DataFrame, key: str, written: bool = False, **how) -> dict[str, DataFrame]:
    """The parts of :func:`split_name`; ``written``: rows are marked and written once for all later reads."""
    marked = df.withColumn("_part", split_name(key, **how))
    marked = materialize(marked) if written else marked
    names = ["train", "test"] if how.get("valid_seed", 10) is None else ["train", "valid", "test"]
    return {n: marked.filter(F.col("_part") == n).drop("_part") for n in names}


#: Bits of a key's hash, and bits that one counting round decides.
HASH_BITS, ROUND_BITS = 60, 12


def hash_number(key: str | Column, seed: int | str) -> Column:
    """A whole number of ``HASH_BITS`` bits that depends on the key and the seed only."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def nth_hashes(df: DataFrame, number: Column, ranks: Sequence[int]) -> list[int]:
    """For every rank n the least number that at least n rows do not exceed (-1 for rank 0).

    Each round counts the rows of the number ranges still in question by their next bits,
    exactly and on the map side first; at most 4,096 counts a rank reach the driver.
    """
    hashed = df.select(number.alias("h"))
    prefix, before = [0] * len(ranks), [0] * len(ranks)
    for shift in range(HASH_BITS - ROUND_BITS, -1, -ROUND_BITS):
        live = sorted({p for p, n in zip(prefix, ranks) if n > 0})
        if not live:
            break
        place = F.shiftright("h", shift)
        counts = hashed.filter(F.shiftright("h", shift + ROUND_BITS).isin(live)).groupBy(place.alias("p")).count().collect()
        counts = sorted((r.p, r["count"]) for r in counts)
        for i, n in enumerate(ranks):
            for p, count in counts if n > 0 else ():
                if p >> ROUND_BITS != prefix[i]:
                    continue
                if before[i] + count >= n:
                    prefix[i] = p
                    break
                before[i] += count
    return [p if n > 0 else -1 for p, n in zip(prefix, ranks)]


def exact_split(df: DataFrame, key: str, shares: Mapping[str, float], seed: int = 42) -> DataFrame:
    """``df`` with ``part``: parts that have their shares to the row, the same on any partitioning.

    Rows are taken in the order of a hash of the key; the cuts between parts are found by
    counting (:func:`nth_hashes`), nothing is sorted or shuffled. The last part takes what
    rounding leaves. ``key`` should be unique: rows of one key stay together, so only a
    part that ends in such a key has more rows than its share.
    """
    total, names = df.count(), list(shares)
    ends, so_far = [], 0.0
    for name in names[:-1]:
        so_far += shares[name]
        ends.append(int(total * so_far + 0.5))
    number = hash_number(key, seed)
    part = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, nth_hashes(df, number, ends)))):
        part = F.when(number <= cut, name).otherwise(part)
    return df.withColumn("part", part)


def anonymous_columns(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The features as ``feature1``, ``feature2``, ... followed by the kept columns."""
    return df.select(
        *[F.col(f"`{c}`").alias(f"feature{i}") for i, c in enumerate(features, 1)], *keep
    )


def missing_stats(df: DataFrame, columns: Sequence[str] | None = None, total: int | Column | None = None) -> DataFrame:
    """Rows (``variable``, ``n_missing``, ``share``); the share's base is the row count unless given."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]
    )
    base = F.col("_rows") if total is None else (F.lit(total) if isinstance(total, int) else total)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("n_missing")) for c in columns]))
    return counted.select(base.alias("_base"), cells.alias("x")).select(
        "x.variable", "x.n_missing", (F.col("x.n_missing") / F.col("_base")).alias("share")
    )


def outlier_counts(df: DataFrame, limits: Mapping[str, Limits] = VITAL_LIMITS) -> DataFrame:
    """Per vital column how many values fall into each of the five ranges."""
    columns = family_columns(df, limits)

    def ranges(column: str) -> list[Column]:
        x, r = F.col(column), limits[family(column)]
        return [
            x < r.outlier_low,
            (x >= r.outlier_low) & (x < r.valid_low),
            (x >= r.valid_low) & (x <= r.valid_high),
            (x > r.valid_high) & (x <= r.outlier_high),
            x > r.outlier_high,
        ]

    names = ["below_outlier_low", "outlier_to_valid_low", "valid", "valid_to_outlier_high", "above_outlier_high"]
    counted = df.agg(
        *[
            F.struct(*[F.count_if(hit).alias(n) for n, hit in zip(names, ranges(c))]).alias(c)
            for c in columns
        ]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in columns])
    return counted.select(F.explode(cells).alias("x")).select("x.variable", *[F.col(f"x.n.{n}").alias(n) for n in names])


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column (at most one number per column reaches the driver)."""
    return {row["variable"]: row["median"] for row in exact_medians(df, columns).collect()}


def fill_medians(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Missing values take the fitted median; a column whose median is missing keeps its own."""
    fitted = lambda m: F.lit(None if m is None else float(m)).cast("double")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), fitted(m)) for c, m in medians.items()})


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Positives, negatives and their ratio."""
    positive, negative = F.count_if(F.col(label).cast("boolean")), F.count_if(~F.col(label).cast("boolean"))
    return df.agg(positive.alias("n_positive"), negative.alias("n_negative")).withColumn(
        "ratio", F.try_divide("n_positive", "n_negative")
    )
