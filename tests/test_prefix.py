import random
import statistics

import pytest
from pyspark.sql import functions as F

from wardlake.operators.prefix import exact_medians, rank_blocks, running_totals


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_totals(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("aab"), rng.randint(-20, 20), rng.randint(0, 5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v long, n long")
    out = running_totals(df, ["g"], "v", ["n"], F.floor(F.col("v") / width), with_next=True).collect()
    assert len(out) == len({(g, v) for g, v, _ in rows})
    for r in out:
        mine = [x for x in rows if x[0] == r["g"]]
        assert r["n"] == sum(n for _, v, n in mine if v == r["v"])
        assert r["n_before"] == sum(n for _, v, n in mine if v < r["v"])
        assert r["n_total"] == sum(n for _, _, n in mine)
        above = sorted({v for _, v, _ in mine if v > r["v"]})
        assert r["next_v"] == (above[0] if above else None)
        assert r["next_n"] == (sum(n for _, v, n in mine if v == above[0]) if above else None)


def test_exact_medians_skip_missing_and_nan(spark):
    rows = [(1.0, None), (2.0, 5.0), (None, float("nan")), (4.0, 7.0), (10.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r["variable"]: r["median"] for r in exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": 3.0, "b": 6.0}


def test_exact_median_of_one_hot_value(spark):
    values = [3.0] * 400 + [float(i) for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_medians(df, ["x"]).first()["median"] == statistics.median(values)


def test_rank_blocks_are_monotone(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("x"))
    rows = sorted((r["x"], r["x_block"]) for r in rank_blocks(df, ["x"], 16).collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows)
    assert len({b for _, b in rows}) > 8
