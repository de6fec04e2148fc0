import hashlib
import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from wardlake.checks import load_queries
from wardlake.operators import metrics, models, splits
from wardlake.plans import master, tasks

QUERIES, _ = load_queries()


def scored(spark, rows):
    return spark.createDataFrame([(i, float(s), y) for i, (s, y) in enumerate(rows)], "id long, score double, y int")


def one(spark, rows, **how):
    df = scored(spark, rows)
    return metrics.ranking_metrics(metrics.cumulative(metrics.long_scores(df, ["score"], "y")), **how).first()


def test_auroc_equals_the_exact_evaluator(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 30), int(rng.random() < 0.3)) for _ in range(500)]
    exact = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(
        scored(spark, rows).withColumn("y", F.col("y").cast("double"))
    )
    assert math.isclose(one(spark, rows)["auroc"], exact, abs_tol=1e-12)
    mirrored = one(spark, [(-s, y) for s, y in rows])["auroc"]
    assert math.isclose(mirrored, 1 - exact, abs_tol=1e-12)


def test_average_precision_by_hand(spark):
    r = one(spark, [(4, 1), (3, 0), (2, 1), (1, 0)])
    assert math.isclose(r["ap"], 0.5 * 1 + 0.5 * 2 / 3)
    assert r["auroc"] == 0.75


def test_equal_scores_and_one_class(spark):
    r = one(spark, [(1, 1), (1, 0), (1, 0)])
    assert r["auroc"] == 0.5 and math.isclose(r["ap"], 1 / 3)
    assert one(spark, [(1, 1), (2, 1)])["auroc"] is None


def test_the_highest_threshold_wins_a_tie(spark):
    r = one(spark, [(3, 1), (2, 0), (1, 1), (0, 0)])
    assert (r["threshold"], r["sensitivity"], r["specificity"]) == (3.0, 0.5, 1.0)


def test_collinear_points_are_dropped(spark):
    curve = metrics.cumulative(metrics.long_scores(scored(spark, [(4, 1), (3, 1), (2, 1), (1, 0), (0, 0)]), ["score"], "y"))
    kept = sorted((r["fp"], r["tp"]) for r in metrics.roc_points(curve).collect())
    assert kept == [(0, 0), (0, 1), (0, 3), (2, 3)]
    assert metrics.roc_points(curve, drop_collinear=False).count() == 6


def test_bootstrap_draws_cells_as_poisson_counts(spark):
    """Cells of 1, 30 and 5,000 rows; many replicates; the same on any partitioning."""
    sizes = {1: 40, 30: 20, 5000: 4}
    cells = [("g", 0, float(n * 1000 + i), i % 2, n, str(n * 1000 + i)) for n, m in sizes.items() for i in range(m)]
    frame = spark.createDataFrame(cells, "group string, _block int, score double, positive int, n long, _key string")
    drawn = metrics.bootstrap_weights(frame, 150, 10)
    got = {}
    for r in drawn.collect():
        got.setdefault(r.n, []).append(r.weight)
    for n, m in sizes.items():
        draws = got[n] + [0] * (150 * m - len(got[n]))
        mean = sum(draws) / len(draws)
        spread = sum((x - mean) ** 2 for x in draws) / len(draws)
        assert abs(mean - n) < 4 * (n / len(draws)) ** 0.5
        assert 0.8 < spread / n < 1.25
    again = metrics.bootstrap_weights(frame.repartition(7), 150, 10)
    assert drawn.exceptAll(again).count() == 0


def poisson_by_hand(seed, replicate, key):
    uniform = int(hashlib.md5(f"{seed}:{replicate}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    count, term = 0, math.exp(-1)
    share = term
    while uniform >= share and count < 40:
        count += 1
        term /= count
        share += term
    return count


def test_bootstrap_draws_every_row_by_itself(spark):
    """Cells of 1, 20 and 300 equal rows: the count of a cell is the sum of its rows' own draws."""
    rows = [(i, 1.0 if i < 300 else 2.0 if i < 320 else 3.0, i % 2) for i in range(321)]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    got = {(r.score, r.positive, r.replicate): r.weight for r in metrics.row_weights(df, ["score"], "y", "id", 7, 10).collect()}
    want = {}
    for i, score, y in rows:
        for rep in range(1, 8):
            want[score, y, rep] = want.get((score, y, rep), 0) + poisson_by_hand(10, rep, i)
    assert got == {k: v for k, v in want.items() if v}


def test_replicates_are_drawn_by_rows(spark):
    """Many equal scores: the positives of a replicate are those drawn row by row."""
    rows = [(i, float(i % 3), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    got = {r.replicate: (r.n_positive, r.n_negative) for r in metrics.bootstrap_replicates(df, ["score"], "y", "id", 5, 10).collect()}
    count = lambda rep, y: sum(poisson_by_hand(10, rep, i) for i, _, label in rows if label == y)
    assert got == {rep: (count(rep, 1), count(rep, 0)) for rep in range(1, 6)}


def test_results_have_intervals_of_row_draws(spark):
    rows = [(i, float(i % 3), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    got = metrics.evaluate_scores(df, ["score"], "y", "id", 6, 10).first()
    runs = [r.auroc for r in metrics.bootstrap_replicates(df, ["score"], "y", "id", 6, 10, draw="rows").collect()]
    assert math.isclose(got["std_auroc"], (sum(x * x for x in runs) / 6 - (sum(runs) / 6) ** 2) ** 0.5, rel_tol=1e-6)


def test_cells_hold_all_rows(spark):
    rows = [(0, 1.5, 1), (1, 1.5, 1), (2, 1.5, 0), (3, 2.0, 0), (4, None, 1), (5, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    cells = metrics.score_cells(metrics.long_scores(df, ["score"], "y", keep=["id"]), "id").collect()
    assert sorted((r.score, r.positive, r.n, r._key) for r in cells) == [(1.5, 0, 1, "2"), (1.5, 1, 2, "0"), (2.0, 0, 1, "3")]


def test_intervals_hold_the_estimate(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(y, 1), y) for y in (0, 1) for _ in range(150)]
    r = metrics.evaluate_scores(scored(spark, rows), ["score"], "y", "id", replicates=30).first()
    assert r["lower_auroc"] < r["auroc"] < r["upper_auroc"] and r["std_ap"] > 0
    text = metrics.formatted_results(spark.createDataFrame([r])).first()
    assert text["Model"] == "score" and text["AUROC"].count("-") == 1


def test_confusion_without_a_hit(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "p int, y int")
    r = metrics.confusion(df, F.col("p"), F.col("y")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) == (0, 0, 1, 1, 0.0)


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(5000)
    parts = splits.split_parts(df, "id")
    counts = {n: p.count() for n, p in parts.items()}
    assert sum(counts.values()) == 5000
    assert 3800 < counts["train"] < 4200 and 400 < counts["valid"] < 600
    seen = parts["train"].union(parts["valid"]).union(parts["test"])
    assert seen.distinct().count() == 5000


def test_imputation_is_fitted_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    test = spark.createDataFrame([(100.0,), (None,)], "v double")
    fitted = splits.fit_medians(train, ["v"])
    assert fitted == {"v": 2.0}
    assert sorted(r["v"] for r in splits.fill_medians(test, fitted).collect()) == [2.0, 100.0]


@pytest.mark.parametrize("total, share", [(None, 0.5), (8, 0.25)])
def test_missing_share_base(spark, total, share):
    df = spark.createDataFrame([(1, None), (None, None), (2, 1), (None, 1)], "a int, b int")
    assert {r["share"] for r in splits.missing_stats(df, total=total).collect()} == {share}


def test_infinite_scores_rank_first_and_last(spark):
    inf = float("inf")
    rows = [(i, x, y) for i, (x, y) in enumerate([(inf, 1), (inf, 1), (0.5, 0), (0.2, 1), (-inf, 0), (-inf, 0)] * 5)]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    got = metrics.ranking_metrics(metrics.cumulative(metrics.long_scores(df, ["score"], "label"))).first()
    plain = df.replace({inf: 9.0, -inf: -9.0}, subset="score")
    want = metrics.ranking_metrics(metrics.cumulative(metrics.long_scores(plain, ["score"], "label"))).first()
    assert got.auroc == want.auroc and got.ap == want.ap


def test_nan_scores_are_refused(spark):
    df = spark.createDataFrame([(1, float("nan"), 1), (2, 0.5, 0)], "id long, score double, label int")
    with pytest.raises(Exception, match="is NaN"):
        metrics.long_scores(df, ["score"], "label").collect()


def test_parts_are_written_once_for_all_reads(spark):
    df = spark.range(200).selectExpr("id", "id % 7 AS x")
    plain, written = splits.split_parts(df, "id"), splits.split_parts(df, "id", written=True)
    for name in plain:
        assert sorted(written[name].collect()) == sorted(plain[name].collect())
        assert "md5" not in written[name]._jdf.queryExecution().optimizedPlan().toString()


def test_code_lists_as_features(spark):
    lists = [["b", "a"], ["a"], ["c", "a"], None, [], ["c"], ["e", "d"]] * 4
    df = spark.createDataFrame([(float(i % 5), c, i % 2) for i, c in enumerate(lists)], "x double, codes array<string>, y int")
    # The most frequent code first, equals in code order, none cut.
    assert models.code_vocabulary(df, "codes") == ["a", "c", "b", "d", "e"]
    df = df.filter("codes IS NOT NULL")
    model = models.fit_model(df, ["x"], "y", "logistic", code_list="codes")
    features = [r["features"].toArray().tolist() for r in model.transform(models.prepare(df, ["x"], "y")).collect()]
    assert sorted(f[1:] for f in features) == sorted([float(v in c) for v in "acbde"] for c in lists if c is not None)
    empty = df.withColumn("codes", F.array().cast("array<string>"))
    assert models.predict(models.fit_model(empty, ["x"], "y", "logistic", code_list="codes"), empty, ["x"], "y", ["x"]).count() == df.count()


def test_a_logistic_fit_keeps_no_rows_beside_its_blocks(spark, tmp_path, monkeypatch):
    """The rows are not kept by the fit, and a task reads about ``TASK_ROWS`` of them with unchanged settings after."""
    path, usual = str(tmp_path / "rows"), spark.conf.get(models.READ_BYTES)
    made = spark.range(0, 4000, 1, 8).selectExpr("id", "cast(id % 7 as double) AS x", "array(cast(id % 5 as string)) AS codes", "id % 3 = 0 AS y")
    made.write.parquet(path)
    spark.conf.set(models.READ_BYTES, "64m")
    seen, fitted = [], models.classifier
    whole = models.fit_model(spark.read.parquet(path), ["x"], "y", "logistic", code_list="codes", positive_weight=2.0)

    def watched(*given, **params):
        estimator = fitted(*given, **params)
        fit = estimator.fit

        def watch(rows):
            seen.append((rows.storageLevel.useMemory, given[2], int(spark.conf.get(models.READ_BYTES))))
            return fit(rows)

        estimator.fit = watch
        return estimator

    monkeypatch.setattr(models, "classifier", watched)
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    try:
        model = models.fit_model(spark.read.parquet(path), ["x"], "y", "logistic", code_list="codes", positive_weight=2.0)
        assert spark.conf.get(models.READ_BYTES) == "64m"
    finally:
        spark.conf.set(models.READ_BYTES, usual)
    (kept, weight, reads), = seen
    assert not kept and weight == 1334 * 2 + 2666 and reads < 64 << 20
    assert all(abs(a - b) < 1e-9 for a, b in zip(model.stages[-1].coefficients, whole.stages[-1].coefficients))


def test_task_models_are_fitted_to_the_end(spark, sf_dir, monkeypatch):
    """The four fits have the classifier's own number of iterations."""
    rows = [(i, i % 3 == 0, float(i % 7)) for i in range(200)]
    table = spark.createDataFrame(rows, "stay_id long, y boolean, x double")
    tasks_made = {n: tasks.Task(n, "y", ["x"]) for n in ("a", "b", "c", "d")}
    made, fit = [], models.fit_model
    monkeypatch.setattr(master, "written_master", lambda tables: table)
    monkeypatch.setattr(tasks, "TASKS", tasks_made)
    monkeypatch.setattr(models, "fit_model", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    QUERIES["task_models"](spark, sf_dir).collect()
    assert [m.stages[-1].getMaxIter() for m in made] == [models.classifier("logistic", 1, 1.0).getMaxIter()] * 4
