"""Model baselines on MLlib: fit, predicted probabilities, feature importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import CountVectorizerModel, Imputer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_table, planned_with
from .prefix import TASK_ROWS

# Hidden layer sizes of the perceptron.
HIDDEN_LAYERS = [128, 64]


def label_encoder(column: str, out: str | None = None) -> StringIndexer:
    """Numbers the values of a text column in alphabetic order."""
    return StringIndexer(
        inputCol=column, outputCol=out or f"{column}_idx", stringOrderType="alphabetAsc", handleInvalid="keep"
    )


def classifier(kind: str, n_features: int, total_weight: float, seed: int = 0, **params):
    """An unfitted classifier; ``params`` override its settings."""
    common = {"labelCol": "label", "featuresCol": "features"}
    if kind in ("forest", "boosting"):
        common["weightCol"] = "weight"
    if kind == "logistic":
        # A ridge penalty of strength 1 on the summed loss is 1/(sum of weights) on MLlib's mean loss.
        settings = {"regParam": 1.0 / total_weight, "standardization": False, "maxIter": 100, "weightCol": "weight"}
        return LogisticRegression(**{**common, **settings, **params})
    if kind == "forest":
        return RandomForestClassifier(**{**common, "numTrees": 100, "maxDepth": 12, "seed": seed, **params})
    if kind == "boosting":
        return GBTClassifier(**{**common, "maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": seed, **params})
    if kind == "perceptron":
        layers = [n_features, *HIDDEN_LAYERS, 2]
        return MultilayerPerceptronClassifier(**{**common, "layers": layers, "maxIter": 100, "seed": seed, **params})
    raise ValueError("kind must be 'logistic', 'forest', 'boosting' or 'perceptron'")


def is_text(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() == "string"


def prepare(df: DataFrame, variables: Sequence[str], outcome: str) -> DataFrame:
    """Numbers only: flags become 0/1 and the outcome ``label``; rows keep their other columns."""
    numbers = {c: F.col(c).cast("double") for c in variables if not is_text(df, c)}
    return df.withColumns({**numbers, "label": F.col(outcome).cast("double"), "weight": F.lit(1.0)})


def code_vocabulary(df: DataFrame, code_list: str) -> list[str]:
    """All codes of a list column, the most frequent first and equals by code; none is cut."""
    counts = df.select(F.explode(code_list).alias("code")).filter(F.col("code").isNotNull()).groupBy("code").count()
    return [row["code"] for row in counts.orderBy(F.desc("count"), "code").collect()]


def feature_stages(df: DataFrame, variables: Sequence[str], code_list: str | None = None) -> list:
    """Encoders for text columns and code lists, medians for missing numbers, then one vector.

    No row is left out, in the fit or in a prediction, and every code is a feature.
    """
    text = [c for c in variables if is_text(df, c)]
    numbers = [c for c in variables if c not in text]
    stages = [label_encoder(c) for c in text]
    given = df.agg(*[F.count(F.nanvl(F.col(c), F.lit(None))).alias(c) for c in numbers]).first() if numbers else {}
    some = [c for c in numbers if given[c]]
    if some:
        stages.append(Imputer(inputCols=some, outputCols=[f"{c}_filled" for c in some], strategy="median"))
    if empty := [c for c in numbers if not given[c]]:
        # A column without any value has no median and says nothing: 0 in every row.
        zeros = ", ".join(f"cast(0 as double) AS `{c}_filled`" for c in empty)
        stages.append(SQLTransformer(statement=f"SELECT *, {zeros} FROM __THIS__"))
    inputs = [f"{c}_idx" if c in text else f"{c}_filled" for c in variables]
    # Counted by columns, as the fit of CountVectorizer makes an object of every row. Lists without any code are no feature.
    if code_list and (vocabulary := code_vocabulary(df, code_list)):
        stages.append(CountVectorizerModel.from_vocabulary(vocabulary, inputCol=code_list, outputCol="_codes", binary=True))
        inputs.append("_codes")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


#: How much of its files a task reads.
READ_BYTES = "spark.sql.files.maxPartitionBytes"


def weight_and_reads(rows: DataFrame) -> tuple[float, dict[str, str]]:
    """The total ``weight``, and settings under which a task reads about ``TASK_ROWS`` of the rows' files at most.

    A row with code lists is short in a compressed file and long as a vector, so a task that
    reads many of them would hold a large part of all vectors at once.
    """
    spark = rows.sparkSession
    by_task = rows.groupBy(F.spark_partition_id().alias("_task")).agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n"))
    total, most = by_task.agg(F.sum("_w"), F.max("_n")).first()
    if (most or 0) <= TASK_ROWS:
        return total, {}
    usual = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(READ_BYTES))
    return total, {READ_BYTES: str(max(usual * TASK_ROWS // most, 1 << 20))}


def fit_model(
    train: DataFrame,
    variables: Sequence[str],
    outcome: str,
    kind: str,
    seed: int = 0,
    code_list: str | None = None,
    positive_weight: float = 1.0,
    **params,
) -> PipelineModel:
    """Fits encoders and one classifier. ``code_list`` adds an array column as 0/1 code features."""
    if kind == "perceptron" and positive_weight != 1.0:
        raise ValueError("the perceptron takes no weights")
    prepared = prepare(train, variables, outcome)
    prepared = prepared.withColumn("weight", F.when(F.col("label") == 1, positive_weight).otherwise(1.0))
    features = Pipeline(stages=feature_stages(prepared, variables, code_list)).fit(prepared)
    total_weight, reads = weight_and_reads(prepared)
    with planned_with(train.sparkSession, reads):
        rows = features.transform(prepared).select("features", "label", "weight")
        if kind == "logistic":
            # It reads the rows twice and then keeps blocks of them; kept rows would lie beside these, in memory and on disk.
            model = classifier(kind, 0, total_weight, seed, **params).fit(rows)
            return PipelineModel(stages=[*features.stages, model])
        rows.persist()
        try:
            # A count keeps all rows in parallel; a first row alone would have one task make its whole part.
            rows.count()
            n_features = len(rows.first()["features"])
            model = classifier(kind, n_features, total_weight, seed, **params).fit(rows)
        finally:
            rows.unpersist()
    return PipelineModel(stages=[*features.stages, model])


def predict(model: PipelineModel, test: DataFrame, variables: Sequence[str], outcome: str, keep: Sequence[str]) -> DataFrame:
    """Rows (keep, ``label``, ``score``): the probability of the positive class."""
    scored = model.transform(prepare(test, variables, outcome))
    return scored.select(*keep, F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))


def importance_ranking(model: PipelineModel, variables: Sequence[str], df: DataFrame) -> DataFrame:
    """Feature importances of a tree model, greatest first (one row per variable)."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(v, float(w)) for v, w in zip(variables, weights)]
    ranked = local_table(df.sparkSession, rows, "variable string, importance double")
    return ranked.orderBy(F.desc("importance"), "variable")
