"""A pipeline over ``documents``: language, near-duplicates, repeated passages, benchmarks, packing.

Each stage takes the documents that the one before kept, decides on all of them, and
returns the columns of ``documents``; the last returns packed pieces. A stage's result
is written to the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import language_id, order_minhash, packing, substring_dedup, winnowing
from wardlake.llm.queries import tokenizer_path
from wardlake.llm.tables import let_workers_import, materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is rejected below this probability.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is unsure; learns from ``docs``.

    Rows without a ``doc_id`` are judged, too. ``lang`` is left as it is.
    """
    let_workers_import(spark)
    model = language_id.train(docs.filter(~language_id.held_out() & F.col("doc_id").isNotNull()))
    found = language_id.predict(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near-duplicates."""
    let_workers_import(spark)
    return order_minhash.keep_one(docs.select(*COLUMNS), similarity=0.8, size=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of 50-word windows that an earlier document has.

    Texts without such a window stay as they are; others hold their remaining words
    joined by one space, and ``n_chars`` follows. Documents of which nothing is left go.
    """
    let_workers_import(spark)
    return substring_dedup.cut_documents(docs.select(*COLUMNS), window=50)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lie in benchmark passages."""
    let_workers_import(spark)
    return winnowing.drop_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), window=13, k=7)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and place."""
    let_workers_import(spark)
    return packing.pack_documents(docs, tokenizer_path(), 2048, 0)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language models and order MinHash have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
