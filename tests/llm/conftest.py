import random

import pytest
from pyspark.sql import functions as F

from wardlake.llm.tables import let_workers_import

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, bucket int, length int, shard int, text_key int, spans int, _id int"


def words(n, seed, stock=400):
    own = random.Random(seed)
    return " ".join(f"w{own.randrange(stock)}" for _ in range(n))


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    let_workers_import(spark)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated ids and rows."""
    base, passage = words(120, 1), words(70, 2)
    edited = base.split()
    edited[60] = "edited"
    rows = [
        (0, base, "a"),
        (1, " ".join(edited), "a"),
        (2, base, "a"),
        (3, None, "a"),
        (4, "", "a"),
        (5, " \n\t ", None),
        (6, f"{words(30, 3)} {passage} {words(10, 4)}", "a"),
        (7, f"{words(12, 5)}\n{passage}\t{words(200, 6)}", "b"),
        (8, f"{words(5, 7)} {passage}", "b"),
        (9, words(30_000, 8, 40), "b"),
        (10, "ÀÉ naïve ünïcode 日本語 É! don't 12345 ...", "b"),
        (10, words(60, 9), "b"),
        (11, words(60, 10), None),
        (11, words(60, 10), None),
        (12, "one", "a"),
        (13, "ab" * 700, "a"),
        (14, f"{passage} {passage}", "a"),
        (None, f"{words(8, 11)} {passage}", None),
    ]
    return [(i, t, lang, "s", len(t or ""), 1, 2, 3, 4, 5, 6, 7) for i, t, lang in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3, F.rand(1))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")
