import zlib

from wardlake.llm import language_id


def test_words_then_grams(spark):
    rows = [(i, "the house and the garden", "en") for i in range(40)] + [(100 + i, "das haus und der garten", "de") for i in range(40)]
    asked = [
        (1000, "The HOUSE", None),
        (1001, "gartenhaus", None),
        (1002, None, "en"),
        (1003, "123 ... !", "en"),
        (1004, "日本", None),
        (1005, "", None),
        (None, "und", None),
        (1000, "das haus " * 30_000, None),
    ]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    got = language_id.identify(docs.withColumnRenamed("x", "y"))
    assert got.count() == len(rows) + len(asked)
    for r in got.collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    found = {(r.doc_id, (r.text or "")[:10]): r.lang_pred for r in got.collect()}
    assert found[(1000, "The HOUSE")] == "en" and found[(1001, "gartenhaus")] == "de"
    assert found[(1002, "")] == "und" and found[(1003, "123 ... !")] == "und" and found[(1005, "")] == "und"
    assert found[(None, "und")] == "de" and found[(1000, "das haus d")] == "de"
    assert found[(1004, "日本")] in ("de", "en")


def test_backoff_takes_the_longest_known_grams():
    import numpy as np
    import pyarrow as pa

    model = language_id.Model(
        ["a", "b"], np.zeros(2), pa.array([], pa.large_string()), np.zeros((0, 2)), {"xyz": 0, "x": 1, "^q": 2}, np.array([[1.0, 2], [5, 5], [7, 8]])
    )
    assert model.backoff("wxyzw").tolist() == [1, 2]
    assert model.backoff("x").tolist() == [5, 5]
    assert model.backoff("qq").tolist() == [7, 8]
    assert model.backoff("m").tolist() == [0, 0]


def test_nothing_learned(spark, edge_docs, no_docs):
    docs = edge_docs.withColumn("lang", edge_docs.lang.substr(5, 1))
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.identify(unknown).collect()} == {"und"}
    assert language_id.identify(no_docs).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.filter("lang = lang_pred").count()
    assert right >= 0.97 * got.count()


def test_sample_is_bounded(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs, sample_rows=40, most_words=100)
    assert len(model.words) <= 100 and len(model.grams) <= 200


def test_clashing_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "das haus", "de", "x", 7), (2, "the house", "en", "y", 8)], "doc_id long, text string, lang string, lang_pred string, SCORE int")
    got = language_id.predict(docs, language_id.train(docs))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "de", 2: "en"}
