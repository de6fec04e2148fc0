import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wardlake.llm import sharding


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def check_slots(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(shards))
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    return [len(by[s]) for s in range(shards)]


def test_rows_law_with_edges(edge_docs, edge_rows):
    got = rows_of(sharding.assign(sharding.sized(edge_docs), 4))
    sizes = check_slots(got, 4)
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(edge_rows)
    expected = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_groups_stay_together(spark):
    rows = [(i, f"text {i % 150 if i < 600 else i}") for i in range(1200)]
    got = rows_of(sharding.assign(sharding.sized(spark.createDataFrame(rows, "doc_id long, text string")), 8))
    sizes = check_slots(got, 8)
    assert max(sizes) - min(sizes) <= 1
    shards = defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 8


def test_hot_group_fills_few_shards(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(1500)]
    got = rows_of(sharding.assign(sharding.sized(spark.createDataFrame(rows, "doc_id long, text string")), 10))
    sizes = check_slots(got, 10)
    assert max(sizes) - min(sizes) <= 1
    hot = Counter(r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"same"))
    assert len(hot) < 10 and max(hot.values()) >= 100


def test_hot_group_fills_no_more_shards_than_it_needs(spark):
    docs = spark.range(0, 20000).select(
        F.col("id").alias("doc_id"), F.lit(16).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).cast("long").alias("link"),
    )
    got = rows_of(sharding.assign(docs, 40))
    sizes = check_slots(got, 40)
    assert max(sizes) - min(sizes) <= 1
    hot = Counter(r["shard"] for r in got if r["doc_id"] % 3 == 0)
    assert len(hot) == -(-6667 // 500)


@pytest.mark.parametrize("few", [0, sharding.FEW_ASKERS])
def test_groups_meet_where_all_rows_are_linked(spark, monkeypatch, few):
    monkeypatch.setattr(sharding, "FEW_ASKERS", few)
    docs = spark.range(0, 4000).select(
        F.col("id").alias("doc_id"), F.lit(16).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"),
        (F.col("id") % 400).alias("link"),
    )
    got = rows_of(sharding.assign(docs, 8))
    sizes = check_slots(got, 8)
    assert max(sizes) - min(sizes) <= 1
    together = Counter((r["doc_id"] % 400, r["shard"]) for r in got)
    most = defaultdict(int)
    for (link, _), n in together.items():
        most[link] = max(most[link], n)
    assert sum(most.values()) >= 0.9 * 4000


def test_all_rows_linked_and_more_shards_than_rows(spark):
    rows = [(i, f"t{i % 7}") for i in range(29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shards in (3, 5, 40):
        sizes = check_slots(rows_of(sharding.assign(sharding.sized(docs), shards)), shards)
        assert max(sizes) - min(sizes) <= 1


def test_key_law(edge_docs):
    docs = sharding.sized(edge_docs)
    got = rows_of(sharding.assign(docs, 6, law="key"))
    check_slots(got, 6)
    grown = {(r["doc_id"]): r["shard"] for r in rows_of(sharding.assign(docs, 7, law="key"))}
    for r in got:
        assert grown[r["doc_id"]] == r["grown_shard"]
        assert r["grown_shard"] in (r["shard"], 6)


def test_links_and_empty_table(spark, no_docs):
    rows = [(i, f"text {i}") for i in range(200)]
    docs = sharding.sized(spark.createDataFrame(rows, "doc_id long, text string"))
    links = spark.range(0, 100, 1).select(F.col("id").alias("doc_id"), (F.col("id") % 10).alias("link"))
    got = rows_of(sharding.assign(docs, 4, links=links))
    shards = defaultdict(set)
    for r in got:
        if r["doc_id"] < 100:
            shards[r["doc_id"] % 10].add(r["shard"])
    assert sum(len(s) for s in shards.values()) <= 14
    assert sharding.assign(sharding.sized(no_docs), 40).count() == 0
    assert sharding.assign(sharding.sized(no_docs), 40, law="key").count() == 0


def test_unknown_law(edge_docs):
    with pytest.raises(ValueError):
        sharding.assign(sharding.sized(edge_docs), 4, law="none")
