"""The registered queries: against their SQL twins, and the pipeline stage by stage."""

from collections import Counter

import pytest
from compare import connect, run_pair

import corpus_pipeline
from wardlake.llm.queries import ORACLES, QUERIES
from wardlake.llm.tables import materialize, read

from .test_dedup import words_kept
from .test_near_duplicates import shingled
from .test_winnowing import brute


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    problem, rows, _ = run_pair(spark, connect(sf_dir), name, QUERIES, ORACLES, sf_dir)
    assert problem is None and rows


def test_one_query_per_operator():
    assert [n for n in range(1, 14) if sum(q.startswith(f"op{n}_") for q in QUERIES) != 1] == []
    assert "pipeline" in QUERIES


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialize(stage(spark, docs, sf_dir))
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = (before, {r.doc_id: r.text for r in docs.collect()})
    before, after = kept["near_duplicates"]
    texts = Counter(after.values())
    assert max(texts.values()) == 1 and set(before.values()) >= set(texts)
    for i in before.keys() - after.keys():
        own = set(shingled(before[i]))
        assert any(before[i] == t or (own and len(own & set(shingled(t))) / len(own | set(shingled(t))) > 0.5) for t in after.values())
    before, after = kept["repeated_passages"]
    for i, _, gone, _, text in words_kept(list(before.items()), 50):
        assert after.get(i, "") == (text if gone else before[i])
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    some = dict(sorted(before.items())[:60])
    bad = {x[0] for x in brute(list(some.items()), items) if x[4]}
    assert bad == set(some) - set(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(after)


def test_pipeline_edges(spark, edge_docs, sf_dir):
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    ids = {r.doc_id for r in docs.collect()}
    assert 0 in ids and not ids & {1, 2, 3, 4, 5}
    empty = edge_docs.filter("doc_id = 999")
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, sf_dir))
    assert empty.count() == 0
