import re
from collections import Counter

import pytest

from wardlake.llm import winnowing
from wardlake.llm.hashing import anchors

from .conftest import words


def split(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, items, window=13):
    out = []
    own = {i: split(t) for i, t in items}
    for row in rows:
        w, hit, found = split(row[1]), set(), set()
        for item, iw in own.items():
            n = min(len(iw), window)
            for s in range(len(iw) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out.append((row[0], len(w), len(hit), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def items():
    return [(1, words(40, 1)), (2, "One"), (3, None), (4, ""), (5, words(70, 2).upper()), (6, "naïve ünïcode"), (7, words(11, 5)), (7, words(5, 6))]


def test_against_brute_force(spark, edge_docs, edge_rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [r for r in edge_rows if r[0] != 9]
    docs = edge_docs.filter("doc_id is null or doc_id <> 9")
    got = winnowing.contamination(docs, benchmark).collect()
    unique = [(i, t) for i, t in items if i != 7] + [("7", words(11, 5)), ("7 ", words(5, 6))]
    expected = [(a, b, c, ",".join(sorted({x.strip() for x in d.split(",")} - {""})), e) for a, b, c, d, e in brute(rows, unique)]
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got) == Counter(expected)
    kept = winnowing.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(x[0] for x in expected if not x[4])


def test_empty_tables(spark, edge_docs, no_docs, items):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.contamination(edge_docs, nothing).filter("n_hit > 0").count() == 0
    assert winnowing.contamination(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_anchor_choice_is_the_same_in_copies():
    import numpy as np

    values = np.random.default_rng(0).integers(0, 1 << 62, 300).astype(np.uint64)
    alone = anchors(values[100:150], 10)
    inside = anchors(values, 10)[100:141]
    assert (alone + 100 == inside).all()
