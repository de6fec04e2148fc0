import random
from collections import defaultdict

import numpy as np
import pytest

from wardlake.llm import hashing, order_minhash

from .conftest import words


def longest_common(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("seed", range(60))
def test_banded_alignment(seed):
    own = np.random.default_rng(seed)
    a = own.integers(0, own.integers(2, 60), own.integers(1, 60))
    b = a.tolist()
    for _ in range(int(own.integers(0, 8))):
        at = int(own.integers(0, len(b) + 1))
        b[at : at + int(own.integers(0, 2))] = [99] * int(own.integers(0, 2))
    b = np.array(b, int)
    matched = longest_common(a, b)
    exact = matched / max(len(a) + len(b) - matched, 1)
    assert order_minhash.alignment(a, b, 0.8) == pytest.approx(exact if exact >= 0.8 else 0)


def shingled(text, size=5):
    w = (text or "").split()
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else [])


def classes(rows, least=0.8):
    """Brute force over all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    grams = [shingled(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if not same and grams[i] and grams[j] and set(grams[i]) & set(grams[j]):
                m = longest_common(grams[i], grams[j])
                same = m / (len(grams[i]) + len(grams[j]) - m) >= least
            if same:
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    return sorted(((r[0], min(ids[find(i)], default=None)) for i, r in enumerate(rows)), key=repr)


def test_edge_cases(edge_docs, edge_rows):
    rows = [r for r in edge_rows if r[0] != 9]
    docs = edge_docs.filter("doc_id is null or doc_id <> 9")
    got = order_minhash.near_duplicates(docs)
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=repr) == classes(rows)
    kept = order_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 3 in ids and not {1, 2, 4, None} & set(ids)


def test_repeated_rows_stay_once(edge_docs):
    kept = order_minhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(11) == 1 and ids.count(0) == 1


def test_groups_of_edited_copies(spark):
    own, rows = random.Random(4), []
    for group in range(6):
        base = words(100, group, 5000).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(25):
            copy = list(base)
            for _ in range(own.randrange(1, 5)):
                copy[own.randrange(len(copy))] = f"x{own.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in order_minhash.near_duplicates(docs).collect()), key=repr)
    assert got == classes(rows)


@pytest.mark.parametrize("rounds", [0, 3])
def test_pairs_in_one_wide_bucket(spark, rounds):
    """Pages of one template, each twice with a word edited: links between pairs only."""
    own, rows = random.Random(8), []
    template = [f"t{i}" for i in range(99)]
    for page in range(50):
        body = template + [f"p{page}x{i}" for i in range(13)]
        rows.append((len(rows), " ".join(body)))
        body[own.randrange(20, 90)] = f"edit{page}"
        rows.append((len(rows), " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = order_minhash.near_duplicates(docs, rounds=rounds)
    got = sorted(((r.doc_id, r.class_id) for r in found.collect()), key=repr)
    assert got == classes(rows)


@pytest.mark.parametrize("frequent", [3, 64])
def test_reachable_pairs_hold_every_link(spark, monkeypatch, frequent):
    monkeypatch.setattr(order_minhash, "FREQUENT", frequent)
    own, rows = np.random.default_rng(3), []
    for node in range(150):
        body = own.integers(0, 6, own.integers(1, 40)) if node % 3 == 0 else rows[own.integers(0, len(rows))][1].copy()
        for _ in range(int(own.integers(0, 4))):
            body[own.integers(0, len(body))] = own.integers(0, 9)
        rows.append((node, body))
    table = [(node, bytearray(body.astype("<u4").tobytes())) for node, body in rows]
    sequences = spark.createDataFrame(table, "node long, sequence binary")
    # Every third node is of one class already; all share two buckets.
    left = spark.createDataFrame([(node, -1 if node % 3 == 1 else node) for node, _ in rows], "node long, label long")
    buckets = spark.createDataFrame([(band, 7, node) for node, _ in rows for band in (2, 5)], "band int, element long, node long")
    found = [(r.node, r.hub) for r in order_minhash._reachable(sequences, left, buckets, 0.8).collect()]
    assert not any(a % 3 == b % 3 == 1 for a, b in found)
    assert len(found) == len(set(found)) == len({frozenset(p) for p in found})
    held = {frozenset(p) for p in found}
    for i, a in rows:
        for j, b in rows[:i]:
            if not i % 3 == j % 3 == 1 and order_minhash.alignment(a, b, 0.8):
                assert frozenset((i, j)) in held


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in order_minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_grow_with_links(spark):
    own, labels, edges = random.Random(7), None, []
    for _ in range(4):
        more = [(own.randrange(60), own.randrange(60)) for _ in range(12)]
        edges += more
        labels = order_minhash.merged(labels, spark.createDataFrame(more, "a long, b long"))
        want = {r.node: r.label for r in order_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert {r.node: r.label for r in labels.collect()} == want


def test_order_counts(spark):
    a = words(200, 1).split()
    turned = a[100:] + a[:100]
    rows = [(1, " ".join(a)), (2, " ".join(turned))]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {1, 2}


def test_empty_table(no_docs):
    assert order_minhash.near_duplicates(no_docs).count() == 0
    assert order_minhash.keep_one(no_docs).count() == 0


def test_slices_longer_than_their_positions(monkeypatch):
    """With few bits for positions the long way is taken; samples and anchors stay the same."""
    own = np.random.default_rng(6)
    values = own.integers(0, 2**63, 5000).astype(np.uint64)
    values[own.integers(0, 5000, 900)] = values[0]
    first = np.array([0, 0, 1, 4, 3000, 3000, 5000])
    sketch = order_minhash.order_sketch(values, first, 12, 2)
    near = hashing.anchors(values, 20)
    monkeypatch.setattr(order_minhash, "PLACE_BITS", 8)
    monkeypatch.setattr(hashing, "PLACE_BITS", 8)
    assert (order_minhash.order_sketch(values, first, 12, 2) == sketch).all()
    assert (hashing.anchors(values, 20) == near).all()
    assert len(hashing.anchors(values[:19], 20)) == 0


def test_wide_buckets_compare_few_pairs(spark, monkeypatch):
    """400 pages of one template, none similar to another, with 40 copies of one page: comparisons stay near one a page and round."""
    rng = random.Random(8)
    common = [f"menu{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(40)])) for i in range(400)]
    copied = rows[0][1].split()
    rows += [(1000 + i, " ".join([*copied[:-2], f"x{i}", f"y{i}"])) for i in range(40)]
    compared = []
    links = order_minhash._links

    def counted(pairs, sequences, similarity):
        compared.append(pairs.count())
        return links(pairs, sequences, similarity)

    monkeypatch.setattr(order_minhash, "_links", counted)
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: 0 if i >= 1000 else i for i, _ in rows}
    assert sum(compared) < 12 * 440
