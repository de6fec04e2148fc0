import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.llm import substring_dedup, suffix_dedup
from wardlake.llm.countmin import PartitionSketch, Repeats, merge


def lcp(a, b, limit):
    n = 0
    while n < limit and n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("n, letters, limit", [(1, 2, 3), (70, 2, 9), (200, 3, 25), (90, 1, 20), (150, 4, 3)])
def test_suffix_order_and_previous_factors(n, letters, limit):
    text = np.random.default_rng(n).integers(97, 97 + letters, n).astype(np.uint8)
    raw = text.tobytes()
    order, common = suffix_dedup.suffix_order(text, limit)
    assert [raw[i : i + limit] for i in order] == sorted(raw[i : i + limit] for i in range(n))
    assert common.tolist()[1:] == [lcp(raw[a:], raw[b:], limit) for a, b in zip(order[1:], order[:-1])]
    factors = suffix_dedup.previous_factors(order, common)
    assert factors.tolist() == [max([lcp(raw[i:], raw[j:], limit) for j in range(i)], default=0) for i in range(n)]


def bytes_removed(rows, length, keep):
    """Brute force on the input, in the order of ids (null last)."""
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    counts = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    ordered = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0))
    seen, out = set(), [None] * len(texts)
    for index in ordered:
        body = texts[index][1]
        gone = np.zeros(len(body) + 1, np.int64)
        for i in range(len(body) - length + 1):
            part = body[i : i + length]
            if counts[part] > 1 if keep == "none" else part in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(part)
        mask = np.cumsum(gone)[:-1] > 0
        left = bytes(np.frombuffer(body, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[index] = (texts[index][0], len(body), int(mask.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("group_runs", [2_000, 1])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_byte_strings(monkeypatch, edge_docs, edge_rows, keep, group_runs):
    monkeypatch.setattr(suffix_dedup.first_places, "__defaults__", (group_runs,))
    got = suffix_dedup.without_repeats(edge_docs, 200, keep)
    # Rows equal in id and text are one place for keep="first".
    rows = edge_rows if keep == "none" else [r for i, r in enumerate(edge_rows) if r not in edge_rows[:i]]
    expected = set(bytes_removed(rows, 200, keep))
    assert {tuple(r)[:5] for r in got.collect()} == expected
    assert got.count() == len(edge_rows)


def test_long_texts_are_cut_in_parts(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1000)
    own = np.random.default_rng(5)
    a = "".join(map(chr, own.integers(97, 123, 5000)))
    rows = [(1, a), (2, a[700:3100] + "x" + a[:300]), (3, "y" * 450)]
    runs = suffix_dedup._parts(np.zeros(5000, np.uint8), np.array([0, 5000]), 200)
    windows = sum(len(part) - 199 for _, _, part, _ in runs)
    assert windows == 5000 - 199
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 200, "none")
    assert {tuple(r)[:5] for r in got.collect()} == set(bytes_removed(rows, 200, "none"))


def words_kept(rows, window):
    split = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    least = {}
    for i, w in split:
        number = (1 << 63) - 1 if i is None else i
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            least[key] = min(least.get(key, number), number)
    out = []
    for i, w in split:
        number = (1 << 63) - 1 if i is None else i
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < number:
                gone.update(range(s, s + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [50, 20])
def test_word_windows(edge_docs, edge_rows, window):
    got = substring_dedup.without_repeats(edge_docs, window, k=min(16, window - 4))
    assert Counter(tuple(r) for r in got.collect()) == Counter(words_kept(edge_rows, window))


def test_cut_documents(edge_docs, edge_rows):
    got = substring_dedup.cut_documents(edge_docs, 50)
    assert got.columns == edge_docs.columns
    expected = Counter()
    for row, (_, _, gone, _, kept) in zip(edge_rows, words_kept(edge_rows, 50)):
        if not gone:
            expected[row[:2]] += 1
        elif kept:
            expected[(row[0], kept)] += 1
    assert Counter((r.doc_id, r.text) for r in got.collect()) == expected
    assert got.filter("text is not null and n_chars <> char_length(text)").count() == 0


def test_empty_tables(no_docs):
    assert suffix_dedup.without_repeats(no_docs).count() == 0
    assert substring_dedup.without_repeats(no_docs).count() == 0
    assert substring_dedup.cut_documents(no_docs).count() == 0


def test_sketch_never_misses_a_repeat(spark):
    bits = 20
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.uint64)
    twice = hashes[:1000]

    def count(frames):
        for batch in frames:
            ids = batch.column(0).to_numpy()
            sketch = PartitionSketch(bits)
            sketch.add(hashes[ids % len(hashes)])
            yield from sketch.batches()

    found = merge(spark.range(0, 41_000, 1, 5).mapInArrow(count, PartitionSketch.SCHEMA), bits)
    assert isinstance(found, Repeats)
    assert found.may_repeat(twice).all()
    assert found.may_repeat(hashes[1000:]).mean() < 0.1
    assert not found.may_repeat(np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64)).all()


def test_spans_are_per_row(edge_docs):
    got = substring_dedup.without_repeats(edge_docs, 50)
    assert got.filter(F.col("n_removed") > F.col("n_words")).count() == 0
