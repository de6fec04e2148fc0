import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wardlake.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, longest=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, cut(text, longest)[1]))
    for text in target:
        t.update(map(bucket, cut(text, longest)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        words, own = cut(text, longest)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(own), len(words), weight, weight + noise, None])
    able = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[3]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, rows))


def same(got, docs, target, **options):
    assert Counter(map(tuple, got.collect())) == brute(docs, target, **options)


@pytest.mark.parametrize("percent,longest", [(10, 1), (50, 2), (100, 1), (0, 1)])
def test_edge_documents(spark, edge_rows, edge_docs, percent, longest):
    docs = [(r[0], r[1]) for r in edge_rows]
    target = ["w1 w2 w3 w3", None, "", "naïve W5"]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    same(resampling.resample(edge_docs, frame, percent=percent, longest=longest), docs, target, percent=percent, longest=longest)


def test_ties_at_the_cut(spark, monkeypatch):
    """A third of all rows share one id, so text and score tie; ranks cross range partitions."""
    monkeypatch.setattr(resampling, "RANK_ROWS", 40)
    text = " ".join(f"a{i}" for i in range(25))
    docs = [(7, text)] * 200 + [(i, text + f" b{i % 5}") for i in range(100, 500)] + [(None, text)] * 9
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rank int").repartition(5)
    target = spark.createDataFrame([(text,)], "text string")
    for percent in (10, 71):
        got = resampling.resample(frame, target, percent=percent)
        same(got, docs, [text], percent=percent)
        ranks = sorted(r.rank for r in got.collect() if r.rank)
        assert ranks == list(range(1, percent * len(docs) // 100 + 1))


def test_no_documents_no_target(spark, no_docs, edge_docs, edge_rows):
    assert resampling.resample(no_docs, edge_docs).collect() == []
    same(resampling.resample(edge_docs, no_docs, percent=50), [(r[0], r[1]) for r in edge_rows], [], percent=50)


def test_bisection_finds_the_cut(spark):
    values = [5, 5, 5, -40, 17, 900_000_000_000, 5, 6]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for enough in range(1, 9):
        assert resampling._greatest(rows, "v", enough) == sorted(values, reverse=True)[enough - 1]


def test_crc_of_stretches():
    data = "naïve word, x".encode()
    start, end = np.array([0, 7, 13, 3, 5]), np.array([6, 11, 14, 3, 6])
    got = resampling.crc32(np.frombuffer(data, np.uint8), start, end)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end)]
