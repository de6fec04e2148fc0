"""Benchmark decontamination by winnowing.

Words are compared in windows of ``window`` words of an item; an item with fewer words is
one window. Of every ``window - k + 1`` consecutive word k-grams of a text the least hash
is kept, so two texts that share ``window`` words share a kept k-gram at the same place
in them. Documents and items are joined on these fingerprints, and a hit is extended:
the windows around it are compared whole, by 128 bits of hash. Windows of items shorter
than ``window`` are looked for at every place, since no fingerprint is sure to lie in them.

What tasks look up first is a bit table of fixed size made of the benchmark's hashes. It
lets every true hit pass, and only what passes leaves the task; the join decides.

Edge cases: a null text has no words; items without words are never found; rows that
share an id are judged one by one; an empty benchmark marks nothing; other columns and
their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import batches, column
from .hashing import BASES, NOT_ALNUM, Rolling, U, Words, anchors
from .tables import fresh_name, materialize, text_key, texts

#: log2 of the bits in the lookup table of a task: 1 MB, whatever the benchmark's size.
TABLE_BITS = 23


def _grams(words: Words, sizes: list[int]):
    """Per size the 64-bit hashes of all word n-grams, two independent ones."""
    first = Rolling(words.hashes(1), BASES[0])
    second = Rolling(words.hashes(2), BASES[1])
    return {n: (first.grams(n), second.grams(n)) for n in sizes}


def _fingerprints(grams: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Places of the k-grams that winnowing keeps, over all texts of a slice.

    A stretch of k-grams that crosses two texts may keep one more; that does no harm.
    """
    if len(grams) < width:
        return np.zeros(0, np.int64)
    return np.unique(anchors(grams, width))


def item_windows(items: DataFrame, window: int, k: int, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, size, h1, h2, kept)`` per window of an item; ``kept`` are its fingerprints."""

    def cut(frames):
        names = ["item", "size", "h1", "h2", "kept"]
        for rows, data, offsets in batches(frames):
            words = Words(data, offsets, NOT_ALNUM, fold=True)
            counts = np.diff(words.first)
            sizes = sorted({window, *np.unique(counts[(counts > 0) & (counts < window)]).tolist()})
            grams = _grams(words, [*sizes, k])
            kept = np.zeros(len(words) + 1, bool)
            kept[_fingerprints(grams[k][0], words.first, window - k + 1)] = True
            item, size, h1, h2, marks = [], [], [], [], []
            for row, (begin, n) in enumerate(zip(words.first[:-1].tolist(), counts.tolist())):
                if not n:
                    continue
                own = min(n, window)
                at = np.arange(begin, begin + n - own + 1)
                item += [row] * len(at)
                size += [own] * len(at)
                h1.append(grams[own][0][at])
                h2.append(grams[own][1][at])
                for p in at.tolist():
                    inside = p + np.flatnonzero(kept[p : p + own - k + 1]) if own == window else []
                    marks.append(grams[k][0][inside].view(np.int64).tolist() if len(inside) else [])
            if item:
                yield pa.RecordBatch.from_arrays(
                    [
                        column(rows, "item").take(pa.array(item)),
                        pa.array(size, pa.int32()),
                        pa.array(np.concatenate(h1).view(np.int64)),
                        pa.array(np.concatenate(h2).view(np.int64)),
                        pa.array(marks, pa.list_(pa.int64())),
                    ],
                    names,
                )

    named = items.select(F.col(id_column).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(cut, "item string, size int, h1 long, h2 long, kept array<long>")


def bit_table(hashes: DataFrame, name: str) -> np.ndarray:
    """A table of ``2 ** TABLE_BITS`` bits with those set that the hashes fall on.

    Tasks send words of 64 bits that have a bit set, at most ``2 ** (TABLE_BITS - 6)``.
    """
    cell = F.shiftrightunsigned(F.col(name), 64 - TABLE_BITS)
    words = hashes.select((cell.bitwiseAND(63)).cast("int").alias("bit"), F.shiftright(cell, 6).cast("int").alias("word"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    got = found.toPandas()
    table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return np.unpackbits(table.view(np.uint8), bitorder="little")


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[(hashes >> U(64 - TABLE_BITS)).astype(np.int64)].astype(bool)


def document_candidates(docs: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    """One row per document: word count, and windows around fingerprints that may be shared.

    ``found`` holds ``(at, size, h1, h2, kept)``; ``kept`` is the fingerprint that led to
    the window, null for windows of short items.
    """
    spark = docs.sparkSession
    short = [r["size"] for r in windows.filter(F.col("size") < window).select("size").distinct().collect()]
    marks = spark.sparkContext.broadcast(bit_table(windows.select(F.explode("kept").alias("h")), "h"))
    wholes = spark.sparkContext.broadcast(bit_table(windows, "h1"))
    item = pa.struct(
        [("at", pa.int32()), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("kept", pa.int64())]
    )

    def search(frames):
        width = window - k + 1
        for rows, data, offsets in batches(frames):
            words = Words(data, offsets, NOT_ALNUM, fold=True)
            n = len(words)
            h1, h2 = Rolling(words.hashes(1), BASES[0]), Rolling(words.hashes(2), BASES[1])
            at, size, kept = [], [], []
            grams = h1.grams(k)
            mark = _fingerprints(grams, words.first, width)
            mark = mark[_passes(marks.value, grams[mark])]
            # The windows that hold the k-gram at ``mark``, within its text.
            begin = (mark[:, None] - np.arange(width)).ravel()
            led = np.repeat(mark, width)
            text = np.searchsorted(words.first, led, "right") - 1
            ok = (begin >= words.first[text]) & (begin + window <= words.first[text + 1])
            at.append(begin[ok])
            kept.append(grams[led[ok]].view(np.int64))
            size.append(np.full(ok.sum(), window))
            for s in short:
                if n >= s:
                    begin = np.flatnonzero(_passes(wholes.value, h1.grams(s)))
                    text = np.searchsorted(words.first, begin, "right") - 1
                    begin = begin[begin + s <= words.first[text + 1]]
                    at.append(begin)
                    size.append(np.full(len(begin), s))
                    kept.append(np.zeros(len(begin), np.int64))
            at, size, kept = np.concatenate(at), np.concatenate(size), np.concatenate(kept)
            a = h1.spans(at, at + size)
            ok = _passes(wholes.value, a)
            at, size, kept, a = at[ok], size[ok], kept[ok], a[ok]
            b = h2.spans(at, at + size)
            order = np.argsort(at, kind="stable")
            at, size, kept, a, b = at[order], size[order], kept[order], a[order], b[order]
            ends = np.searchsorted(at, words.first)
            text = np.searchsorted(words.first, at, "right") - 1
            found = pa.StructArray.from_arrays(
                [
                    pa.array((at - words.first[text]).astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)),
                    pa.array(kept, mask=size < window),
                ],
                fields=list(item),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    column(rows, "doc_id"),
                    column(rows, "text_key"),
                    pa.array(np.diff(words.first)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found),
                ],
                ["doc_id", "text_key", "n_words", "found"],
            )

    keyed = texts(docs).withColumn("text_key", text_key())
    return keyed.mapInArrow(
        search,
        "doc_id long, text_key long, n_words long, "
        "found array<struct<at: int, size: int, h1: long, h2: long, kept: long>>",
    )


def covered(spans: Column) -> Column:
    """How many places a sorted array of ``(at, size)`` covers."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(state, span):
        end = (span["at"] + span["size"]).cast("long")
        fresh = F.greatest(end - F.greatest(state["end"], span["at"].cast("long")), F.lit(0))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["end"], end).alias("end"))

    return F.aggregate(spans, start, add, lambda s: s["n"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    k: int = 7,
    item_id: str = "item_id",
    share: float = 0.05,
) -> DataFrame:
    """Per document row: ``doc_id, text_key, n_words, n_hit, items, contaminated``.

    ``items`` are the sorted ids (as text) of items with a window in the document. A
    document is contaminated if it has hit words and they are at least ``share`` of all.
    """
    windows = materialize(item_windows(benchmark, window, k, item_id))
    # Written with a number per row, which stays the same in every later read.
    rows = materialize(document_candidates(docs, windows, window, k).withColumn("row", F.monotonically_increasing_id()))
    near = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("w")).select("row", "w.*")
    marks = windows.select(F.explode("kept").alias("kept")).distinct()
    whole = windows.select("size", "h1", "h2").distinct()
    by_mark = near.filter("kept is not null").join(marks, "kept", "left_semi")
    hits = by_mark.drop("kept").unionByName(near.filter("kept is null").drop("kept")).join(whole, ["size", "h1", "h2"], "left_semi")
    spans = hits.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"),
        F.collect_set(F.struct("size", "h1", "h2")).alias("kinds"),
    )
    spans = spans.select("row", covered(F.col("spans")).alias("n_hit"), "kinds")
    found = spans.select("row", F.explode("kinds").alias("w")).select("row", "w.*")
    items = (
        found.join(windows.select("item", "size", "h1", "h2").distinct(), ["size", "h1", "h2"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    out = rows.drop("found").join(spans.drop("kinds"), "row", "left").join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * F.lit(round(1 / share)) >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows; columns unchanged."""
    bad = contamination(docs, benchmark, **options).filter("contaminated")
    id_, key = fresh_name("_id", docs.columns), fresh_name("_key", docs.columns)
    bad = bad.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_key() == F.col(key))
    return docs.join(bad, same, "left_anti")
