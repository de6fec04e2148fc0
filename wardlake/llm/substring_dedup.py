"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one document. Each window is represented by
its anchor, the word k-gram of least hash in it, which is the same in equal windows; a
run of windows with one anchor is handled together. The first pass counts anchors in
partition sketches, which are merged and never estimate too low. The second pass takes
the runs whose anchor is estimated repeated and groups their windows exactly: first runs
that are equal as a whole, then, where one anchor has different runs, window by window.
For each window the least ``doc_id`` it starts in decides.

Window hashes have 64 bits and are compared among equal anchors (64 bits more).

Edge cases: a null text has no words and keeps nothing; texts shorter than a window keep
all words; rows that share a ``doc_id`` never remove each other's words; rows with a null
``doc_id`` count as the last document; an empty table gives an empty table; other columns
do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import batches, binary_array, column
from .countmin import PartitionSketch, Repeats, merge, sketch_bits
from .hashing import Rolling, Words, anchor_runs
from .tables import fresh_name, materialize, text_key, texts

#: Where rows with a null id stand in the order of documents.
LAST = (1 << 63) - 1


def _runs(data, offsets, window: int, k: int):
    words = Words(data, offsets)
    rolling = Rolling(words.hashes(1))
    grams = rolling.grams(k)
    return words, grams, anchor_runs(grams, words.first, window, k)


def repeated_anchors(docs: DataFrame, window: int, k: int) -> Repeats:
    """First pass: the merged sketch of all anchors."""
    # A word and its space take seven bytes or so, and every (window - k + 2) / 2 words
    # have an anchor; the estimate sets the sketch's size and no result.
    volume = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(volume / 7 * 2 / (window - k + 2))

    def count(frames):
        sketch = PartitionSketch(bits)
        for _, data, offsets in batches(frames):
            _, grams, (_, _, _, at) = _runs(data, offsets, window, k)
            # One run per anchor and text stretch: an anchor that two runs share counts twice.
            sketch.add(grams[at])
        yield from sketch.batches()

    return merge(docs.select("text").mapInArrow(count, PartitionSketch.SCHEMA), bits)


def candidate_runs(docs: DataFrame, repeats: Repeats, window: int, k: int) -> DataFrame:
    """Second pass: runs whose anchor may occur again.

    ``(doc_id, text_key, start, n, anchor, content, windows)``: ``content`` is a hash of
    the whole run and the anchor's place in it, ``windows`` the hashes of its windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeats)

    def search(frames):
        for rows, data, offsets in batches(frames):
            words, grams, (text, start, n, at) = _runs(data, offsets, window, k)
            keep = shared.value.may_repeat(grams[at])
            text, start, n, at = text[keep], start[keep], n[keep], at[keep]
            if not len(text):
                continue
            whole = Rolling(words.hashes(2))
            content = whole.spans(start, start + n + window - 1) + (at - start).astype(np.uint64)
            bounds = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=bounds[1:])
            places = np.repeat(start - bounds[:-1], n) + np.arange(bounds[-1])
            hashes = whole.spans(places, places + window)
            yield pa.RecordBatch.from_arrays(
                [
                    column(rows, "doc_id").take(pa.array(text)),
                    column(rows, "text_key").take(pa.array(text)),
                    pa.array((start - words.first[text]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(grams[at].view(np.int64)),
                    pa.array(content.view(np.int64)),
                    binary_array(hashes.view(np.uint8), 8 * bounds),
                ],
                ["doc_id", "text_key", "start", "n", "anchor", "content", "windows"],
            )

    return docs.mapInArrow(
        search, "doc_id long, text_key long, start int, n int, anchor long, content long, windows binary"
    )


def first_documents(runs: DataFrame) -> DataFrame:
    """Per kind of run ``(anchor, content)`` the stretches of windows and their first document.

    ``stretches`` holds ``(from, to, first)``; consecutive windows with one first document
    are one stretch. Kinds that occur in one document only and share no window are left out.
    """
    number = F.coalesce("doc_id", F.lit(LAST))
    kinds = materialize(
        runs.groupBy("anchor", "content").agg(
            F.min(number).alias("least"), F.max(number).alias("most"), F.first("n").alias("n"), F.first("windows").alias("windows")
        )
    )
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
    alone = kinds.join(several, "anchor", "left_anti").filter("least < most")
    alone = alone.select(
        "anchor", "content", F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to"), F.col("least").alias("first"))).alias("stretches")
    )

    def unfold(frames):
        for batch in frames:
            sizes = column(batch, "n").to_numpy().astype(np.int64)
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            hashes = [np.frombuffer(x.as_buffer(), np.int64) for x in column(batch, "windows")]
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [column(batch, c).take(row) for c in ("anchor", "content", "least")]
                + [pa.array(place.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *hashes]))],
                ["anchor", "content", "least", "place", "window"],
            )

    mixed = kinds.join(several, "anchor", "left_semi").select("anchor", "content", "least", "n", "windows")
    single = mixed.mapInArrow(unfold, "anchor long, content long, least long, place int, window long")
    least = single.groupBy("anchor", "window").agg(F.min("least").alias("first"), F.count("*").alias("c")).filter("c > 1")
    shared = single.join(least, ["anchor", "window"]).groupBy("anchor", "content").agg(
        F.sort_array(F.collect_list(F.struct("place", "first"))).alias("found")
    )
    mixed = kinds.join(several, "anchor", "left_semi").join(shared, ["anchor", "content"], "left")
    mixed = mixed.filter("found is not null or least < most")

    # Windows met in this kind of run only have its own first document.
    spell = "struct(place as `from`, place + 1 as `to`, first as `first`)"
    own = F.expr(
        "transform(sequence(0, n - 1), p -> named_struct('place', p, 'first', coalesce(element_at(met, p), least)))"
    )
    met = F.map_from_entries(F.coalesce("found", F.array().cast("array<struct<place:int,first:bigint>>")))
    mixed = mixed.withColumn("met", met).withColumn("each", own)
    joined = F.expr(
        f"""aggregate(each, cast(array() as array<struct<`from`: int, `to`: int, `first`: bigint>>), (s, x) ->
            case when size(s) > 0 and element_at(s, -1).`first` = x.first
                 then concat(slice(s, 1, size(s) - 1), array(named_struct('from', element_at(s, -1).`from`, 'to', x.place + 1, 'first', x.first)))
                 else concat(s, array(named_struct('from', x.place, 'to', x.place + 1, 'first', x.first))) end)"""
    )
    return alone.unionByName(mixed.select("anchor", "content", joined.alias("stretches")))


def removed_spans(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """Words to remove: ``(doc_id, text_key, spans)`` with ``spans`` an array of ``(at, end)``.

    ``docs`` has ``doc_id``, ``text`` and ``text_key``. Documents that keep all have no row.
    """
    runs = materialize(candidate_runs(docs, repeated_anchors(docs, window, k), window, k))
    firsts = materialize(first_documents(runs))
    stretches = runs.drop("windows").join(firsts, ["anchor", "content"]).select(
        "doc_id", "text_key", "start", F.explode("stretches").alias("s")
    )
    late = stretches.filter(F.coalesce("doc_id", F.lit(LAST)) > F.col("s.first"))
    spans = late.select(
        "doc_id",
        "text_key",
        F.struct((F.col("start") + F.col("s.from")).alias("at"), (F.col("start") + F.col("s.to") + (window - 1)).alias("end")).alias("span"),
    )
    return spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = 50, k: int = 16, text: bool = True) -> DataFrame:
    """Per document row ``doc_id, n_words, n_removed, kept_sha256`` and ``kept`` (if ``text``).

    ``kept`` holds the remaining words joined by one space.
    """
    keyed = texts(docs).withColumn("text_key", text_key())
    spans = removed_spans(keyed, window, k)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    joined = keyed.join(spans, same, "left").select("doc_id", "text", "spans")

    def cut(frames):
        for rows, data, offsets in batches(frames):
            words, kept = _kept_words(data, offsets, column(rows, "spans"))
            first = words.first
            raw = data.tobytes()
            ids, digests, bodies = column(rows, "doc_id"), [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                own = a + np.flatnonzero(kept[a:b])
                body = b" ".join([raw[s:e] for s, e in zip(words.start[own].tolist(), words.end[own].tolist())])
                digests.append(hashlib.sha256(body).hexdigest())
                bodies.append(body)
            total = np.concatenate([[0], np.cumsum(~kept)])
            arrays = [ids, pa.array(np.diff(first)), pa.array(np.diff(total[first])), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if text:
                arrays.append(pa.array(bodies, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text
    return joined.mapInArrow(cut, schema)


def cut_documents(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """``docs`` with repeated words removed; same columns, ``n_chars`` follows if there is one.

    A text that loses nothing is left as it is, and one that loses all its words goes.
    """
    names = docs.columns
    id_, key, spans = (fresh_name(n, names) for n in ("_id", "_key", "_spans"))
    keyed = texts(docs).withColumn("text_key", text_key())
    found = removed_spans(keyed, window, k).select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("spans").alias(spans)
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_key() == F.col(key))
    joined = docs.join(found, same, "left")
    whole = joined.filter(F.col(spans).isNull()).select(*names)
    return whole.unionByName(_cut_rows(joined.filter(F.col(spans).isNotNull()), names, spans))


def _cut_rows(rows: DataFrame, names: list[str], spans: str) -> DataFrame:
    """The rows that lose words, with what is left of them as text."""

    def cut(frames):
        for part, data, offsets in batches(frames):
            words, kept = _kept_words(data, offsets, column(part, spans))
            raw = data.tobytes()
            bodies = []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                own = a + np.flatnonzero(kept[a:b])
                bodies.append(b" ".join([raw[s:e] for s, e in zip(words.start[own].tolist(), words.end[own].tolist())]))
            text = pa.array(bodies, pa.binary()).cast(pa.string())
            arrays = [text if n == "text" else column(part, n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    left = rows.select(*names, spans).mapInArrow(cut, rows.select(*names).schema).filter(F.col("text") != "")
    if "n_chars" in names:
        left = left.withColumn("n_chars", F.char_length("text").cast(rows.schema["n_chars"].dataType))
    return left.select(*names)


def _kept_words(data: np.ndarray, offsets: np.ndarray, lists: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of a slice and which of them no span covers."""
    words = Words(data, offsets)
    gone = np.zeros(len(words) + 1, np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(_offsets(lists)))
    flat = lists.flatten()
    if len(flat):
        np.add.at(gone, words.first[row] + flat.field("at").to_numpy(), 1)
        np.add.at(gone, words.first[row] + flat.field("end").to_numpy(), -1)
    return words, np.cumsum(gone)[:-1] == 0


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Offsets into the flattened list, with nulls as empty lists."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.concatenate([[0], np.cumsum(sizes)])
