"""Substring dedup by longest-previous-factor arrays over suffix order.

Byte strings of ``length`` bytes that occur more than once are found by sorting suffixes
where repeats can be, not everywhere: each stretch of ``length`` bytes is represented by
its anchor, the least-hash k-gram in it, and a run is the text around one anchor. A
count-min sketch of anchors tells which runs may repeat. Equal runs are merged; runs that
differ but share an anchor are put together, ordered by document and place, and their
suffixes are sorted. In suffix order the previous and next smaller positions of a suffix
give its longest match that starts earlier (and, with the order turned round, later).

``keep="first"`` removes a byte covered by a string that also starts earlier (in ascending
``doc_id``, then place); ``keep="none"`` removes every copy.

An anchor with very many different runs is split: its strings are told apart by 128 bits
of hash and grouped by Spark, so that no task holds them all.

Edge cases: a null text is empty; texts shorter than ``length`` keep all; an empty table
gives an empty table; rows with one ``doc_id`` are ordered by a hash of their text, and
rows equal in both are one place for ``keep="first"`` and copies of each other for
``keep="none"``; a null ``doc_id`` comes last; other columns do not matter. Bytes are
removed one by one, so what is kept of a text may not be UTF-8; it is returned as binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import batches, binary_array, column
from .countmin import PartitionSketch, Repeats, merge, sketch_bits
from .hashing import BASES, PLACE_BITS, Rolling, U, anchor_runs, randoms
from .substring_dedup import LAST
from .tables import materialize, text_key, texts

#: Runs of one anchor that a task sorts together; anchors with more are split.
GROUP_RUNS = 2_000
#: Run bytes of all anchors that are sorted at once.
BLOCK_BYTES = 1 << 20
#: Bytes of one slice; a dozen 64-bit arrays of that length are held.
SLICE = 1 << 20
#: Bytes of a text looked at together; parts overlap by a string less one byte.
PART_BYTES = 4 << 20
LETTERS = randoms(256, 7)


def suffix_order(text: np.ndarray, limit: int, separate: np.ndarray | None = None):
    """Suffixes of ``text`` sorted by their first ``limit`` bytes, by prefix doubling.

    Returns the order and, between neighbours in it, the common prefix (at most
    ``limit``). ``separate`` numbers the pieces: a suffix ends where its piece ends, and
    suffixes of different ``separate`` groups never match.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Five bytes and the group fit one number; shorter prefixes are kept to measure matches.
    levels, key, size = [], np.zeros(n, np.int64), 0
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(5, np.int64)])
    group = np.zeros(n, np.int64) if separate is None else separate.astype(np.int64)
    for size in range(1, min(5, limit) + 1):
        key = key * 257 + padded[size - 1 : size - 1 + n]
        if size in (1, 2, 4):
            levels.append((size, group * 257**size + key))
    rank = np.unique(group * 257**size + key, return_inverse=True)[1].astype(np.int64)
    levels.append((size, rank))
    while size < limit:
        step = min(size, limit - size)
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        pair = rank * (n + 1) + follow
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size += step
        levels.append((size, rank))
    order = np.argsort(rank, kind="stable")
    return order, neighbour_prefix(order, levels, n, limit)


def neighbour_prefix(order: np.ndarray, levels, n: int, limit: int) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it (0 for the first)."""
    common = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    open_ = np.ones(len(a), bool)
    got = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        fits = open_ & (got + size <= limit) & (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[fits] = rank[a[fits]] == rank[b[fits]]
        got += same * size
        a, b = a + same * size, b + same * size
        if size == levels[-1][0]:
            open_ &= ~same
    common[1:] = got
    return common


def previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of every position.

    For a suffix the nearest entries above and below it in suffix order that start
    earlier are its previous and next smaller positions; the least common prefix on the
    way is the length of the match. Both are found by jumping over larger ones.
    """
    n = len(order)
    best = np.zeros(n, np.int64)
    for turned in (False, True):
        sequence = order[::-1] if turned else order
        # least[i]: common prefix of entry i with the entry at jump[i].
        least = np.zeros(n, np.int64)
        least[1:] = common[::-1][:-1] if turned else common[1:]
        jump = np.arange(n) - 1
        least[jump < 0] = 0
        todo = np.flatnonzero((jump >= 0) & (sequence[np.maximum(jump, 0)] > sequence))
        # Jumps are read as they were before the round, so each halves what is left of a chain.
        while len(todo):
            at = jump[todo]
            to, low = jump[at], np.minimum(least[todo], least[at])
            jump[todo], least[todo] = to, low
            alive = (to >= 0) & (low > 0)
            least[todo[to < 0]] = 0
            todo = todo[alive]
            todo = todo[sequence[jump[todo]] > sequence[todo]]
        best[sequence] = np.maximum(best[sequence], least)
    return best


def _parts(data: np.ndarray, offsets: np.ndarray, length: int):
    """Stretches of a slice's texts of at most ``PART_BYTES``, so that positions fit."""
    step = min(PART_BYTES, (1 << PLACE_BITS) - 1) - length
    if offsets[-1] <= step:
        yield np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64), data, offsets
        return
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for begin in range(a, max(b - length + 1, a + 1), step):
            end = min(b, begin + step + length - 1)
            yield np.array([row]), np.array([begin - a]), data[begin:end], np.array([0, end - begin])


def _anchored(part: np.ndarray, bounds: np.ndarray, length: int, k: int):
    rolling = Rolling(LETTERS[part])
    grams = rolling.grams(k)
    return rolling, grams, anchor_runs(grams, bounds, length, k)


def repeated_anchors(docs: DataFrame, length: int, k: int) -> Repeats:
    volume = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(volume * 2 / (length - k + 2))

    def count(frames):
        sketch = PartitionSketch(bits)
        for _, data, offsets in batches(frames, "text", SLICE):
            for _, _, part, bounds in _parts(data, offsets, length):
                _, grams, (_, _, _, at) = _anchored(part, bounds, length, k)
                sketch.add(grams[at])
        yield from sketch.batches()

    return merge(docs.select("text").mapInArrow(count, PartitionSketch.SCHEMA), bits)


RUN = "doc_id long, text_key long, start long, n int, anchor long, content long"


def candidate_runs(docs: DataFrame, repeats: Repeats, length: int, k: int) -> DataFrame:
    """Runs whose anchor may occur again, with their bytes: `RUN` and ``body``."""
    shared = docs.sparkSession.sparkContext.broadcast(repeats)

    def search(frames):
        for rows, data, offsets in batches(frames, "text", SLICE):
            for index, shift, part, bounds in _parts(data, offsets, length):
                rolling, grams, (text, start, n, at) = _anchored(part, bounds, length, k)
                keep = shared.value.may_repeat(grams[at])
                text, start, n, at = text[keep], start[keep], n[keep], at[keep]
                if not len(text):
                    continue
                end = start + n + length - 1
                content = rolling.spans(start, end) + (at - start).astype(U)
                cuts = np.zeros(len(n) + 1, np.int64)
                np.cumsum(end - start, out=cuts[1:])
                body = part[np.repeat(start - cuts[:-1], end - start) + np.arange(cuts[-1])]
                row = pa.array(index[text])
                yield pa.RecordBatch.from_arrays(
                    [
                        column(rows, "doc_id").take(row),
                        column(rows, "text_key").take(row),
                        pa.array(start - bounds[text] + shift[text]),
                        pa.array(n.astype(np.int32)),
                        pa.array(grams[at].view(np.int64)),
                        pa.array(content.view(np.int64)),
                        binary_array(body, cuts),
                    ],
                    ["doc_id", "text_key", "start", "n", "anchor", "content", "body"],
                )

    return docs.mapInArrow(search, RUN + ", body binary")


def place(doc_id: str = "doc_id") -> Column:
    """The order of occurrences: document, text key, place."""
    return F.struct(
        F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.col("text_key").alias("key"), F.col("start").alias("at")
    )


PLACE = "struct<doc: bigint, key: bigint, at: bigint>"
STRETCHES = f"array<struct<begin: int, end: int, first: {PLACE}, many: boolean>>"


def _stretches(kinds: list[tuple], length: int, owner: np.ndarray, many: np.ndarray, cuts: np.ndarray):
    """Per kind of run, its windows in stretches with one first occurrence."""
    out = []
    for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        n = kinds[i]["n"]
        own, rep = owner[lo : lo + n], many[lo : lo + n]
        # Consecutive windows of a stretch start one after another in the first run, too.
        shift = own - np.arange(lo, lo + n)
        change = np.flatnonzero((np.diff(shift) != 0) | (rep[1:] != rep[:-1])) + 1
        edges = [0, *change.tolist(), n]
        found = []
        for a, b in zip(edges[:-1], edges[1:]):
            if rep[a]:
                run = int(np.searchsorted(cuts, own[a], "right")) - 1
                first = kinds[run]["least"]
                found.append(
                    {"begin": a, "end": b, "first": {**first, "at": first["at"] + int(own[a] - cuts[run])}, "many": True}
                )
        out.append(found)
    return out


def sorted_runs(kinds: list[dict], length: int) -> list[list[dict]]:
    """Suffix-sorts runs and tells which windows repeat, and where each occurs first.

    ``kinds`` are dicts with ``anchor, n, least, count, body``, ordered by anchor and, in
    an anchor, by ``least``; so a lower position in their joined bytes is an earlier
    occurrence. Windows of different anchors never match.
    """
    text = np.concatenate([np.frombuffer(k["body"], np.uint8) for k in kinds])
    sizes = np.array([len(k["body"]) for k in kinds])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    anchor = np.unique([k["anchor"] for k in kinds], return_inverse=True)[1]
    starts = np.repeat(cuts[:-1], [k["n"] for k in kinds])
    count = np.array([k["n"] for k in kinds])
    place_ = starts + np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
    order, common = suffix_order(text, length, np.repeat(anchor, sizes))
    # Only positions where a window starts count; a suffix may run on into the next run.
    window = np.zeros(len(text), bool)
    window[place_] = True
    least = common.copy()
    chosen = window[order]
    index = np.flatnonzero(chosen)
    # Between two chosen neighbours the least common prefix on the way is theirs.
    pre = np.minimum.reduceat(least, np.concatenate([[0], index[:-1] + 1])) if len(index) else least[:0]
    positions = order[index]
    pre[:1] = 0
    factor = np.zeros(len(text), np.int64)
    rank = np.argsort(np.argsort(positions))
    factor[np.sort(positions)] = previous_factors(rank, pre)
    # Windows that are equal form a stretch of suffix order; its least position is the first.
    heads = np.flatnonzero(pre < length)
    group = np.cumsum(pre < length) - 1
    first = np.minimum.reduceat(positions, heads) if len(heads) else positions
    owner = np.arange(len(text))
    many = np.zeros(len(text), bool)
    owner[positions] = first[group]
    several = np.diff(np.append(heads, len(positions))) > 1
    many[positions] = several[group] if len(group) else False
    # A window with an earlier match has a previous factor of the full length.
    later = factor >= length
    owner[~later] = np.arange(len(text))[~later]
    runs = np.repeat(np.array([k["count"] > 1 for k in kinds]), sizes)
    return _stretches(kinds, length, owner, many | runs, cuts)


def first_places(runs: DataFrame, length: int, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Per kind of run ``(anchor, content)`` its repeated windows and where each occurs first."""
    kinds = materialize(
        runs.withColumn("place", place())
        .groupBy("anchor", "content")
        .agg(F.min("place").alias("least"), F.count("*").alias("count"), F.first("n").alias("n"), F.first("body").alias("body"))
    )
    width = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    alone = kinds.join(width, "anchor", "left_anti").filter("count > 1")
    alone = alone.select(
        "anchor",
        "content",
        F.array(
            F.struct(F.lit(0).alias("begin"), F.col("n").alias("end"), F.col("least").alias("first"), F.lit(True).alias("many"))
        ).alias("stretches"),
    )
    schema = f"anchor long, content long, stretches {STRETCHES}"

    def sort(frames):
        held, size = [], 0

        def done(block):
            found = sorted_runs(block, length)
            return pa.RecordBatch.from_pylist(
                [{"anchor": k["anchor"], "content": k["content"], "stretches": s} for k, s in zip(block, found)],
                schema=pa.schema(
                    [
                        ("anchor", pa.int64()),
                        ("content", pa.int64()),
                        (
                            "stretches",
                            pa.list_(
                                pa.struct(
                                    [
                                        ("begin", pa.int32()),
                                        ("end", pa.int32()),
                                        ("first", pa.struct([("doc", pa.int64()), ("key", pa.int64()), ("at", pa.int64())])),
                                        ("many", pa.bool_()),
                                    ]
                                )
                            ),
                        ),
                    ]
                ),
            )

        for batch in frames:
            for kind in batch.to_pylist():
                if size > BLOCK_BYTES and kind["anchor"] != held[-1]["anchor"]:
                    yield done(held)
                    held, size = [], 0
                held.append(kind)
                size += len(kind["body"])
        if held:
            yield done(held)

    usual = kinds.join(width.filter(F.col("kinds") <= group_runs).select("anchor"), "anchor", "left_semi")
    usual = usual.repartition("anchor").sortWithinPartitions("anchor", "least", "content")
    by_sorting = usual.mapInArrow(sort, schema).filter(F.size("stretches") > 0)
    wide = kinds.join(width.filter(F.col("kinds") > group_runs).select("anchor"), "anchor", "left_semi")
    return alone.unionByName(by_sorting).unionByName(_split_anchors(wide, length))


def _split_anchors(kinds: DataFrame, length: int) -> DataFrame:
    """`first_places` for anchors with very many runs: one row per window, grouped by hash."""

    def unfold(frames):
        for batch in frames:
            for row in range(batch.num_rows):
                own = batch.slice(row, 1)
                text = np.frombuffer(column(own, "body")[0].as_buffer(), np.uint8)
                n = column(own, "n")[0].as_py()
                at = pa.array(np.zeros(n, np.int64))
                hashes = [Rolling(LETTERS[text], b).grams(length)[:n].view(np.int64) for b in BASES]
                yield pa.RecordBatch.from_arrays(
                    [column(own, c).take(at) for c in ("anchor", "content", "least", "count")]
                    + [pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, hashes)],
                    ["anchor", "content", "least", "count", "w", "h1", "h2"],
                )

    each = kinds.mapInArrow(
        unfold, f"anchor long, content long, least {PLACE}, count long, w int, h1 long, h2 long"
    ).withColumn("here", F.struct("least.doc", "least.key", (F.col("least.at") + F.col("w")).alias("at")))
    by = ["anchor", "h1", "h2"]
    met = each.groupBy(*by).agg(F.min("here").alias("first"), F.sum("count").alias("c")).filter("c > 1").drop("c")
    one = F.struct(F.col("w").alias("begin"), (F.col("w") + 1).alias("end"), F.col("first"), F.lit(True).alias("many"))
    return each.join(met, by).groupBy("anchor", "content").agg(F.sort_array(F.collect_list(one)).alias("stretches"))


def repeated_spans(docs: DataFrame, length: int = 200, keep: str = "first", k: int = 64) -> DataFrame:
    """Bytes to remove: ``(doc_id, text_key, spans)``; ``docs`` has ``doc_id, text, text_key``."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    runs = materialize(candidate_runs(docs, repeated_anchors(docs, length, k), length, k))
    firsts = first_places(runs, length)
    found = runs.drop("body").join(firsts, ["anchor", "content"]).withColumn("s", F.explode("stretches"))
    if keep == "first":
        begin = F.struct(
            F.coalesce("doc_id", F.lit(LAST)).alias("doc"),
            F.col("text_key").alias("key"),
            (F.col("start") + F.col("s.begin")).alias("at"),
        )
        found = found.filter(begin > F.col("s.first"))
    span = F.struct(
        (F.col("start") + F.col("s.begin")).alias("at"),
        (F.col("start") + F.col("s.end") + (length - 1)).alias("end"),
    )
    return found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def without_repeats(
    docs: DataFrame, length: int = 200, keep: str = "first", k: int = 64, body: bool = True
) -> DataFrame:
    """Per document row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (binary)."""
    keyed = texts(docs).withColumn("text_key", text_key())
    spans = repeated_spans(keyed, length, keep, k).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans"
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))

    def cut(frames):
        for rows, data, offsets in batches(frames):
            raw, out = data.tobytes(), {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column(rows, "spans").to_pylist()):
                kept, end, gone, parts = [], 0, 0, 0
                text = raw[a:b]
                for span in spans or ():
                    if span["at"] > end or not parts:
                        parts += 1
                        kept.append(text[end : span["at"]])
                    gone += max(0, span["end"] - max(end, span["at"]))
                    end = max(end, span["end"])
                kept.append(text[end:])
                left = b"".join(kept)
                row = (b - a, gone, parts, hashlib.sha256(left).hexdigest(), left)
                for name, value in zip(out, row):
                    out[name].append(value)
            if not body:
                del out["kept"]
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), *map(pa.array, out.values())], ["doc_id", *out])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * body
    return keyed.join(spans, same, "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
