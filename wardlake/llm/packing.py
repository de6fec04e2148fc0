"""Best-fit packing by minimum bin slack.

Documents become token ids with a separator; documents longer than a sequence are cut,
all other stay whole. How many pieces have each length is all the packing needs, and
there are at most ``size`` lengths. A bin takes the longest piece left, then a bitset
subset-sum over the lengths still available finds the fullest feasible rest, and the
combination is removed. As long as a combination remains available it stays the fullest,
so it is removed as often as the counts allow in one step; the number of steps depends
on ``size`` alone. Pieces are then ranked within their length, in buckets, and the rank
says which bin a piece goes to.

Edge cases: a null text counts as empty and still gives one piece (its separator); an
empty table gives no pieces; repeated rows and ids are packed each on its own; other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_rows import binary_array, column
from .tables import materialize, texts
from .tokens import encoded

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one ranking bucket, about.
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids: each document's ids, then ``separator``.

    ``keep_ids`` adds the ids as little-endian unsigned 32-bit integers.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut(frames):
        for rows, ids, starts in encoded(frames, tokenizer):
            n = len(rows)
            if not n:
                continue
            ids = np.insert(ids, starts[1:], separator).astype("<u4")
            starts = starts + np.arange(n + 1)
            sizes = np.diff(starts)
            count = -(-sizes // size)
            row = np.repeat(np.arange(n), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = piece * size
            length = np.minimum(size, sizes[row] - begin)
            at = starts[row] + begin
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            out = [column(rows, "doc_id").take(pa.array(row)), piece.astype(np.int32), begin, length, crc]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in out]
            if keep_ids:
                arrays.append(binary_array(ids.view(np.uint8), np.append(4 * at, 4 * len(ids))))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return texts(docs).mapInArrow(cut, PIECE + ", ids binary" * keep_ids)


def fullest(available: list[tuple[int, int]], room: int) -> Counter:
    """The combination of available ``(length, count)`` that leaves the least of ``room``.

    Bit ``s`` of a set tells that the lengths so far can add up to ``s``. Longer pieces
    come first, and the search ends when the room can be filled, so that short pieces,
    which fit anywhere, are kept for later bins.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, count in available:
        count = min(count, room // length)
        part = 1
        while count > 0:
            # Counts are added in parts of 1, 2, 4 ..., each either taken or not.
            many = min(part, count)
            steps.append((length, many, reach))
            reach |= (reach << (length * many)) & mask
            count -= many
            part *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, Counter()
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += many
            total -= length * many
    return taken


def bin_plan(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """``(how many bins, length -> pieces in each)`` until no piece is left."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan = []
    while left:
        longest = max(left)
        rest = [(k, v - (k == longest)) for k, v in sorted(left.items(), reverse=True)]
        content = fullest([x for x in rest if x[1] > 0 and x[0] <= size - longest], size - longest)
        content[longest] += 1
        times = min(left[k] // n for k, n in content.items())
        plan.append((times, dict(content)))
        for k, n in content.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def plan_table(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Per plan step and length: ranks it takes, and where their pieces go."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for times, content in plan:
        offset = 0
        for length in sorted(content, reverse=True):
            rows.append((length, used[length], content[length], sequence, offset))
            used[length] += times * content[length]
            offset += length * content[length]
        sequence += times
    rows.sort()
    names = ["length", "rank", "each", "sequence", "offset"]
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to materialised pieces (columns of `pieces`)."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = plan_table(bin_plan(histogram, size))
    total = sum(histogram.values())
    buckets = max(1, total // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    cut = cut.withColumn("_bucket", bucket)
    sizes = cut.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "length",
        "_bucket",
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_bucket"])
    shared = spark.sparkContext.broadcast(table)

    def place(frames):
        t = shared.value
        # Steps are sorted by (length, first rank); a rank belongs to the last step at or before it.
        by_length = np.searchsorted(t["length"], np.arange(size + 2))
        for rows in frames:
            length = column(rows, "length").to_numpy()
            rank = column(rows, "_rank").to_numpy()
            step = np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = length == k
                lo, hi = by_length[k], by_length[k + 1]
                step[own] = lo + np.searchsorted(t["rank"][lo:hi], rank[own], "right") - 1
            turn, nth = np.divmod(rank - t["rank"][step], t["each"][step])
            arrays = [rows.column(i) for i in range(rows.num_columns - 1)]
            arrays += [pa.array(t["sequence"][step] + turn), pa.array(t["offset"][step] + nth * length)]
            yield pa.RecordBatch.from_arrays(arrays, rows.schema.names[:-1] + ["sequence_id", "offset"])

    kept = [c for c in cut.columns if c != "_bucket"]
    ranked = ranked.select(*kept, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    schema = T.StructType(
        [cut.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its sequence and its place in it."""
    return pack(materialize(pieces(docs, tokenizer, size, separator, keep_ids)), size)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence from pieces packed with their ids: ``ids`` as 32-bit integers.

    A sequence holds at most ``size`` ids, so no group can grow.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("length"),
        F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"),
        F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"),
    )
