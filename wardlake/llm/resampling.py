"""Importance resampling towards a target's distribution of hashed words.

Features are runs of one to ``longest`` words; a feature's bucket is the CRC-32 of its
bytes modulo ``buckets``. One pass counts the buckets of all documents and of the target:
every task adds up an array and sends it once. A bucket's gain is the log ratio of the two
smoothed shares, a document's weight the mean gain of its features; Gumbel noise from a
hash of the id turns the highest scores into draws without replacement.

The scores are written to the shared folder. The least score that is drawn is found by
bisection: exact counting jobs over the written scores halve the range of scores, several
thresholds a job, until one value is left; another bisection finds the largest ``doc_id``
among the rows tied there. Ranks come from range partitions of the drawn rows alone: each
is numbered by its own task and starts after the rows of the partitions before it. Nothing is
sorted as a whole and no list of documents reaches the driver.

Edge cases: a null text has no words; a document without features has weight 0; a null id
counts as an empty text in the noise and comes last among ties; rows of one id keep a row
each, and where they tie, fewer features and then less weight come first; empty tables
give empty results, an empty target gains that only follow the documents; other columns do not
matter. A very long text is one numpy slice of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import batches, column
from .hashing import NOT_ALNUM, Words
from .tables import materialize, texts

BUCKETS, LEAST_WORDS, SEED = 10_000, 20, 2024
#: Thresholds of one counting job.
WAYS = 16
#: Rows of the drawn set that one task numbers.
RANK_ROWS = 1_000_000


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every stretch of ``data``, one byte of all stretches at a time."""
    table = _crc_table()
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(start - end, kind="stable")
    size = (end - start)[order]
    at, value = start[order], crc[order]
    live = len(order)
    for step in range(int(size[0]) if live else 0):
        # Longest first, so what is still open is a prefix.
        live = int(np.searchsorted(-size[:live], -step, "left"))
        byte = data[at[:live] + step]
        value[:live] = table[(value[:live] ^ byte) & 0xFF] ^ (value[:live] >> np.uint32(8))
    crc[order] = value
    return ~crc


def _joined(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of all runs of ``n`` words joined by one space, and their texts."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if n == 1:
        return words.data, words.start, words.end, text
    size = words.end - words.start + 1
    ends = np.cumsum(size)
    body = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    place = np.repeat(words.start - (ends - size), size) + np.arange(len(body))
    inside = np.ones(len(body), bool)
    inside[ends - 1] = False
    body[inside] = words.data[place[inside]]
    run = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
    return body, (ends - size)[run], ends[run + n - 1] - 1, text[run]


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int):
    """Per feature of a slice its bucket and its text's number; and the words of every text."""
    words = Words(data, offsets, NOT_ALNUM, fold=True)
    parts = [_joined(words, n) for n in range(1, longest + 1)]
    found = [(crc32(*p[:3]).astype(np.int64) % buckets, p[3]) for p in parts]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.diff(words.first)


def bucket_counts(rows: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts; tasks send one row per bucket they met."""

    def count(frames):
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in batches(frames):
            total += np.bincount(features(data, offsets, longest, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Floored scaled log ratio of the smoothed shares of every bucket."""
    all_s, all_t, n = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: (float(t + 1) * float(all_s + n)) / (float(s + 1) * float(all_t + n))
    return np.array([math.floor(scale * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighted(rows: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def weigh(frames):
        for part, data, offsets in batches(frames):
            bucket, text, words = features(data, offsets, longest, len(shared.value))
            n = np.bincount(text, minlength=part.num_rows)
            # A double sum would round; integers keep the floor exact.
            total = np.zeros(part.num_rows, np.int64)
            np.add.at(total, text, shared.value[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(n), pa.array(words.astype(np.int64)), pa.array(weight)],
                ["doc_id", "n_features", "n_words", "weight"],
            )

    return rows.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def score(weight, doc_id, seed: int = SEED):
    """The weight with Gumbel noise fixed by ``seed`` and the id, in thousandths, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _greatest(rows: DataFrame, value: str, enough: int) -> int:
    """The greatest number ``x`` so that at least ``enough`` rows have ``value >= x``.

    ``rows`` has at least ``enough`` rows. Each job counts the rows from ``WAYS - 1``
    thresholds on, exactly, and leaves one of ``WAYS`` parts of the range.
    """
    least, most = rows.agg(F.min(value), F.max(value)).first()
    while least < most:
        size = most - least
        marks = sorted({least + max(1, -(-size * i // WAYS)) for i in range(1, WAYS + 1)})
        counts = rows.agg(*[F.count_if(F.col(value) >= m) for m in marks]).first()
        reached = [m for m, n in zip(marks, counts) if n >= enough]
        missed = [m for m, n in zip(marks, counts) if n < enough]
        least = max([least, *reached])
        most = min([most, *(m - 1 for m in missed)])
    return least


def _cutoff(scored: DataFrame, wanted: int):
    """The condition of rows that may be drawn: all above the cut, and those tied there up to an id."""
    cut = _greatest(scored, "score", wanted)
    above = scored.filter(F.col("score") > cut).count()
    tied = scored.filter(F.col("score") == cut).select((-F.col("doc_id").cast("decimal(20,0)")).alias("down"))
    with_id = tied.filter("down is not null")
    if with_id.count() < wanted - above:
        return F.col("score") >= cut
    last = -int(_greatest(with_id, "down", wanted - above))
    return (F.col("score") > cut) | ((F.col("score") == cut) & (F.col("doc_id") <= last))


def _ranked(drawn: DataFrame, rows: int) -> DataFrame:
    """``drawn`` with ``rank``: its place by score, id, features and weight."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    parts = max(1, -(-rows // RANK_ROWS))
    dealt = drawn.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = [*drawn.columns, "place", "part"]

    def number(frames):
        done, part = 0, TaskContext.get().partitionId()
        for batch in frames:
            place = pa.array(np.arange(done + 1, done + batch.num_rows + 1))
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, place, pa.array(np.full(len(place), part, np.int32))], names)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in drawn.schema)
    placed = materialize(dealt.mapInArrow(number, f"{kind}, place long, part int"))
    # As many rows as range partitions: what comes before each of them.
    sizes = placed.groupBy("part").agg(F.max("place").alias("n")).orderBy("part").collect()
    before = dict(zip([r.part for r in sizes], np.cumsum([0, *(r.n for r in sizes)]).tolist()))
    if not before:
        return placed.withColumn("rank", F.col("place")).drop("place", "part")
    starts = drawn.sparkSession.createDataFrame([(p, n) for p, n in before.items()], "part int, before long")
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("place")).drop("place", "part", "before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = LEAST_WORDS,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_column: str = "doc_id",
) -> DataFrame:
    """Per document ``doc_id, n_features, n_words, weight, score, rank``.

    Of the documents with ``least_words`` words the ``percent`` of highest score are
    drawn; ``rank`` is their place and null for the others.
    """
    rows = texts(docs, id_column)
    wanted_text = target.select(F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(rows, longest, buckets), bucket_counts(wanted_text, longest, buckets))
    scored = _weighted(rows, gain, longest).withColumn("score", score(F.col("weight"), F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    long_enough = scored.filter(F.col("n_words") >= least_words)
    wanted = percent * long_enough.count() // 100
    columns = ["doc_id", "n_features", "n_words", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    may = (F.col("n_words") >= least_words) & F.coalesce(_cutoff(long_enough, wanted), F.lit(False))
    ranked = _ranked(scored.filter(may), wanted)
    # Rows of one id that share the last place are all ranked; those beyond the number wanted are not drawn.
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.filter(~may).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))
