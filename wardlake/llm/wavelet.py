"""Token ids in wavelet-matrix files.

One file holds one shard, a run of documents in ascending ``doc_id`` order. The ids of a
shard are stored as bit planes, highest bit first; after each plane the ids are dealt
stably into those with a zero and those with a one. Ranks over the planes answer three
questions without decoding the rest: the id at a place, how often an id occurs, and
where its n-th occurrence is.

File: ``WMX1``, a 4-byte header length, a JSON header (ids, planes, zeros per plane,
byte ranges), then the parts, each packed by itself with zlib: the planes, the documents'
sizes and the documents' ids. A shard's planes are read alone when only they are needed.

Edge cases: a null text counts as empty and still gets its end id; a null ``doc_id`` is
ordered first; rows that share a ``doc_id`` are ordered by a hash of their text, equal
ones keep one place each; an empty table gives no file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlake.session import checkpoint_dir

from .arrow_rows import column
from .tables import text_key, texts
from .tokens import encoded

MAGIC = b"WMX1"
#: Ids of one shard, about: a shard ends with the document that reaches it.
SHARD_IDS = 1 << 21
#: Ids of one stored rank sample.
BLOCK = 512


def pack_shard(ids: np.ndarray, sizes: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The bytes of one file."""
    n = len(ids)
    depth = max(1, int(ids.max(initial=0)).bit_length())
    level, planes, zeros = ids.astype(np.uint32), [], []
    for shift in range(depth - 1, -1, -1):
        bit = (level >> np.uint32(shift)) & np.uint32(1) == 1
        planes.append(np.packbits(bit, bitorder="little").tobytes())
        level = np.concatenate([level[~bit], level[bit]])
        zeros.append(int(n - np.count_nonzero(bit)))
    parts = planes + [sizes.astype("<i8").tobytes(), json.dumps(doc_ids).encode()]
    packed = [zlib.compress(p, 1) for p in parts]
    header = json.dumps({"n": n, "zeros": zeros, "parts": [len(p) for p in packed]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed])


class WaveletShard:
    """A file's content, answering access, counting and lookup."""

    def __init__(self, data: bytes):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<I", data[4:8])[0]
        header = json.loads(bytes(data[8 : 8 + size]))
        self.n, self.zeros = header["n"], header["zeros"]
        ends = 8 + size + np.cumsum([0, *header["parts"]])
        self._parts = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
        self._planes: list = [None] * len(self.zeros)
        self._ranks: list = [None] * len(self.zeros)

    def bits(self, plane: int) -> np.ndarray:
        """The plane's bits, unpacked on first use."""
        if self._planes[plane] is None:
            raw = np.frombuffer(zlib.decompress(self._parts[plane]), np.uint8)
            self._planes[plane] = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            ones = np.add.reduceat(self._planes[plane], np.arange(0, self.n, BLOCK), dtype=np.int64) if self.n else []
            self._ranks[plane] = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
        return self._planes[plane]

    def rank1(self, plane: int, place: int) -> int:
        """Ones before ``place``."""
        bits = self.bits(plane)
        block = place // BLOCK
        return int(self._ranks[plane][block]) + int(np.count_nonzero(bits[block * BLOCK : place]))

    def _select(self, plane: int, one: bool, nth: int) -> int:
        bits = self.bits(plane)
        starts = np.arange(len(self._ranks[plane])) * BLOCK
        counts = self._ranks[plane] if one else np.minimum(starts, self.n) - self._ranks[plane]
        block = int(np.searchsorted(counts, nth, "right")) - 1
        part = bits[block * BLOCK : (block + 1) * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == one)[nth - counts[block]])

    def access(self, place: int) -> int:
        """The id at a place of the shard."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for plane, zeros in enumerate(self.zeros):
            one = bool(self.bits(plane)[place])
            ones = self.rank1(plane, place)
            place = zeros + ones if one else place - ones
            value = value << 1 | one
        return value

    def _narrow(self, token: int, start: int, end: int) -> tuple[int, int]:
        for plane, zeros in enumerate(self.zeros):
            a, b = self.rank1(plane, start), self.rank1(plane, end)
            if token >> (len(self.zeros) - 1 - plane) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in a range of places."""
        if token < 0 or token >> len(self.zeros):
            return 0
        a, b = self._narrow(token, start, self.n if end is None else end)
        return b - a

    def locate(self, token: int, nth: int) -> int:
        """The place of the id's n-th occurrence, from 0."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        place = self._narrow(token, 0, self.n)[0] + nth
        for plane in range(len(self.zeros) - 1, -1, -1):
            one = bool(token >> (len(self.zeros) - 1 - plane) & 1)
            place = self._select(plane, one, place - self.zeros[plane] if one else place)
        return place

    def ids(self) -> np.ndarray:
        """All ids: from the last plane upwards, each deal is undone."""
        level = np.zeros(self.n, np.uint32)
        for plane in range(len(self.zeros) - 1, -1, -1):
            bit, zeros = self.bits(plane), self.zeros[plane]
            before = np.empty_like(level)
            before[~bit] = level[:zeros]
            before[bit] = level[zeros:] | np.uint32(1 << (len(self.zeros) - 1 - plane))
            level = before
            self._planes[plane] = None
        return level

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The ids of the documents and their sizes, in order."""
        return json.loads(zlib.decompress(self._parts[-1])), np.frombuffer(zlib.decompress(self._parts[-2]), "<i8")


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes under a name of its own first, so a file is whole or absent, also if a task runs twice."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        out.write(data)
    where.move(own, f"{path}/{name}")


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards of ``docs`` below ``folder`` (a URI all executors share).

    Returns ``(shard, n_docs, n_ids)``, one row per file; file ``<shard>.wmx``. Documents
    are dealt to tasks by ranges of ``doc_id``, and a task cuts its documents into shards.
    """
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs).withColumn("_key", text_key())
    dealt = rows.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first(), "_key").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "_key"
    )

    def write(frames):
        from pyspark import TaskContext

        task, shard = TaskContext.get().partitionId(), 0
        ids, sizes, doc_ids, held = [], [], [], 0

        def flush():
            nonlocal shard, ids, sizes, doc_ids, held
            name = f"{task:08d}-{shard:06d}"
            size = np.concatenate(sizes)
            _put(folder, f"{name}.wmx", pack_shard(np.concatenate(ids), size, doc_ids))
            out = pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(size)], "n_ids": [held]})
            shard, ids, sizes, doc_ids, held = shard + 1, [], [], [], 0
            return out

        for batch, part, starts in encoded(frames, tokenizer, limit=4 << 20):
            part = np.insert(part, starts[1:], end_id)
            starts = starts + np.arange(len(starts))
            numbers = column(batch, "doc_id").to_pylist()
            first = 0
            while first < len(numbers):
                last = int(np.searchsorted(starts, starts[first] + shard_ids - held))
                last = min(max(last, first + 1), len(numbers))
                ids.append(part[starts[first] : starts[last]])
                sizes.append(np.diff(starts[first : last + 1]))
                doc_ids += numbers[first:last]
                held += int(starts[last] - starts[first])
                first = last
                if held >= shard_ids:
                    yield flush()
        if sizes:
            yield flush()

    return dealt.mapInArrow(write, "shard string, n_docs long, n_ids long")


def read_shards(spark: SparkSession, folder: str, written: DataFrame | None = None) -> DataFrame:
    """Per document, read from the files: ``doc_id, start, n_tokens, ids_crc32, shard``.

    ``written``, if given, names the files that belong to the data set.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmx").load(folder).select(
        F.regexp_extract("path", r"([0-9-]+)\.wmx$", 1).alias("shard"), "content"
    )

    def decode(frames):
        for batch in frames:
            for name, content in zip(column(batch, "shard").to_pylist(), column(batch, "content")):
                shard = WaveletShard(content.as_buffer().to_pybytes())
                numbers, sizes = shard.documents()
                ends = np.cumsum(sizes)
                view = memoryview(shard.ids().astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * (b - a) : 4 * b]) for a, b in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(numbers, pa.int64()),
                        "place": ends - sizes,
                        "n_tokens": sizes,
                        "ids_crc32": pa.array(crc, pa.int64()),
                        "shard": pa.array([name] * len(sizes)),
                    }
                )

    found = files.mapInArrow(decode, "doc_id long, place long, n_tokens long, ids_crc32 long, shard string")
    if written is None:
        written = found.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    # Shard totals are summed per task first, so no window meets all shards.
    task = F.substring("shard", 1, 8)
    within = Window.partitionBy("_task").orderBy("shard")
    shards = written.withColumn("_task", task).withColumn("_in_task", F.sum("n_ids").over(within) - F.col("n_ids"))
    tasks = written.groupBy(task.alias("_task")).agg(F.sum("n_ids").alias("_n"))
    tasks = tasks.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_of_task"))
    starts = shards.join(tasks, "_task").select("shard", (F.col("_in_task") + F.col("_of_task")).alias("_start"))
    return found.join(starts, "shard").select(
        "doc_id", (F.col("_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "shard"
    )


def shard_folder(spark: SparkSession) -> str:
    """A new folder for a data set below the shared one, as a URI."""
    root = checkpoint_dir(spark).rstrip("/")
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/tokens-{uuid.uuid4().hex}"
