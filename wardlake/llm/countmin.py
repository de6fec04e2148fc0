"""Count-min sketches of k-gram hashes, built per partition and merged.

A counter only has to tell "once" from "more often", so it saturates at two. Partitions
send the counters they touched, packed by segment; segments are merged each on its own,
and what comes back is one bit per counter: was it met more than once. The estimate is
never too low, so a hash that occurs twice always passes.

The number of counters follows the number of hashes up to ``MOST_BITS``; beyond that the
sketch lets more hashes pass that occur only once, and nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import U, mix

#: log2 of the counters of a row: at most 64 MB of bits for the two rows together.
MOST_BITS = 28
ROWS = 2
SEGMENT_BITS = 20


def sketch_bits(hashes: float) -> int:
    """log2 of the counters per row: four to eight for each hash."""
    return int(min(MOST_BITS, max(SEGMENT_BITS, np.ceil(np.log2(max(hashes, 1) * 4)))))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each hash in a row."""
    return (mix(hashes + U(row) * U(0xA0761D6478BD642F)) >> U(64 - bits)).astype(np.int64)


class PartitionSketch:
    """The counters a partition touched, kept as sorted runs and packed at the end."""

    SCHEMA = "part int, counters binary"

    def __init__(self, bits: int):
        self.bits = bits
        self.held: list[np.ndarray] = []
        self.size = 0
        self.rows: list[np.ndarray] = []

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size > 1 << 21:
            self._fold()

    def _fold(self) -> None:
        if self.held:
            found, count = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            self.rows.append(np.concatenate([found, found[count > 1]]))

    def batches(self):
        """``(part, counters)`` per row and segment: counter numbers, those met twice given twice."""
        self._fold()
        low = (1 << SEGMENT_BITS) - 1
        for hashes in self.rows:
            for row in range(ROWS):
                cell = np.sort(cells(hashes, row, self.bits))
                segment = cell >> SEGMENT_BITS
                cuts = np.flatnonzero(np.diff(segment, prepend=-1))
                ends = np.append(cuts[1:], len(cell))
                parts = [(row << (self.bits - SEGMENT_BITS)) | int(segment[a]) for a in cuts]
                data = [(cell[a:b] & low).astype("<u4").tobytes() for a, b in zip(cuts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "counters"])


class Repeats:
    """Bits of the merged sketch; `may_repeat` is true for every hash that occurs twice."""

    def __init__(self, bits: int, planes: np.ndarray):
        self.bits, self.planes = bits, planes

    def may_repeat(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(ROWS):
            cell = cells(hashes, row, self.bits)
            out &= (self.planes[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def merge(sketches: DataFrame, bits: int) -> Repeats:
    """Merges partition sketches (`PartitionSketch.SCHEMA`) segment by segment."""

    def close(part: int, once: np.ndarray, more: np.ndarray):
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())],
            ["part", "bits"],
        )

    def add(frames):
        # Rows come sorted by segment; one segment's counters are held at a time.
        part, once, more = None, None, None
        for batch in frames:
            for p, counters in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part:
                    if part is not None:
                        yield close(part, once, more)
                    part, once, more = p, np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)
                cell = np.frombuffer(counters.as_buffer(), "<u4")
                more[cell[once[cell]]] = True
                once[cell] = True
                more[cell[1:][cell[1:] == cell[:-1]]] = True
        if part is not None:
            yield close(part, once, more)

    merged = sketches.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, bits binary")
    planes = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
    size = 1 << (SEGMENT_BITS - 3)
    for r in merged.toLocalIterator():
        row, segment = r["part"] >> (bits - SEGMENT_BITS), r["part"] & ((1 << (bits - SEGMENT_BITS)) - 1)
        planes[row, segment * size : (segment + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return Repeats(bits, planes)
