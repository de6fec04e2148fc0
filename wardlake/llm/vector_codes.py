"""Vector code compression: product codes learned by dual-tree Lloyd rounds.

A vector's components become integers, the vector is cut into equal parts and every part
is replaced by the number of the nearest entry of that part's codebook. Codebooks start
from the vectors with the least ids; each round assigns all parts and moves every entry
to the floored mean of its parts. All arithmetic is in integers, so results are exact.

Vectors are dealt into blocks once. A block holds, for each part, a tree over its own
vectors: boxes, sums and counts of nodes, points in leaf order. The blocks are written to
the shared folder and read in every round. In a task the tree of a block meets the tree
over the entries: a pair of nodes is dropped if the least distance of their boxes exceeds
the greatest distance from the points' node to some other node of entries. A node of
points that is left with one entry is assigned whole, with its cached sum and count; only
points of leaves that stay uncertain are compared one by one. Tasks send sums by entry,
so the driver sees codebook-sized tables and never a vector.

Edge cases: vectors that are null or hold null or non-finite components are left out, as
are those with a component of 2**26 or more once it is an integer (squared distances
over 512 components would not fit a long) and those of another length than the vector with the least
id. If the length is no multiple of ``parts``, the first parts are one longer. A null id
comes after all others; vectors of one id keep a row each. Fewer vectors than entries make
a smaller codebook, an empty table an empty result. Equal distances go to the lower entry.
Labels may be null; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import column
from .tables import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components from here on are left out: below it 512 squared differences fit a long.
LARGEST = 1 << 26
#: Vectors of a block, and points of a leaf of its trees.
BLOCK, LEAF = 4096, 16


@dataclass
class Tree:
    """Nodes over ``points``; node 0 is the root and ``child`` the first of two, -1 in a leaf."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def build_tree(points: np.ndarray, leaf: int) -> Tree:
    """Halves the points along the widest side of their box until ``leaf`` or equal points are left."""
    order = np.arange(len(points))
    start, end, child, low, high, total = [0], [len(points)], [], [], [], []
    node = 0
    while node < len(start):
        own = points[order[start[node] : end[node]]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        total.append(own.sum(axis=0))
        wide = int((high[-1] - low[-1]).argmax())
        if len(own) <= leaf or high[-1][wide] == low[-1][wide]:
            child.append(-1)
        else:
            half = len(own) // 2
            order[start[node] : end[node]] = order[start[node] : end[node]][np.argpartition(own[:, wide], half)]
            child.append(len(start))
            start += [start[node], start[node] + half]
            end += [start[node] + half, end[node]]
        node += 1
    as_array = lambda x: np.array(x, np.int64)
    return Tree(points[order], order, *map(as_array, (start, end, child, low, high, total)))


def entry_tree(entries: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree of single entries. Of equal entries only the first can win, so the others stay out."""
    _, first = np.unique(entries, axis=0, return_index=True)
    first.sort()
    tree = build_tree(entries[first], 1)
    return tree, first[tree.order]


def meet(points: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Walks both trees together.

    Returns the point nodes that one entry owns, that entry's node, and the leaves that
    stay uncertain, each with the entry nodes still possible.
    """
    owned, owner, open_leaves = [], [], []
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(p):
        below = np.maximum(entries.low[e] - points.high[p], points.low[p] - entries.high[e])
        least = (np.maximum(below, 0) ** 2).sum(axis=1)
        far = np.maximum(entries.high[e] - points.low[p], points.high[p] - entries.low[e])
        most = (far**2).sum(axis=1)
        head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        bound = np.repeat(np.minimum.reduceat(most, head), np.diff(np.append(head, len(p))))
        # Pairs at the bound stay: their entry may win a tie.
        p, e = p[least <= bound], e[least <= bound]
        single = entries.child[e] < 0
        head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        count = np.diff(np.append(head, len(p)))
        one = (count == 1) & single[head]
        owned.append(p[head[one]])
        owner.append(e[head[one]])
        ready = np.logical_and.reduceat(single, head) & (points.child[p[head]] < 0) & ~one
        for h, n in zip(head[ready].tolist(), count[ready].tolist()):
            open_leaves.append((int(p[h]), e[h : h + n]))
        left = np.repeat(~one & ~ready, count)
        p, e = p[left], e[left]
        # Both sides step down; a leaf stays where it is.
        both = []
        for a, tree in ((p, points), (e, entries)):
            both.append((np.where(tree.child[a] < 0, a, tree.child[a]), np.where(tree.child[a] < 0, 1, 2)))
        (p, np_), (e, ne) = both
        first = np.concatenate([p, np.where(np_ == 2, p + 1, -1), p, np.where(np_ == 2, p + 1, -1)])
        second = np.concatenate([e, e, np.where(ne == 2, e + 1, -1), np.where(ne == 2, e + 1, -1)])
        real = (first >= 0) & (second >= 0)
        p, e = first[real], second[real]
        sort = np.lexsort((e, p))
        p, e = p[sort], e[sort]
    return np.concatenate(owned or [p]), np.concatenate(owner or [e]), open_leaves


def _nearest(own: np.ndarray, book: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Per point the number among ``some`` (ascending) of the nearest entry, the lower of equal ones."""
    gap = own[:, None, :] - book[some][None, :, :]
    return some[np.einsum("ijk,ijk->ij", gap, gap).argmin(axis=1)]


def owners(points: Tree, book: np.ndarray) -> np.ndarray:
    """Per point, in the tree's order, the number of its nearest entry."""
    tree, number = entry_tree(book)
    out = np.empty(len(points.points), np.int64)
    nodes, entries, leaves = meet(points, tree)
    for node, entry in zip(nodes.tolist(), entries.tolist()):
        out[points.start[node] : points.end[node]] = number[tree.start[entry]]
    for node, some in leaves:
        at = slice(points.start[node], points.end[node])
        out[at] = _nearest(points.points[at], book, np.sort(number[tree.start[some]]))
    return out


def sums(points: Tree, book: np.ndarray, tree: Tree, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points nearest to each entry; whole nodes add their cached sums."""
    total, count = np.zeros_like(book), np.zeros(len(book), np.int64)
    nodes, entries, leaves = meet(points, tree)
    to = number[tree.start[entries]]
    np.add.at(total, to, points.total[nodes])
    np.add.at(count, to, points.end[nodes] - points.start[nodes])
    for node, some in leaves:
        own = points.points[points.start[node] : points.end[node]]
        best = _nearest(own, book, np.sort(number[tree.start[some]]))
        np.add.at(total, best, own)
        np.add.at(count, best, 1)
    return total, count


def _packed(tree: Tree) -> dict[str, bytes]:
    return {
        "points": tree.points.astype("<i4").tobytes(),
        "order": tree.order.astype("<i4").tobytes(),
        "nodes": np.stack([tree.start, tree.end, tree.child]).astype("<i4").tobytes(),
        "boxes": np.stack([tree.low, tree.high]).astype("<i4").tobytes(),
        "total": tree.total.astype("<i8").tobytes(),
    }


def _unpacked(cell: dict[str, bytes], width: int) -> Tree:
    ints = lambda name: np.frombuffer(cell[name], "<i4").astype(np.int64)
    start, end, child = ints("nodes").reshape(3, -1)
    low, high = ints("boxes").reshape(2, -1, width)
    total = np.frombuffer(cell["total"], "<i8").reshape(-1, width)
    return Tree(ints("points").reshape(-1, width), ints("order"), start, end, child, low, high, total)


TREE = "struct<points: binary, order: binary, nodes: binary, boxes: binary, total: binary>"


def widths(length: int, parts: int) -> list[int]:
    """Components of every part; the first ones are one longer if need be."""
    return [length // parts + (i < length % parts) for i in range(parts)]


def _blocks(kept: DataFrame, length: int, parts: int) -> DataFrame:
    """One row per block: ids and labels of its vectors, and a tree per part."""
    edges = np.cumsum([0, *widths(length, parts)])

    def build(frames):
        for batch in frames:
            for first in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(first, BLOCK)
                whole = column(rows, "vector").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, length)
                trees = [_packed(build_tree(whole[:, a:b], LEAF)) for a, b in zip(edges[:-1], edges[1:])]
                offsets = pa.array([0, rows.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, column(rows, c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.array([trees], pa.list_(pa.struct([(n, pa.binary()) for n in trees[0]])))], ["ids", "labels", "trees"]
                )

    kind = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(build, f"ids array<bigint>, labels array<{kind}>, trees array<{TREE}>")


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The books after one round: every used entry at the floored mean of its parts."""

    def add(frames):
        trees = [entry_tree(b) for b in books]
        total, count = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in frames:
            for cells in column(batch, "trees"):
                for part, cell in enumerate(cells.as_py()):
                    found = sums(_unpacked(cell, books[part].shape[1]), books[part], *trees[part])
                    total[part] += found[0]
                    count[part] += found[1]
        for part, n in enumerate(count):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), part, np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array(n[used]),
                    pa.array(list(total[part][used]), pa.list_(pa.int64())),
                ],
                ["part", "entry", "n", "total"],
            )

    found = blocks.select("trees").mapInArrow(add, "part int, entry int, n long, total array<long>")
    wide = F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
    long = found.select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
    # At most a row per part, entry and component reaches the driver.
    rows = long.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), wide).collect()
    moved = [b.copy() for b in books]
    for r in rows:
        moved[r.part][r.entry, r.place] = int(r.x) // r.n
    return moved


def _assigned(blocks: DataFrame, books: list[np.ndarray], label_type: str) -> DataFrame:
    """``vec_id, label, entries, error`` of every vector."""

    def assign(frames):
        for batch in frames:
            for ids, labels, cells in zip(column(batch, "ids"), column(batch, "labels"), column(batch, "trees")):
                codes, errors = [], 0
                for book, cell in zip(books, cells.as_py()):
                    tree = _unpacked(cell, book.shape[1])
                    own = owners(tree, book)
                    code, error = np.empty(len(own), np.int32), np.empty(len(own), np.int64)
                    code[tree.order] = own
                    error[tree.order] = ((tree.points - book[own]) ** 2).sum(axis=1)
                    codes.append(code)
                    errors = errors + error
                flat = np.stack(codes, axis=1)
                ends = np.arange(len(flat) + 1, dtype=np.int32) * len(books)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel())), pa.array(errors)],
                    ["vec_id", "label", "entries", "error"],
                )

    return blocks.mapInArrow(assign, f"vec_id long, label {label_type}, entries array<int>, error long")


def books_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def learn(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """The blocks of the kept vectors and the codebooks after ``rounds`` rounds."""
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= float(LARGEST // scale)))
    own = own.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad)
    own = own.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale)))
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return _blocks(own, 1, 1), []
    length = len(first[0].vector)
    if length < parts:
        raise ValueError("vectors have fewer components than parts")
    blocks = materialize(_blocks(own.filter(F.size("vector") == length), length, parts))
    if any(len(r.vector) != length for r in first):
        same = own.filter(F.size("vector") == length)
        first = same.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    whole = np.array([r.vector for r in first], np.int64)
    edges = np.cumsum([0, *widths(length, parts)])
    books = [np.ascontiguousarray(whole[:, a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return blocks, reduce(lambda b, _: _round(blocks, b), range(rounds), books)


def compress(vectors: DataFrame, label: str = "label", **options) -> tuple[DataFrame, list[np.ndarray]]:
    """Per vector ``vec_id, label, code, error, label_error``, and the codebooks.

    ``code`` has two hex digits per part (more if a book has over 256 entries).
    """
    blocks, books = learn(vectors, label=label, **options)
    kind = vectors.select(label).schema[0].dataType.simpleString()
    if not books:
        none = f"vec_id long, label {kind}, code string, error long, label_error long"
        return vectors.sparkSession.createDataFrame([], none), books
    digits = max(2, len(f"{max(len(b) for b in books) - 1:x}"))
    hexed = F.transform("entries", lambda x: F.lpad(F.lower(F.hex(x)), digits, "0"))
    found = materialize(_assigned(blocks, books, kind).select("vec_id", "label", F.array_join(hexed, "").alias("code"), "error"))
    own = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    with_labels = found.join(own, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return with_labels.select("vec_id", "label", "code", "error", "label_error"), books


def decode(code: str, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    digits = len(code) // len(books)
    return np.concatenate([b[int(code[i * digits : (i + 1) * digits], 16)] for i, b in enumerate(books)]) / scale
