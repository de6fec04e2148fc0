import numpy as np
import pytest

from wardlake.llm import vector_codes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain product quantisation over all pairs."""
    ok = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) and abs(x) < 2**16 for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(x * scale)) for x in r[1]]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    data = np.floor(np.array([r[1] for r in ok], float) * scale).astype(np.int64)
    books = [p[:entries].copy() for p in np.array_split(data, parts, axis=1)]
    cut = np.array_split(data, parts, axis=1)
    nearest = lambda x, b: ((x[:, None] - b[None]) ** 2).sum(-1).argmin(1)
    for _ in range(rounds):
        for x, b in zip(cut, books):
            own = nearest(x, b)
            for k in range(len(b)):
                if (own == k).any():
                    b[k] = x[own == k].sum(0) // (own == k).sum()
    codes = [nearest(x, b) for x, b in zip(cut, books)]
    error = sum(((x - b[c]) ** 2).sum(1) for x, b, c in zip(cut, books, codes))
    by = {}
    for r, e in zip(ok, error):
        by[r[2]] = by.get(r[2], 0) + int(e)
    out = [(r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), by[r[2]]) for i, r in enumerate(ok)]
    return out, books


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("spread,n,length", [(0.02, 900, 8), (1.0, 700, 10), (0.0, 300, 8)])
def test_equals_brute_force(spark, spread, n, length):
    """Clustered, spread out, and many equal vectors with a third in one point; null and bad ones."""
    own = np.random.default_rng(n)
    centres = own.normal(size=(12, length))
    at = np.where(own.random(n) < 1 / 3, 0, own.integers(0, 12, n))
    data = np.round(centres[at] + spread * own.normal(size=(n, length)), 3)
    rows = [(int(i), [float(x) for x in v], int(k) % 3 if k else None) for i, v, k in zip(own.permutation(n), data, at)]
    rows += [(5000, None, 1), (5001, [1.0] * (length - 1) + [None], 1), (5002, [float("nan")] * length, 1)]
    rows += [(5003, [float("inf")] * length, 1), (5004, [], 1), (5005, [0.0] * (length + 1), 1), (5006, [3e8] * length, 2)]
    rows += [rows[0], (None, rows[1][1], None), (rows[2][0], rows[3][1], 2)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, code int, entries string")
    got, books = vector_codes.compress(frame.repartition(3), entries=64)
    want, their = brute(rows, entries=64)
    assert key([(r.vec_id, r.code, r.error, r.label_error) for r in got.collect()]) == key(want)
    assert vector_codes.books_sha256(books) == vector_codes.books_sha256(their)
    close = np.abs(vector_codes.decode(want[0][1], books) - np.concatenate([b[int(want[0][1][2 * i : 2 * i + 2], 16)] for i, b in enumerate(their)]) / 1024)
    assert close.max() == 0


def test_trees_prune_and_assign_whole_nodes():
    own = np.random.default_rng(1)
    centres = own.integers(-(10**6), 10**6, (32, 8))
    points = vector_codes.build_tree(centres[own.integers(0, 32, 4000)] + own.integers(-5, 5, (4000, 8)), 16)
    tree, number = vector_codes.entry_tree(centres)
    nodes, _, leaves = vector_codes.meet(points, tree)
    whole = sum((points.end[nodes] - points.start[nodes]).tolist())
    assert whole > 3500 and whole + sum(int(points.end[n] - points.start[n]) for n, _ in leaves) == 4000
    assert len(nodes) < 600
    got = vector_codes.owners(points, centres)
    assert (got == ((points.points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)).all()
    total, count = vector_codes.sums(points, centres, tree, number)
    assert count.sum() == 4000 and (total.sum(0) == points.points.sum(0)).all()


def test_ties_and_equal_entries():
    book = np.array([[4, 0], [0, 0], [4, 0], [0, 8]])
    points = vector_codes.build_tree(np.array([[2, 0], [4, 0], [2, 4], [0, 4], [-9, -9]]), 1)
    own = np.empty(5, int)
    own[points.order] = vector_codes.owners(points, book)
    assert own.tolist() == [0, 0, 0, 1, 1]


def test_empty_and_short_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert none.collect() == [] and books == []
    got, books = vector_codes.compress(spark.createDataFrame([(7, [1.0, -0.5, 0.25, 2.0], None)], schema))
    assert [tuple(r) for r in got.collect()] == [(7, None, "00000000", 0, 0)] and [b.tolist() for b in books] == [[[1024]], [[-512]], [[256]], [[2048]]]
