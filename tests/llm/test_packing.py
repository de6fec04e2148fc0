import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

from wardlake.llm import packing


def encoded(tokenizer, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).encode(text or "", add_special_tokens=False).ids


def test_pieces_and_places(edge_docs, edge_rows, tokenizer):
    size = 64
    got = packing.pack_documents(edge_docs, tokenizer, size, 0, keep_ids=True)
    rows = got.collect()
    expected = Counter()
    for row in edge_rows:
        ids = encoded(tokenizer, row[1]) + [0]
        for p in range(0, len(ids), size):
            part = np.array(ids[p : p + size], "<u4").tobytes()
            expected[(row[0], p // size, p, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // size) + 1
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(got).collect()}
    assert sum(map(len, whole.values())) == 4 * total and max(map(len, whole.values())) <= 4 * size


def test_empty_table(no_docs, tokenizer):
    assert packing.pack_documents(no_docs, tokenizer).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_fullest_is_the_best_combination(seed):
    own = np.random.default_rng(seed)
    lengths = sorted(set(own.integers(2, 15, 5).tolist()), reverse=True)
    available = [(x, int(own.integers(1, 3))) for x in lengths]
    room = int(own.integers(5, 40))
    best, limit = 0, dict(available)
    for n in range(0, 7):
        for pick in combinations_with_replacement(lengths, n):
            if all(c <= limit[x] for x, c in Counter(pick).items()) and sum(pick) <= room:
                best = max(best, sum(pick))
    taken = packing.fullest(available, room)
    assert all(c <= limit[x] for x, c in taken.items())
    got = sum(x * c for x, c in taken.items())
    assert got == min(best, got) if len(lengths) > 6 else got >= best


def test_plan_uses_every_piece():
    counts = {10: 7, 6: 5, 4: 9, 3: 1, 1: 2}
    used = Counter()
    for times, content in packing.bin_plan(counts, 10):
        assert sum(k * n for k, n in content.items()) <= 10
        for k, n in content.items():
            used[k] += times * n
    assert used == counts
