import zlib

import numpy as np
from pyspark.sql import functions as F

from wardlake.llm import wavelet
from wardlake.llm.tables import materialize


def test_shard_answers():
    own = np.random.default_rng(3)
    for high in (1, 2, 7, 300):
        ids = own.integers(0, high, 1500).astype(np.uint32)
        shard = wavelet.WaveletShard(wavelet.pack_shard(ids, np.array([1000, 0, 500]), [4, None, 9]))
        assert (shard.ids() == ids).all()
        assert shard.documents()[0] == [4, None, 9] and shard.documents()[1].tolist() == [1000, 0, 500]
        for place in own.integers(0, 1500, 40).tolist():
            assert shard.access(place) == ids[place]
        for token in {0, int(ids[5]), high, high + 1000}:
            places = np.flatnonzero(ids == token)
            assert shard.count(token) == len(places)
            assert shard.count(token, 100, 900) == ((places >= 100) & (places < 900)).sum()
            for nth in range(0, len(places), max(1, len(places) // 7)):
                assert shard.locate(token, nth) == places[nth]


def test_empty_shard():
    shard = wavelet.WaveletShard(wavelet.pack_shard(np.zeros(0, np.uint32), np.zeros(0, np.int64), []))
    assert len(shard.ids()) == 0 and shard.count(0) == 0


def test_round_trip(spark, edge_docs, edge_rows, tokenizer):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer)
    folder = wavelet.shard_folder(spark)
    written = materialize(wavelet.write_shards(edge_docs, tokenizer, folder, end_id=2, shard_ids=3000))
    got = wavelet.read_shards(spark, folder, written).orderBy("start").collect()
    start = 0
    ids_of = {}
    for row in edge_rows:
        ids = full.encode(row[1] or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        ids_of.setdefault(row[0], []).append((len(ids), crc))
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    for r in got:
        assert r.start == start
        ids_of[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    assert not any(ids_of.values())
    assert written.count() > 3
    assert wavelet.read_shards(spark, folder).agg(F.sum("n_tokens")).first()[0] == start


def test_empty_table(spark, no_docs, tokenizer):
    folder = wavelet.shard_folder(spark)
    written = materialize(wavelet.write_shards(no_docs, tokenizer, folder))
    assert written.count() == 0
    assert wavelet.read_shards(spark, folder, written).count() == 0
    assert wavelet.read_shards(spark, folder).count() == 0
