from zlib import crc32

import numpy as np
import pytest

from tests.llm.common import clashing, documents, edge_rows, sentence
from tramline.llm import training_order as O
from tramline.llm.token_ids import encode


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutation(size):
    slots = O.permute(np.arange(size), size, key=5)
    assert sorted(slots.tolist()) == list(range(size))
    assert O.permute(slots, size, key=5, inverse=True).tolist() == list(range(size))
    if size > 64:
        assert (slots != O.permute(np.arange(size), size, key=6)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(size), slots)[0, 1]) < 0.2


def test_large_domains():
    size = 10**15 + 7
    numbers = np.random.default_rng(1).integers(0, size, 5000)
    slots = O.permute(numbers, size)
    assert slots.min() >= 0 and slots.max() < size
    assert (O.permute(slots, size, inverse=True) == numbers).all()


def ids(text):
    return np.concatenate((encode(text), [0])).astype("<u4")


def test_the_mark_for_the_end_of_a_text_is_one_id(spark, tmp_path):
    O.materialise(documents(spark, [(1, "a <|endoftext|> b")]), str(tmp_path / "marked"))
    row = spark.read.parquet(str(tmp_path / "marked")).first()
    assert O.unpack(row.ids, row.n_tokens).tolist() == [64, 220, 50256, 275, 0]


def test_shards_hold_every_sequence(spark, tmp_path):
    rows = edge_rows() + [(100 + k, sentence(k, 5 + k)) for k in range(70)]
    docs = documents(spark, rows, 5)
    size, stride = O.materialise(docs, str(tmp_path / "a"), stride=16)
    assert (size, stride) == (len(rows), 16)
    written = spark.read.parquet(str(tmp_path / "a")).collect()
    assert sorted(r.slot for r in written) == list(range(size))
    assert all(r.shard == r.slot // 16 for r in written)
    back = sorted(((r.doc_id, O.unpack(r.ids, r.n_tokens).tobytes()) for r in written), key=repr)
    assert back == sorted(((i, ids(t).tobytes()) for i, t in rows), key=repr)


def test_shards_are_read_in_order_and_resumed(spark, tmp_path):
    docs = documents(spark, [(k, f"text {k}") for k in range(50)])
    folder = str(tmp_path / "b")
    _, stride = O.materialise(docs, folder, stride=8)
    for shard in range(7):
        slots = [r.slot for r in spark.read.parquet(f"{folder}/shard={shard}").coalesce(1).collect()]
        assert slots == list(range(8 * shard, min(50, 8 * shard + 8)))
    assert sorted(r.slot for r in O.read_from(spark, folder, 29, stride).collect()) == list(range(29, 50))
    assert sorted(r.slot for r in O.read_from(spark, folder, 29).collect()) == list(range(29, 50))
    assert O.manifest(spark, folder) == {"sequences": 50, "stride": 8, "key": O.KEY, "rounds": O.ROUNDS, "end_id": O.END_ID}


def test_digests(spark):
    rows = edge_rows()
    for docs in (documents(spark, rows), clashing(spark, rows)):
        found = O.training_order(docs, stride=4).collect()
        assert sorted(r.slot for r in found) == list(range(len(rows)))
        assert all((r.shard, r.place) == divmod(r.slot, 4) for r in found)
        wanted = sorted(((i, len(ids(t)), crc32(ids(t).tobytes())) for i, t in rows), key=repr)
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=repr) == wanted
    assert O.training_order(documents(spark, [])).count() == 0


def test_keys_change_the_order(spark):
    docs = documents(spark, [(k, "x") for k in range(40)], 1)
    order = lambda key: [r.doc_id for r in sorted(O.training_order(docs, key=key).collect(), key=lambda r: r.slot)]
    assert order(1) == order(1) != order(2)


def test_strides_keep_the_shards_few():
    assert O.shard_stride(10) == O.STRIDE and O.shard_stride(10, 3) == 3
    assert 10**12 / O.shard_stride(10**12) <= O.MAX_SHARDS
