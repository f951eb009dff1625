import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.helpers import AWKWARD, documents
from tilespark.llm import shards
from tilespark.llm.tokens import ByteEncoder


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 1000, 4096, 4097])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    y = shards.feistel(x, n, 7)
    assert sorted(y.tolist()) == list(range(n)) and (shards.feistel(y, n, 7, inverse=True) == x).all()
    if n > 100:
        assert (y != shards.feistel(x, n, 8)).mean() > 0.9 and abs(np.corrcoef(x, y)[0, 1]) < 0.2


def test_shards_hold_the_documents_in_training_order(spark):
    docs = documents(spark, AWKWARD).repartition(3, "doc_id").cache()
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    index, folder = shards.order_documents(docs, *args, key=5, stride=64, shard_slots=50)
    index = index.cache()
    rows = shards.read_shards(spark, folder, index, 64, 2).join(index, "slot").orderBy("slot").collect()
    n = len(rows)
    assert [r.slot for r in rows] == list(range(n)) and all(r.shard == r.slot // 50 and r.position == r.slot % 50 for r in rows)
    assert all(zlib.crc32(np.array(r.ids, "<u2").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in rows)
    by_index = [rows[s].ids for s in shards.feistel(np.arange(n), n, 5)]
    encoder = ByteEncoder(*args)
    texts = [r.text for part in docs.rdd.glom().collect() for r in part]
    want = [t for text in texts for t in [*encoder.encoding.encode_ordinary(text or ""), encoder.eos]]
    assert [t for ids in by_index for t in ids] == want
    assert {d for r in rows for d in r.doc_ids} == set(range(len(AWKWARD)))
    rest = shards.read_shards(spark, folder, index, 64, 2, first_slot=n - 7).orderBy("slot").collect()
    assert [r.ids for r in rest] == [r.ids for r in rows[-7:]]


def test_no_documents(spark):
    assert shards.order_documents(documents(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)[0].count() == 0
