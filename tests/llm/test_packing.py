import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, documents
from tilespark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_best_fit_is_valid_and_never_below_the_bound(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, n = packing.best_fit_decreasing(lengths, 100)
    used = np.zeros(n, np.int64)
    for b, o, x in sorted(zip(bins, offsets, lengths)):
        assert o == used[b]
        used[b] += x
    assert (used <= 100).all() and packing.lower_bound(lengths, 100) <= n <= (11 * packing.lower_bound(lengths, 100)) / 9 + 2


def test_bound_of_large_items():
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
    assert packing.lower_bound(np.array([100, 1]), 100) == 2


def test_pieces_hold_the_tokenizer_ids(spark):
    tok = Tokenizer.from_file(PATH)
    rows = packing.token_pieces(documents(spark, AWKWARD), PATH, 64).collect()
    for i, text in enumerate(AWKWARD):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 64)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)


def test_packing_is_gapless_in_every_sequence(spark):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 3000).tolist()
    pieces = spark.createDataFrame([(i, i % 7, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE_SCHEMA)
    few = packing.pack(pieces, 64, items_per_part=100_000).collect()
    many = packing.pack(pieces, 64, items_per_part=200).collect()
    for rows in (few, many):
        assert len(rows) == len(lengths)
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in by.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 64
    n = lambda rows: len({r.sequence_id for r in rows})
    assert n(many) <= n(few) * 1.03 and n(few) <= packing.lower_bound(np.array(lengths), 64) * 1.02 + 1
    assert packing.pack(pieces.limit(0), 64).count() == 0
