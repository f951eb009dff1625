import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.helpers import AWKWARD, documents
from tilespark.llm import unigram
from tilespark.llm.tokens import ByteEncoder, WordEncoder

LETTERS = "abc deTh \n\t \r\x0b\x1c  é日本🙂'sing.,!0ß ÀΣσ́ªº ▁"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(4000)]
    return made + [t for t in AWKWARD if t] + ["don't I'LL", "a\n\nb\n", "  ", "ΑΣ ΑΣΑ"]


def test_word_ids(texts):
    ours, tok = WordEncoder(P.path("word_bpe_49k.json"), limit=50), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for text, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == e.ids


def test_word_ids_of_special_tokens():
    ours, tok = WordEncoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for text in ("a <|endoftext|> b", "x<|startoftext|>y Z", "<|ENDOFTEXT|> c", "<|endoftext|>", "<|endoftext"):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ours.encode("a <|endoftext|> b"), "<u4").tolist()[1] == 49407


def test_byte_ids(texts):
    ours = ByteEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(1)
    lines = ["".join(rng.choice(["ab", "C'd", " ", " ", "\n", "\n\n", "12", "é,", "日", "'s", "\n\n\n"]) for _ in range(rng.randrange(12))) for _ in range(4000)]
    for some in (texts, lines, ["", None, "\n", "a", "a\n", "\n\na"]):
        got = ours.encode_all(pa.array(some, pa.string()))
        assert [np.frombuffer(g, ours.dtype).tolist() for g in got] == [ours.encoding.encode_ordinary(t or "") for t in some]
    assert ours.encode_all(pa.array([], pa.string())) == []


def test_unigram_counts_equal_the_tokenizer(texts):
    vocab = unigram.vocabulary(P.path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(vocab, 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    ours = unigram.UnigramCounter(vocab, limit=50)
    for text, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert ours.count(text) == len(e.ids)


@pytest.mark.parametrize("seed", range(8))
def test_unigram_ties_and_unknown_runs(seed):
    rng = random.Random(seed)
    score = (lambda: -float(rng.randrange(3))) if seed % 2 else (lambda: -rng.random() * 5)
    vocab = [("<unk>", 0.0)] + [(p, score()) for p in ("▁", "a", "b", "ab", "ba", "▁a", "▁ab", "c", "cd", "abc")]
    tok = Tokenizer(models.Unigram(vocab, 0, False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    ours = unigram.UnigramCounter(vocab, byte_fallback=False)
    for text in ("".join(rng.choice("abcdxy ") for _ in range(rng.randrange(20))) for _ in range(800)):
        assert ours.count(text) == len(tok.encode(text, add_special_tokens=False).ids), text


def test_counts_of_awkward_documents(spark):
    got = {r.doc_id: r for r in unigram.token_counts(documents(spark, AWKWARD), P.path("piece_bpe_32k.model")).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[6].n_tokens == got[7].n_tokens > 0 and got[9].n_chars == 60_000
    assert unigram.token_counts(documents(spark, []), P.path("piece_bpe_32k.model")).count() == 0
