"""Whole-text token ids at word-cache speed, equal to the tokenizer's own ids."""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that ``ByteEncoder`` doesn't cut: runs of white space other than one or two line ends, white space at the ends, other kinds of white space.
_ODD = "  | \n|\n |\n\n\n|\n\n\\z|^ | \\z|[\t\r\x0b\x0c\x1c-\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: White space other than blank, tab and line ends: such a text goes to the tokenizer whole.
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: A Latin word with at most one closing mark; every such letter has a one-letter lower case and is NFC already.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


class _Cache(dict):
    """A memo bounded in entries and in the length of its keys: once full, further keys are computed without being kept."""

    def __init__(self, compute, limit: int, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest and len(self) < self.limit:
            self[key] = value
        return value


class WordEncoder:
    """Ids of a ``tokenizers`` file whose pre-tokenizer drops white space (``word_bpe_49k.json``).

    No token spans white space there, so the ids of a text are those of its words one after the other; words are
    encoded once and kept in a bounded memo. Texts that hold one of the file's special tokens go to the tokenizer whole, as
    the rules of such tokens look beyond words. ``encode(text)`` gives little-endian unsigned 32-bit ids as bytes.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        tokenize = self.tokenizer.model.tokenize

        def piece_ids(piece: str) -> bytes:
            mapped = byte_level.pre_tokenize_str(piece)[0][0]
            return np.array([t.id for t in tokenize(mapped)], "<u4").tobytes()

        self.pieces = _Cache(piece_ids, limit // 2)
        self.words = _Cache(self._word, limit)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            return self._whole(word)
        return self.pieces[plain[1].lower()] + (self.pieces[plain[2]] if plain[2] else b"")

    def encode(self, text: str) -> bytes:
        if _RARE_SPACE.search(text) or any(t in text for t in self.special):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


class ByteEncoder:
    """Ids of a ``tiktoken`` rank file with the GPT-style split pattern; lossless.

    The pattern never joins a non-space with the white space after it, and a single line end between words is a part of its own.
    Texts whose words are parted by single blanks and by one or two line ends are therefore cut there, and the *distinct* words of
    many texts are encoded in one call, parted by line ends, whose id tells where a word ends. Other texts go to the library whole.
    Nothing is kept from one call to the next. ``dtype`` is the smallest unsigned type that holds the vocabulary and the end id.
    """

    #: Marks put before a word that begins its text, and found before one that begins a line.
    FIRST, LINE = "\r", "\n"

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.eos = max(ranks.values()) + 1
        self.dtype = "<u2" if self.eos < 65_536 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.line_end = ranks[b"\n"]

    def encode(self, text: str) -> bytes:
        """Ids of one text, by the library alone."""
        return np.array(self.encoding.encode_ordinary(text), self.dtype).tobytes()

    def _each(self, words: list[str], before: str) -> list[bytes]:
        """Ids of every one of ``words`` (without white space), each with ``before`` in front."""
        if not words:
            return []
        ids = self.encoding.encode_to_numpy(before + ("\n" + before).join(words), disallowed_special=())
        ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
        if len(ends) != len(words):
            raise RuntimeError("a word holds the id of a line end")
        data, width = ids.astype(self.dtype).tobytes(), self.width
        starts = np.append(0, ends[:-1] + 1)
        return [data[a:b] for a, b in zip((starts * width).tolist(), (ends * width).tolist())]

    def _table(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: those behind a mark have no blank in front, all others have one."""
        plain = sorted({w[1:] for w in words if w[:1] in (self.FIRST, self.LINE)})
        spaced = [w for w in words if w[:1] not in (self.FIRST, self.LINE)]
        alone, after = dict(zip(plain, self._each(plain, ""))), iter(self._each(spaced, " "))
        end = np.array([self.line_end], self.dtype).tobytes()
        return [alone[w[1:]] if w[:1] == self.FIRST else end + alone[w[1:]] if w[:1] == self.LINE else next(after) for w in words]

    def encode_all(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of every text (null: none)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = self.encode(texts[int(i)].as_py())
        easy = np.flatnonzero(~odd)
        marked = pc.binary_join_element_wise(self.FIRST, pc.replace_substring(texts.take(pa.array(easy)), "\n", " \n"), "")
        cut = pc.split_pattern(marked, " ")
        words = cut.flatten().dictionary_encode()
        table, which, at = self._table(words.dictionary.to_pylist()), words.indices.to_numpy(), cut.offsets.to_numpy()
        for i, a, b in zip(easy.tolist(), at[:-1].tolist(), at[1:].tolist()):
            out[i] = b"".join(map(table.__getitem__, which[a:b].tolist()))
        return out


_ENCODERS: dict = {}


def word_encoder(path: str, limit: int = 600_000) -> WordEncoder:
    """One encoder a Python worker; ``limit`` words are kept."""
    if ("word", path, limit) not in _ENCODERS:
        _ENCODERS["word", path, limit] = WordEncoder(path, limit)
    return _ENCODERS["word", path, limit]


def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    if ("byte", path) not in _ENCODERS:
        _ENCODERS["byte", path] = ByteEncoder(path, pattern)
    return _ENCODERS["byte", path]
