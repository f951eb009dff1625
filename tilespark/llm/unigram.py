"""Count-only Viterbi over a unigram vocabulary.

The vocabulary is any list of pieces with scores; ``▁`` stands for the blank before a word, and a text is cut before each ``▁``
(the Metaspace rule). Aho-Corasick enumerates all vocabulary matches of a part; the forward pass carries, for each position, the best
score and its piece count only, so no path is kept. Tie rules are those of the unigram tokenizer: a later candidate replaces
an earlier one only with a strictly higher score, candidates coming by ascending start; a character without a piece of its own may
be unknown at the lowest score minus 10, and an unknown stretch counts one piece a byte (byte fallback) or one in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

UNKNOWN_PENALTY = 10.0


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Piece counts of texts. ``limit`` bounds the memo of distinct parts; further parts are counted without being kept."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True, limit: int = 200_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        #: A line end that no piece holds separates independent parts.
        self.cut_lines = byte_fallback and not any("\n" in piece for piece, _ in vocab)
        self.limit, self.memo, self.parts = limit, {}, {}

    def part(self, text: str) -> int:
        """Pieces of one part, by the forward pass."""
        n = len(text)
        score, count, open_run = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        unknown, fallback, end, single = self.unknown, self.byte_fallback, 0, False

        def settle(at: int, has_single: bool) -> None:
            if not has_single:
                tried = score[at - 1] + unknown
                if score[at] is None or tried > score[at]:
                    more = len(text[at - 1].encode("utf-8", "surrogatepass")) if fallback else (0 if open_run[at - 1] else 1)
                    score[at], count[at], open_run[at] = tried, count[at - 1] + more, True

        for last, (length, value) in self.automaton.iter(text):
            while end <= last:  # positions before last + 1 are complete
                if end:
                    settle(end, single)
                end, single = end + 1, False
            start = end - length
            tried = score[start] + value
            if score[end] is None or tried > score[end]:
                score[end], count[end], open_run[end] = tried, count[start] + 1, False
            single = single or length == 1
        while end <= n:
            if end:
                settle(end, single)
            end, single = end + 1, False
        return count[n]

    def _kept(self, part: str) -> int:
        got = self.parts.get(part)
        if got is None:
            got = self.part(part)
            if len(self.parts) < self.limit:
                self.parts[part] = got
        return got

    def _word(self, word: str) -> int:
        """Pieces of one blank-separated word, its ``▁`` included."""
        got = self.memo.get(word)
        if got is None:
            got = 0
            for part in ("▁" + word).split("▁")[1:]:
                if self.cut_lines and "\n" in part:
                    lines = part.split("\n")
                    got += self._kept("▁" + lines[0]) + len(lines) - 1 + sum(map(self._kept, filter(None, lines[1:])))
                else:
                    got += self._kept("▁" + part)
            if len(self.memo) < self.limit:
                self.memo[word] = got
        return got

    def count(self, text: str) -> int:
        """Pieces of a whole text; an empty one has none."""
        if not text:
            return 0
        return sum(map(self._word, (text[1:] if text[0] in " ▁" else text).split(" ")))


_COUNTERS: dict = {}


def token_counts(docs: DataFrame, model_path: str, byte_fallback: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_tokens, n_chars``, one row a document; null and empty texts count 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (model_path, byte_fallback)
        if key not in _COUNTERS:
            _COUNTERS[key] = UnigramCounter(vocabulary(model_path), byte_fallback)
        counter = _COUNTERS[key]
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": [counter.count(t) for t in texts], "n_chars": [len(t) for t in texts]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long, n_chars long")
