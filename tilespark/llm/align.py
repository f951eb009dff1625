"""Alignment of two tokenizers over whole texts.

Both tokenizers cut the bytes of a blank and the text. Python only gives their ids and the byte ends of their tokens; groups and
links are built from these arrays by Spark's higher-order functions, word by word: ``array_intersect`` of the end arrays gives the cuts that
both share. Two cuttings of the same bytes overlap once between any two neighbouring ends of either, so each end stands for one link.

How often a pair of ids is linked is counted over all documents. The frequent pairs, as many as ``max_shared`` allows, are broadcast;
documents that hold others get those by a shuffle join.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tilespark.functions.storage import materialize
from tilespark.llm.batches import portions

#: The pre-tokenizer's pattern of byte-level BPE files (fixed by the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters, with blanks between words only, are cut at their blanks; other texts go to the tokenizers whole.
_PLAIN = r"^[\n\x{21}-\x{7e}\x{a1}-\x{ac}\x{ae}-\x{24f}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5} ]+$"
_ODD = "  |\n | \n|^[ \n]|[ \n]$"
#: Places for the second id in a pair's number.
_PLACES = 1 << 20


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevelSide:
    """Ids and token bytes of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_of()
        added = {}
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        for i, token in self.whole.get_added_tokens_decoder().items():
            added[i] = token.content.encode()
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if i not in added}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError("the file's ids don't follow its merges")
        self.bytes = [b""] * (max([*ranks.values(), *added]) + 1)
        for piece, i in [*ranks.items(), *((v, k) for k, v in added.items())]:
            self.bytes[i] = piece
        self.encoding = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.mark = ranks[b"\0"]
        if any(b"\0" in piece and len(piece) > 1 for piece in ranks):
            raise ValueError("a piece holds a zero byte among others")

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, a blank in front of each, one after the other, and their number by word. No piece joins the zero byte between words."""
        ids = self.encoding.encode_to_numpy(" " + "\0 ".join(words), disallowed_special=())
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
        return ids[ids != self.mark].astype(np.int64), np.diff(np.append(-1, ends)) - 1

    def text(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(" " + text, add_special_tokens=False).ids, np.int64)


class PieceSide:
    """Ids and token bytes of a sentencepiece file that puts a blank before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.begins = np.array([p.startswith("▁") for p in pieces])
        #: Words are independent as long as no piece goes on behind the blank of the next word.
        self.by_word = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [" ".join(words[i : i + 512]) for i in range(0, len(words), 512)]
        ids = np.array([i for run in self.model.encode(runs, num_threads=1) for i in run], np.int64)
        starts = np.flatnonzero(self.begins[ids])
        return ids, np.diff(np.append(starts, len(ids)))

    def text(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


class PairEncoder:
    """Ids of both sides for many texts at once: each distinct word of a portion is encoded once, and nothing is kept between portions.

    The distinct words, a blank in front of each, make up the portion's own text. Texts that may not be cut at their blanks are words by themselves.
    """

    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteLevelSide(path_a), PieceSide(path_b)
        self.lengths = [np.array([len(b) for b in side.bytes], np.int64) for side in self.sides]
        self.pieces = [pa.array(side.bytes, pa.binary()) for side in self.sides]

    def _spelled(self, s: int, ids: np.ndarray) -> bytes:
        """The bytes of a side's tokens, joined."""
        row = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), self.pieces[s].take(pa.array(ids)))
        return pc.binary_join(row, pa.scalar(b"", pa.binary()))[0].as_py()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Offsets of the texts in a list of word numbers, these numbers, and each side's ids with their number by word.

        Texts that are null or empty, or that either side doesn't spell, have no words.
        """
        texts = pc.fill_null(texts, "")
        full = pc.not_equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        plain = pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.invert(pc.match_substring_regex(texts, _ODD))).to_numpy(zero_copy_only=False)
        plain = plain & full & self.sides[1].by_word
        cut = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        words = cut.flatten().dictionary_encode()
        distinct, which = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        spelled = "".join(f" {w}" for w in distinct).encode()
        found = [side.words(distinct) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for side in self.sides]
        if any(len(n) != len(distinct) or self._spelled(s, ids) != spelled for s, (ids, n) in enumerate(found)):
            raise RuntimeError("words of plain characters are not spelled by a tokenizer")
        ids, counts = [[f[0]] for f in found], [[f[1]] for f in found]
        n_words = np.zeros(len(texts), np.int64)
        n_words[plain] = np.diff(cut.offsets.to_numpy())
        for i in np.flatnonzero(~plain & full):
            text = texts[int(i)].as_py()
            own = [side.text(text) for side in self.sides]
            if all(self._spelled(s, x) == b" " + text.encode() for s, x in enumerate(own)):
                n_words[i] = 1
                for s in range(2):
                    ids[s].append(own[s])
                    counts[s].append(np.array([len(own[s])]))
        of_plain = np.repeat(plain, n_words)
        word = np.empty(len(of_plain), np.int64)
        word[of_plain] = which
        word[~of_plain] = len(distinct) + np.arange(len(word) - len(which))
        return np.append(0, np.cumsum(n_words)), word, [(np.concatenate(ids[s]), np.concatenate(counts[s])) for s in range(2)]


_ENCODERS: dict = {}
_DOC = "doc_id:long,n_a:int,n_b:int,words:array<int>"
_SIDE = "{0}:array<int>,{0}e:array<int>,{0}x:array<int>"


def tokenised(docs: DataFrame, path_a: str, path_b: str, chunk: int = 1 << 21) -> DataFrame:
    """A row for each portion of about ``chunk`` bytes of text: its documents as lists of word numbers, and the tokens of its distinct words.

    A word has ids ``a, b``, byte ends ``ae, be`` of its tokens, and ``ax, bx``: for each byte the place of the token that holds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path_a, path_b)
        if key not in _ENCODERS:
            _ENCODERS[key] = PairEncoder(*key)
        encoder = _ENCODERS[key]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        lists = lambda bounds, x: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32)))
        for batch in batches:
            for doc_ids, texts in portions(batch, chunk):
                bounds, word, sides = encoder.encode_all(texts)
                totals, columns = [], []
                for lengths, (ids, n) in zip(encoder.lengths, sides):
                    starts = np.append(0, np.cumsum(n))
                    long = lengths[ids]
                    ends = np.append(0, np.cumsum(long))
                    place = np.arange(len(ids)) - np.repeat(starts[:-1], n)
                    totals.append(np.diff(np.append(0, np.cumsum(n[word]))[bounds]))
                    columns += [lists(starts, ids), lists(starts, ends[1:] - np.repeat(ends[starts[:-1]], n)), lists(ends[starts], np.repeat(place, long))]
                struct = pa.StructArray.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(t.astype(np.int32)) for t in totals), lists(bounds, word)], ["doc_id", "n_a", "n_b", "words"])
                words = pa.StructArray.from_arrays(columns, ["a", "ae", "ax", "b", "be", "bx"])
                yield pa.RecordBatch.from_arrays([one(struct), one(words)], ["docs", "words"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"docs array<struct<{_DOC}>>, words array<struct<{_SIDE.format('a')},{_SIDE.format('b')}>>")


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _ids(side: str) -> str:
    """The ids of one side's tokens from the byte ``i`` to the byte before ``j`` of word ``w``, as text."""
    first, last = f"w.{side}x[i]", f"w.{side}x[j - 1]"
    return f"if({first} = {last}, string(w.{side}[{first}]), array_join(slice(w.{side}, {first} + 1, {last} - {first} + 1), ','))"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs(doc_id, text)`` -> a row a document: ``doc_id, n_a, n_b, n_groups, groups`` (``a1,a2|b1;...``) and ``links`` (pairs of ids as one number, one for each overlap).

    The shared cuts of a word are the intersection of its end arrays; a group holds the tokens between the bytes at two neighbouring cuts.
    A link stands for each end of either side: the tokens that hold the byte before it. Words that both sides cut alike need neither: their
    tokens pair off.
    """
    pairs = f"zip_with(concat(array(0), slice(k, 1, size(k) - 1)), k, (i, j) -> {_ids('a')} || '|' || {_ids('b')})"
    groups = f"if(w.ae = w.be, zip_with(w.a, w.b, (x, y) -> string(x) || '|' || string(y)), {_let('k', 'array_intersect(w.ae, w.be)', pairs)})"
    links = f"""if(w.ae = w.be, zip_with(w.a, w.b, (x, y) -> bigint(x) * {_PLACES} + y),
        transform(array_union(w.ae, w.be), e -> bigint(w.a[w.ax[e - 1]]) * {_PLACES} + w.b[w.bx[e - 1]]))"""
    t = tokenised(docs, path_a, path_b).withColumn("words", F.expr(f"transform(words, w -> struct(array_join({groups}, ';') as groups, {links} as links))"))
    each = _let("s", "words", """transform(docs, d -> struct(d.doc_id, d.n_a, d.n_b,
        array_join(transform(d.words, w -> s[w].groups), ';') as groups, flatten(transform(d.words, w -> s[w].links)) as links))""")
    out = t.select(F.explode(F.expr(each)).alias("d")).select("d.*")
    return out.select("doc_id", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - F.size("links")).alias("n_groups"), "groups", "links")


def _shared_from(pairs: DataFrame, max_shared: int) -> int:
    """The smallest power of two such that at most ``max_shared`` pairs are linked in as many documents or more."""
    level = F.floor(F.log2("n")).cast("int")
    found = {r["level"]: r["pairs"] for r in pairs.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()}  # at most 63 rows
    total, low = 0, 63
    for k in sorted(found, reverse=True):
        total += found[k]
        if total > max_shared:
            break
        low = k
    return 1 << min(low, 62)


def report(docs: DataFrame, path_a: str, path_b: str, max_shared: int = 1 << 20) -> DataFrame:
    """``docs(doc_id, text)`` -> a row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts the links whose pair is linked in as many documents as any pair of their first id, ``count_sum`` sums these document
    counts over all links. Null and empty texts, and texts that a tokenizer doesn't spell, give zeros and ''. Rows that repeat a doc_id
    are documents of their own. At most ``max_shared`` pairs are broadcast.
    """
    found = aligned(docs, path_a, path_b).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "links",
        F.when(F.col("n_groups") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
    stored = materialize(found, "aligned")
    counted = stored.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counted = materialize(counted.withColumn("a", F.expr(f"pair div {_PLACES}")), "pairs")
    best = counted.groupBy("a").agg(F.max("n").alias("most"))
    pairs = materialize(counted.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")), "pairs")
    low = _shared_from(pairs, max_shared)
    shared, others = F.broadcast(pairs.where(F.col("n") >= low)), pairs.where(F.col("n") < low)
    links = stored.select("row", F.explode("links").alias("pair"))
    scored = links.join(shared, "pair").select("row", "n", "best")
    if others.take(1):
        scored = scored.unionByName(links.join(shared, "pair", "left_anti").join(others, "pair").select("row", "n", "best"))
    sums = scored.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    longs = [F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")]
    return stored.select("row", "doc_id", *longs, F.size("links").cast("long").alias("n_links"), "groups_sha256").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
