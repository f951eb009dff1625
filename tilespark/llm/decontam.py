"""Benchmark decontamination by latent semantic retrieval.

1. Every document becomes a row of word codes, written once: a word (lower-cased, without outer marks) of the benchmark has its
   code, all others have code 0. Document frequencies of the codes over all documents give the IDF weights.
2. The benchmark items are cut into overlapping passages of ``window`` words, with a binary TF-IDF row each. A randomised SVD of
   these rows, with the products over the passages run on Spark, gives the latent space.
3. Every document is cut into windows with half a window's stride. What counts is the cosine of a passage to the part of a window
   that the passage's words make up, so that foreign words beside a short or common item change nothing; its square is the inner
   product of window and passage over the passage's squared norm.
4. Passages are indexed by their rare words, the fewest that leave under half of ``least`` of the squared norm to the others: a window that
   holds too little of them can't reach ``least``. For the (window, passage) pairs that can, the latent inner product is taken,
   and the norms of what lies outside the latent space bound its error. Pairs that may reach ``least`` are candidates; one exact
   inner product each settles them, so that the result doesn't depend on the rank.
5. Candidates are verified on their word order, all places of a document until one passes, the best first: the IDF-weighted
   longest common subsequence of the item and the text around neighbouring windows, and the presence of the item's answer (its
   last sentence). A document leaks an item if the common subsequence covers ``sure`` of the item or of a passage found there, or
   ``likely`` of the item along with the answer.

No decision on an item depends on the other items, so a benchmark beyond ``max_bytes`` is searched part by part with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tilespark.functions.storage import materialize
from tilespark.llm.batches import portions

_MARKS = ".,;:!?\"'()[]{}<>*%#&$|-_"
#: Words of documents worked on together by one task, and the bytes of text that become codes together.
_SLICE, _CHUNK = 1 << 20, 1 << 24


def plain(word: str) -> str:
    return word.lower().strip(_MARKS)


class Vocabulary:
    """Codes from 1 of the benchmark's words; 0 for all others."""

    def __init__(self, texts: list[str]):
        words = sorted({plain(w) for t in texts for w in t.split()} - {""})
        self.code = {w: i + 1 for i, w in enumerate(words)}
        self.size = len(words) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32

    def item(self, text: str) -> np.ndarray:
        """Codes of an item's words, those that are marks alone left out."""
        return np.array([c for w in text.split() if (c := self.code.get(plain(w), 0))], np.int64)

    def codes(self, texts: pa.StringArray) -> list[bytes]:
        """Codes of every text, distinct words looked up once."""
        cut = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        words = cut.flatten().dictionary_encode()
        table = np.fromiter((self.code.get(plain(w), 0) for w in words.dictionary.to_pylist()), self.dtype, len(words.dictionary))
        found, at = table[words.indices.to_numpy()] if len(table) else np.zeros(0, self.dtype), cut.offsets.to_numpy()
        return [found[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def coded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, codes``, one row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in portions(batch, _CHUNK):
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(shared.value.codes(texts), pa.binary())], names=["doc_id", "codes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, codes binary")


def document_frequencies(codes: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Documents that hold each code, over all rows; at most one row a code reaches the driver."""
    size, dtype = vocabulary.size, vocabulary.dtype

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for some in _slices(batch["codes"], dtype):
                doc = np.repeat(np.arange(len(some)), [len(c) for c in some])
                every = np.concatenate(some)
                held = every > 0
                total += np.bincount(np.unique(doc[held] * np.int64(size) + every[held]) % size, minlength=size)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"code": found.astype(np.int64), "n": total[found]})

    got = codes.select("codes").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[got["code"]] = got["n"]
    return out


def _slices(rows, dtype) -> Iterator[list[np.ndarray]]:
    """Rows of codes in lists of about ``_SLICE`` words (a longer row alone)."""
    some, n = [], 0
    for data in rows:
        codes = np.frombuffer(data, dtype)
        if some and n + len(codes) > _SLICE:
            yield some
            some, n = [], 0
        some.append(codes)
        n += len(codes)
    if some:
        yield some


def passage_spans(n: int, window: int) -> list[tuple[int, int]]:
    """Overlapping windows at half a window's stride that cover n words; the last ends at n."""
    if n <= window:
        return [(0, n)] if n else []
    step = window // 2
    return [(a, min(a + window, n)) for a in range(0, n - window + step, step)]


def weighted_lcs(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Largest weight of a common subsequence; ``weight`` goes with ``a``."""
    best = np.zeros(len(b) + 1)
    for code, w in zip(a, weight):
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(b == code, best[:-1] + w, 0.0)))
    return float(best[-1])


def latent_rank(codes: int, passages: int, rank: int, most: int = 1 << 26) -> int:
    """The rank that keeps the vectors of codes and passages within ``most`` bytes, 8 at least."""
    return max(8, min(rank, most // (8 * max(1, codes + passages))))


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, seed: int = 7, power: int = 2, block: int = 256) -> np.ndarray:
    """Right singular vectors (codes x rank) of the normalised binary TF-IDF rows of ``passages(codes)``, distinct codes as signed longs.

    Halko, Martinsson and Tropp's range finder with ``power`` rounds: each computes A'(A Q) over the passages' partitions,
    summed block by block of codes on Spark. The driver holds one matrix of codes x rank.
    """
    spark, size = passages.sparkSession, len(idf)
    rank = max(1, min(rank, size))
    q = np.random.default_rng(seed).standard_normal((size, rank))
    for _ in range(power + 1):
        shared = spark.sparkContext.broadcast(q)

        def multiply(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}  # by block of codes
            for batch in batches:
                for data in batch["codes"]:
                    which = np.frombuffer(data, np.int64)
                    values = idf[which] / max(np.linalg.norm(idf[which]), 1e-12)
                    gain = np.outer(values, values @ shared.value[which])
                    for part in np.unique(which // block).tolist():
                        mine = which // block == part
                        if part not in sums:
                            sums[part] = np.zeros((block, rank))
                        sums[part][which[mine] - part * block] += gain[mine]
            yield pd.DataFrame({"part": list(sums), "sums": [s.tobytes() for s in sums.values()]})

        def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [int(key[0])], "sums": [sum(np.frombuffer(b) for b in frame["sums"]).tobytes()]})

        got = passages.select("codes").mapInPandas(multiply, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary")
        b = np.zeros((size + block, rank))
        for row in got.toLocalIterator():
            b[row["part"] * block : (row["part"] + 1) * block] = np.frombuffer(row["sums"]).reshape(-1, rank)
        q = np.linalg.qr(b[:size])[0]
        shared.unpersist()
    return q


def answer_start(text: str) -> int:
    """Word index where the last sentence begins, words that are marks alone not counted."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    return sum(1 for s in sentences[:-1] for w in s.split() if plain(w))


class Index:
    """The passages of a benchmark: rare words, latent vectors, and what verification needs."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], idf: np.ndarray, window: int, least: float):
        self.items, self.idf, self.window, self.least = items, idf, window, least
        #: (item, start, stop) of each passage.
        self.spans = [(i, a, b) for i, (_, codes, _) in enumerate(items) for a, b in passage_spans(len(codes), window)]
        self.sets = [np.unique(items[i][1][a:b]) for i, a, b in self.spans]
        self.square = (idf.astype(np.float64) ** 2).astype(np.float32)
        self.square[0] = 0
        self.norms = np.array([np.sqrt(self.square[s].sum(dtype=np.float64)) for s in self.sets])
        #: Distinct codes of each passage, padded by -1, and their shares of its squared norm.
        self.members = np.full((len(self.sets), window), -1, np.int64)
        self.shares = np.zeros((len(self.sets), window), np.float32)
        posted, self.rest = [], np.zeros(len(self.sets), np.float32)
        for k, s in enumerate(self.sets):
            share = self.square[s] / self.square[s].sum(dtype=np.float64)
            order = np.argsort(-share, kind="stable")
            s, share = s[order], share[order]
            self.members[k, : len(s)], self.shares[k, : len(s)] = s, share
            left = 1 - np.cumsum(share)
            rare = int(np.argmax(left < least / 2)) + 1
            self.rest[k] = max(0.0, left[rare - 1])
            posted.append(np.stack([s[:rare], np.full(rare, k), share[:rare]]))
        found = np.concatenate(posted, axis=1) if posted else np.zeros((3, 0))
        found = found[:, np.argsort(found[0], kind="stable")]
        self.first = np.searchsorted(found[0], np.arange(len(idf) + 1))
        self.passage, self.gain = found[1].astype(np.int64), found[2].astype(np.float32)
        self.rare = np.diff(self.first) > 0
        self.latent = self.places_in_space = self.outside = None

    def passages(self) -> list[tuple[bytes]]:
        return [(s.astype(np.int64).tobytes(),) for s in self.sets]

    def project(self, vectors: np.ndarray) -> None:
        """Take the latent space: weighted vectors of the codes, latent vectors of the passages, and the passages' norms outside of it."""
        self.latent = (vectors * self.idf[:, None]).astype(np.float32)
        self.latent[0] = 0
        self.places_in_space = np.stack([self.latent[s].sum(axis=0) / n for s, n in zip(self.sets, self.norms)])
        self.outside = np.sqrt(np.maximum(1 - (self.places_in_space.astype(np.float64) ** 2).sum(axis=1), 0)) + 1e-3

    def candidates(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(row, start word, passage, share of its squared norm) of all windows that hold ``least`` of a passage, in order."""
        step, n = self.window // 2, len(self.spans)
        length = np.array([len(d) for d in docs], np.int64)
        begin, halves = np.cumsum(length) - length, -(-length // step)
        half0 = np.cumsum(halves) - halves
        every = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        at = np.flatnonzero(self.rare[every])
        if not len(at):
            return []
        code, doc = every[at].astype(np.int64), np.searchsorted(begin, at, side="right") - 1
        half = (at - begin[doc]) // step
        count = self.first[code + 1] - self.first[code]
        take = np.repeat(np.arange(len(at)), count)
        post = np.arange(len(take)) - np.repeat(np.cumsum(count) - count, count) + self.first[code][take]
        key = (half0[doc] + half)[take] * n + self.passage[post]
        inner = half[take] > 0  # such an occurrence also counts for the window that begins one half earlier
        key, gain = np.append(key, key[inner] - n), np.append(self.gain[post], self.gain[post][inner])
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        key, gain = key[cut], np.add.reduceat(gain[order], cut)
        key = key[gain + self.rest[key % n] >= self.least - 1e-5]
        out = []
        for a in range(0, len(key), 16_384):
            out += self._settle(every, key[a : a + 16_384] // n, key[a : a + 16_384] % n, begin, length, half0)
        return out

    def _settle(self, every, half, passage, begin, length, half0) -> list[tuple[int, int, int, float]]:
        windows, which = np.unique(half, return_inverse=True)
        # empty documents have no half, and share their first half's number with the next document
        doc = np.searchsorted(half0, windows, side="right") - 1
        start = (windows - half0[doc]) * (self.window // 2)
        words = start[:, None] + np.arange(self.window)
        codes = np.where(words < length[doc][:, None], every[np.minimum(begin[doc][:, None] + words, len(every) - 1)], 0).astype(np.int64)
        codes.sort(axis=1)
        codes[:, 1:][codes[:, 1:] == codes[:, :-1]] = 0
        latent = np.zeros((len(windows), self.latent.shape[1]), np.float32)
        for j in range(self.window):
            latent += self.latent[codes[:, j]]
        outside = np.sqrt(np.maximum(self.square[codes].sum(axis=1) - (latent**2).sum(axis=1), 0))
        reach = np.einsum("ij,ij->i", latent[which], self.places_in_space[passage]) + (outside[which] + 1e-3) * self.outside[passage]
        may = reach >= self.least * self.norms[passage] * (1 - 1e-3)
        which, passage = which[may], passage[may]
        held = np.zeros(self.members[passage].shape, bool)
        for j in range(self.window):
            held |= self.members[passage] == codes[which, j][:, None]
        share = np.where(held, self.shares[passage], 0).sum(axis=1)
        good = np.flatnonzero(share >= self.least)
        return list(zip(doc[which[good]].tolist(), start[which[good]].tolist(), passage[good].tolist(), np.minimum(share[good], 1).tolist()))

    def places(self, i: int, hits: list[tuple[float, int, int]]) -> list[tuple[float, int, int, list[int]]]:
        """``hits`` (cosine, start, passage) of one item, by window start, as places no longer than the item or a window: best cosine, first and last start, passages; the best first."""
        reach = max(len(self.items[i][1]), self.window)
        out: list[tuple[float, int, int, set[int]]] = []
        for cosine, at, k in hits:
            if out and at < out[-1][1] + reach:
                best, first, _, passages = out[-1]
                out[-1] = (max(best, cosine), first, at, passages | {k})
            else:
                out.append((cosine, at, at, {k}))
        return sorted(((c, a, b, sorted(ks)) for c, a, b, ks in out), key=lambda x: -x[0])

    def verify(self, codes: np.ndarray, i: int, first: int, last: int, passages: list[int], enough: float) -> tuple[float, float, bool]:
        """Share of the item, and the largest share of one of the passages, that the common subsequence with the text around the windows covers; answer present.

        Where even the words in any order stay under ``enough``, their shares are given instead.
        """
        _, item, answer = self.items[i]
        near = codes[max(0, first - len(item)) : last + self.window + len(item)]
        near = near[near > 0]
        weight, present = self.idf[item].astype(np.float64), np.isin(item, near)
        spans = [(0, len(item)), *(self.spans[k][1:] for k in passages)]
        total = [max(weight[a:b].sum(), 1e-12) for a, b in spans]
        shares = [float((weight[a:b] * present[a:b]).sum() / t) for (a, b), t in zip(spans, total)]
        if max(shares) >= enough:
            shares = [weighted_lcs(item[a:b], near, weight[a:b]) / t for (a, b), t in zip(spans, total)]
        return shares[0], max(shares[1:]), bool(present[answer:].all())


LEAKS = "doc_id long, item_id long, cosine double, common double, answer boolean"


def _parts(items: Iterator[tuple[int | None, str]], max_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    some, n = [], 0
    for item in items:
        if some and n + len(item[1]) > max_bytes:
            yield some
            some, n = [], 0
        some.append(item)
        n += len(item[1])
    if some:
        yield some


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 24, rank: int = 256, least: float = 0.35,
          likely: float = 0.55, sure: float = 0.75, max_bytes: int = 1 << 25) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``doc_id, item_id, cosine, common, answer``, one row a leaked item of a document.

    Documents without a leak give no row. Null or empty texts and items leak nothing; repeated rows give one result, rows without
    a doc_id one with a null doc_id. ``max_bytes`` of benchmark text make one broadcast index and one pass over the documents.
    """
    spark = docs.sparkSession
    items = materialize(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct(), "items")
    rows = ((r.item_id, r.text) for r in items.orderBy("item_id", "text").toLocalIterator())
    found = spark.createDataFrame([], LEAKS)
    for part in _parts(rows, max_bytes):
        found = found.unionByName(_search(docs, part, window, rank, least, likely, sure))
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.max("answer").alias("answer"))


def _search(docs: DataFrame, items: list[tuple[int | None, str]], window: int, rank: int, least: float, likely: float, sure: float) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary([t for _, t in items])
    codes = materialize(coded(docs, vocabulary), "codes")
    df, n_docs = document_frequencies(codes, vocabulary), max(1, int(codes.count()))
    idf = np.log((1 + n_docs) / (1 + df)) + 0.1
    found = Index([(i, vocabulary.item(t), answer_start(t)) for i, t in items], idf, window, least)
    if not found.spans:
        return spark.createDataFrame([], LEAKS)
    found.project(randomised_svd(spark.createDataFrame(found.passages(), "codes binary"), idf, latent_rank(len(idf), len(found.spans), rank)))
    index, dtype = spark.sparkContext.broadcast(found), vocabulary.dtype

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        this = index.value
        for batch in batches:
            out, done, ids = [], 0, batch["doc_id"].tolist()
            for some in _slices(batch["codes"], dtype):
                hits: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
                for row, start, k, share in this.candidates(some):
                    hits.setdefault((row, this.spans[k][0]), []).append((share**0.5, start, k))
                for (row, i), mine in hits.items():
                    for cosine, first, last, ks in this.places(i, mine):
                        whole, part, answer = this.verify(some[row], i, first, last, ks, min(sure, likely))
                        if max(whole, part) >= sure or (whole >= likely and answer):
                            out.append((ids[done + row], this.items[i][0], cosine, max(whole, part), answer))
                            break
                done += len(some)
            frame = pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "common", "answer"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"), item_id=frame["item_id"].astype("Int64"))

    return codes.mapInPandas(search, LEAKS)
