"""Ranked lexical search by a two-level quantised index.

The index holds, for blocks of documents, the postings of the terms that the items ask for. Its first level is one byte a posting: the exact
impact divided by a unit that all terms share, rounded upward. Sums of bytes bound a document's score from above and, less one for
each posting, from below. The 50th highest lower bound of an item is its threshold, and every document whose upper bound reaches it is
scored anew from the second level, the term frequencies and lengths, in integers. Bounds of a block are products of two small matrices,
so a block meets all items at once; documents that no item's term occurs in are in no block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tilespark.functions.storage import materialize

#: Bytes of terms (digits, letters and all that is not ASCII), A-Z in lower case; every other byte parts terms.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_INDEX = "docs array<long>, lengths binary, counts binary, terms binary, tf binary, n_docs long, total long, df array<struct<term:int,n:long>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split(b" ")


def _weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The integer that a posting adds to a score."""
    m = 50 + (50 * lengths * n_docs) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def item_terms(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` -> ``item_id, term``, once each; rows that repeat an item_id are one item with the terms of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for w in set(words(t)) if w]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], ["item_id", "term"])

    slim = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(run, "item_id long, term binary").distinct()


def _indexer(numbers, block: int):
    """Blocks of up to ``block`` documents with their postings (lengths and posting counts by document, terms and frequencies by posting).

    The last row of a task holds no documents but the numbers of documents with terms, of all terms, and of documents by asked term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n_docs, total = numbers.value, [], 0, 0
        df = np.zeros(len(number), np.int64)
        schema = pa.schema([("docs", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("lengths", "counts", "terms", "tf")), ("n_docs", pa.int64()), ("total", pa.int64()),
                            ("df", pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())])))])

        def out() -> pa.RecordBatch:
            ids, lengths, terms, tf = zip(*held)
            packed = [np.array(lengths, "<i8"), np.array([len(t) for t in terms], "<i4"), np.concatenate(terms).astype("<i4"), np.concatenate(tf).astype("<i4")]
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(("docs", "lengths", "counts", "terms", "tf"), [list(ids), *(x.tobytes() for x in packed)]))], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py() or b"")
                length = len(found) - found.count(b"")
                if not length:
                    continue
                n_docs, total = n_docs + 1, total + length
                own = [number[w] for w in found if w in number]
                if own:
                    terms, tf = np.unique(np.array(own, np.int64), return_counts=True)
                    df[terms] += 1
                    held.append((doc_id, length, terms, tf))
                    if len(held) == block:
                        yield out()
        if held:
            yield out()
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pylist([{"n_docs": n_docs, "total": total, "df": [{"term": t, "n": n} for t, n in zip(seen.tolist(), df[seen].tolist())]}], schema)

    return run


class _Items:
    """The terms of a part's items, laid out for blocks: groups of items with their own terms."""

    def __init__(self, ids: list, links: list[tuple[int, int]], width: int = 256):
        self.ids = ids
        pairs = np.array(sorted(links), np.int64).reshape(-1, 2)
        self.own = [pairs[a:b, 1] for a, b in zip(*(np.searchsorted(pairs[:, 0], np.arange(len(ids)), side) for side in ("left", "right")))]
        self.groups = [range(a, min(a + width, len(ids))) for a in range(0, len(ids), width)]
        # sums of bytes stay whole numbers in single precision up to 2^24
        self.dtype = np.float32 if max(map(len, self.own), default=0) < 60_000 else np.float64

    def blocks(self, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int):
        """For each group of items: the group, and the sums of ``values`` over each item's terms, documents by items."""
        for group in self.groups:
            asked = np.unique(np.concatenate([self.own[i] for i in group])) if len(group) else np.zeros(0, np.int64)
            present = np.intersect1d(asked, terms)
            hit = np.isin(terms, present)
            x = np.zeros((n, len(present)), self.dtype)
            x[docs[hit], np.searchsorted(present, terms[hit])] = values[hit]
            w = np.zeros((len(present), len(group)), self.dtype)
            for k, i in enumerate(group):
                w[np.searchsorted(present, np.intersect1d(self.own[i], present)), k] = 1
            yield group, x @ w


def _postings(counts: bytes, terms: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    n = np.frombuffer(counts, "<i4")
    return np.repeat(np.arange(len(n)), n), np.frombuffer(terms, "<i4").astype(np.int64), len(n)


def _best(scores: np.ndarray, known: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by ascending id, unknown ids first."""
    return np.lexsort((ids, known, -scores))[:k]


def _part(docs: DataFrame, links: list[tuple], k: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, t in links})
    number = {t: i for i, t in enumerate(vocabulary)}
    ids = sorted({i for i, _ in links}, key=lambda i: (i is not None, i or 0))
    place = {i: at for at, i in enumerate(ids)}
    items = spark.sparkContext.broadcast(_Items(ids, [(place[i], number[t]) for i, t in links]))
    index = materialize(docs.mapInArrow(_indexer(spark.sparkContext.broadcast(number), block), _INDEX), "postings")
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("total").alias("l")).first()
    n_docs, total = size["n"] or 0, size["l"] or 0
    df = index.select(F.explode("df").alias("d")).groupBy("d.term").agg(F.sum("d.n").alias("n")).collect()  # a row for each of the part's terms at most
    weights = np.zeros(len(vocabulary), np.int64)
    for term, n in df:
        weights[term] = _weight(n_docs, n)
    unit = max(1, -(-int(weights.max(initial=0)) * 1_000_000 // 255))  # no posting adds more than a million times its weight
    shared = spark.sparkContext.broadcast(weights)

    def exact(lengths: bytes, docs_of: np.ndarray, terms: np.ndarray, tf: bytes) -> np.ndarray:
        return impacts(shared.value[terms], np.frombuffer(tf, "<i4").astype(np.int64), np.frombuffer(lengths, "<i8")[docs_of], n_docs, total)

    def quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            levels = []
            for lengths, counts, terms, tf in zip(batch["lengths"], batch["counts"], batch["terms"], batch["tf"]):
                d, t, _ = _postings(counts, terms)
                levels.append((-(-exact(lengths, d, t, tf) // unit)).astype(np.uint8).tobytes())
            yield batch.assign(levels=levels)

    kept = "docs array<long>, lengths binary, counts binary, terms binary, tf binary"
    full = materialize(index.where("docs is not null").select("docs", "lengths", "counts", "terms", "tf").mapInPandas(quantise, kept + ", levels binary"), "index")

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = items.value
        top = np.zeros((k, len(of.ids)), np.int64)
        for batch in batches:
            for counts, terms, levels in zip(batch["counts"], batch["terms"], batch["levels"]):
                d, t, n = _postings(counts, terms)
                under = np.maximum(np.frombuffer(levels, np.uint8).astype(np.int64) - 1, 0)
                for group, sums in of.blocks(d, t, under, n):
                    both = np.concatenate([top[:, group.start : group.stop], sums.astype(np.int64)])
                    top[:, group.start : group.stop] = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
        r, c = np.nonzero(top)
        yield pd.DataFrame({"item": c, "low": top[r, c]})

    order = Window.partitionBy("item").orderBy(F.desc("low"))
    lows = full.select("counts", "terms", "levels").mapInPandas(lowest, "item long, low long").withColumn("n", F.row_number().over(order)).where(F.col("n") == k)
    bar = np.zeros(len(ids), np.int64)
    for row in lows.select("item", "low").collect():  # a row for each of the part's items at most
        bar[row["item"]] = row["low"]
    bars = spark.sparkContext.broadcast(bar)

    def rescore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, bar, found = items.value, bars.value, {}
        for batch in batches:
            for doc_ids, lengths, counts, terms, tf, levels in zip(*(batch[c] for c in ("docs", "lengths", "counts", "terms", "tf", "levels"))):
                d, t, n = _postings(counts, terms)
                doc_ids = np.array(doc_ids, object)
                values, starts = exact(lengths, d, t, tf), np.searchsorted(d, np.arange(n + 1))
                for group, sums in of.blocks(d, t, np.frombuffer(levels, np.uint8).astype(np.int64), n):
                    reach = (sums >= np.maximum(bar[group.start : group.stop], 1))
                    for j in np.flatnonzero(reach.any(axis=0)):
                        item, who = group[int(j)], np.flatnonzero(reach[:, j])
                        mine = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in who])
                        worth = np.where(np.isin(t[mine], of.own[item]), values[mine], 0)
                        score = np.zeros(len(who), np.int64)
                        np.add.at(score, np.searchsorted(who, d[mine]), worth)
                        good = score > 0
                        known = np.array([i is not None and i == i for i in doc_ids[who[good]]], bool)
                        own = np.array([int(i) if ok else 0 for i, ok in zip(doc_ids[who[good]], known)], np.int64)
                        had = found.get(item)
                        new = (score[good], known, own)
                        new = new if had is None else tuple(np.concatenate(x) for x in zip(had, new))
                        keep = _best(*new, k)
                        found[item] = tuple(x[keep] for x in new)
        for item, (score, known, own) in found.items():
            yield pd.DataFrame({"item_id": pd.array([of.ids[item]] * len(score), "Int64"), "doc_id": pd.array([int(i) if ok else None for i, ok in zip(own, known)], "Int64"), "score": score})

    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    scored = full.mapInPandas(rescore, "item_id long, doc_id long, score long")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block: int = 1024, max_links: int = 1 << 20) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> each item's k best documents: ``item_id, rank, doc_id, score`` (all with a score above 0, if fewer).

    Equal scores stand by ascending doc_id, unknown ones first. Null and empty texts have no terms; documents without terms don't
    count, rows that repeat a doc_id are documents of their own, rows that repeat an item_id are one item with the terms of all. Items
    without terms, or without any document, give no rows. Items are taken in parts of about ``max_links`` terms, which are
    what reaches the driver and is broadcast.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    asked = materialize(item_terms(items), "item_terms")
    parts, out = max(1, -(-asked.count() // max_links)), None
    for p in range(parts):
        links = [(r["item_id"], bytes(r["term"])) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).toLocalIterator()]
        if links:
            found = _part(slim, links, k, block)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
