"""Exact top-k inner products by block-at-a-time pruning.

Vectors are ordered by their dominant terms (a term is a component with its sign) and cut into shards of document-range blocks.
A block keeps its forward index (the vectors) and the maxima of all terms; the sum of a query's weights times the term
maxima bounds every score in the block. For each query, blocks are taken by descending bound and scored until the bound falls
below the k-th best score. That score starts from the query's home shard, so the other shards open few blocks.

Shards have a fixed size; queries travel in blocks. The term maxima of whole shards go to the queries first, and a query travels only
to the shards whose bound reaches its k-th score. There queries and shards are dealt out by key and meet in groups of bounded size: how much
the routing makes is not seen from its input's size, so a join of the two would be planned as a broadcast through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tilespark.functions.storage import materialize

_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component, as doubles that hold whole numbers; vectors that are null or hold null or
    non-finite components (or such that scale * x is none) go."""
    x = F.col("embedding")
    times = lambda c: c.cast("double") * scale
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(times(c)) & (F.abs(times(c)) < float("inf")))
    whole = lambda c: F.when(F.abs(times(c)) < float(_EXACT), F.floor(times(c)).cast("double")).otherwise(times(c))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """Doubles that are whole numbers, in the smallest type that holds them, and its name."""
    kind = next((t for t in ("int16", "int32") if np.abs(x).max(initial=0) <= np.iinfo(t).max), "float64")
    return kind, x.astype(kind).tobytes()


def _unpacked(kinds, parts, width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind).astype(np.float64) for kind, x in zip(kinds, parts)]).reshape(-1, width)


def _whole(x: np.ndarray) -> np.ndarray:
    """Python integers of any size."""
    return np.array([int(c) for c in x.ravel().tolist()], object).reshape(x.shape)


class Shard:
    """Blocks of one shard: forward index and term maxima."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, d: np.ndarray, block: int):
        self.ids, self.rows, self.d, self.block = ids, rows, d, block
        cuts = range(0, len(d), block)
        self.top = np.stack([d[a : a + block].max(axis=0) for a in cuts])
        self.low = np.stack([d[a : a + block].min(axis=0) for a in cuts])
        self.most = float(np.abs(d).max(initial=0))
        self.opened = 0

    def search(self, query_rows: np.ndarray, q: np.ndarray, k: int, known: np.ndarray) -> list[tuple[int, int, int]]:
        """(place of the query, id, score) of up to k best each, of those that reach the ``known`` k-th score; never the query's own row.

        Sums are exact: doubles where none can leave 2^53, Python integers else, cut to the range of a long.
        """
        small = float(np.abs(q).max(initial=0)) * self.most * max(1, q.shape[1]) < _EXACT
        exact = (lambda x: x) if small else _whole
        q, d, kth = exact(q), exact(self.d), known.astype(np.float64 if small else object)
        bounds = np.maximum(q, 0) @ exact(self.top).T + np.minimum(q, 0) @ exact(self.low).T
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = [[] for _ in q]
        alive = np.arange(len(q))
        for turn in range(order.shape[1]):  # each query's turn-th best block, queries of one block together
            alive = alive[(bounds[alive, order[alive, turn]] >= kth[alive]).astype(bool)]
            if not len(alive):
                break
            at = order[alive, turn]
            for b in np.unique(at):
                who = alive[at == b]
                self.opened += len(who)
                a = b * self.block
                ids, rows = self.ids[a : a + self.block], self.rows[a : a + self.block]
                s = q[who] @ d[a : a + self.block].T
                s = s if small else np.clip(s, -_LONG, _LONG)
                fits = (s >= kth[who, None]).astype(bool) & (rows != query_rows[who, None])
                for row in np.flatnonzero(fits.any(axis=1)):
                    i, good = who[row], np.flatnonzero(fits[row])
                    best[i] = sorted(best[i] + [(-int(x), y) for x, y in zip(s[row][good].tolist(), ids[good].tolist())])[:k]
                    if len(best[i]) == k:
                        kth[i] = max(kth[i], -best[i][-1][0])
        return [(i, d, -s) for i, found in enumerate(best) for s, d in found]


def _under(value: int) -> float:
    """The largest double that is not above a whole number."""
    near = float(value)
    return near if near <= value else math.nextafter(near, -math.inf)


def search(vectors: DataFrame, k: int = 5, every: int = 50, shard_size: int = 8192, block: int = 128, query_block: int = 4096, max_shared: int = 1 << 26,
           max_meeting: int = 1 << 26) -> DataFrame:
    """Queries: rows whose ``vec_id`` is divisible by ``every``; candidates: every row but the query's own.

    ``vectors(vec_id, embedding)`` -> ``query_id, rank, vec_id, score``: the k highest integer inner products (all, if fewer), ties to the
    smaller vec_id. Components that one vector lacks count as zero. Every row stands for itself: rows that repeat a vec_id, with the same vector
    or another, are candidates of each other, and each of them that is a query has a list of its own. Scores beyond the range of a long
    count as its ends. Rows without a vec_id take no part. About ``max_meeting`` bytes of queries meet a shard in one group.
    """
    base = materialize(quantised(vectors.select("vec_id", "embedding")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    stats = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    n, width = stats["n"], max(1, stats["width"] or 1)
    shards, parts = max(1, math.ceil(n / shard_size)), max(1, math.ceil(stats["queries"] * width * 8 / max_meeting))
    strongest = F.array_max(F.transform("v", lambda c, i: F.struct(F.abs(c).alias("a"), (i * 2 + F.when(c < 0, 1).otherwise(0)).alias("term"))))
    ordered = base.withColumn("term", F.coalesce(strongest["term"], F.lit(-1)))
    ordered = ordered.repartitionByRange(shards, "term", F.xxhash64("row")).sortWithinPartitions("term", "vec_id")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cut a partition's stream into shards of at most ``shard_size`` vectors."""
        ids, own, rows, made = [], [], [], 0

        def out() -> pd.DataFrame:
            d = _matrix(rows, width)
            part, (kind, packed) = TaskContext.get().partitionId(), _packed(d)
            return pd.DataFrame({"shard": [(part << 32) + made], "ids": [np.array(ids, np.int64).tobytes()], "rows": [np.array(own, np.int64).tobytes()], "kind": [kind], "d": [packed],
                                 "top": [d.max(axis=0).tobytes()], "low": [d.min(axis=0).tobytes()]})

        for batch in batches:
            for i, row, v in zip(batch["vec_id"], batch["row"], batch["v"]):
                ids.append(int(i))
                own.append(int(row))
                rows.append(v)
                if len(ids) == shard_size:
                    yield out()
                    ids, own, rows, made = [], [], [], made + 1
        if ids:
            yield out()

    stored = materialize(ordered.select("vec_id", "row", "v").mapInPandas(index, "shard long, ids binary, rows binary, kind string, d binary, top binary, low binary"), "shards")

    def load(ids: bytes, rows: bytes, kind: str, d: bytes) -> Shard:
        return Shard(np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), _unpacked([kind], [d], width), block)

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, *held in zip(batch["shard"], batch["ids"], batch["rows"], batch["kind"], batch["d"]):
                shard = load(*held)
                for a in range(0, len(shard.ids), query_block):
                    own = a + np.flatnonzero(shard.ids[a : a + query_block] % every == 0)
                    if not len(own):
                        continue
                    q, qid, qrow = shard.d[own], shard.ids[own], shard.rows[own]
                    found = shard.search(qrow, q, k, np.full(len(own), -np.inf))
                    scores: list[list[int]] = [[] for _ in own]
                    for i, _, s in found:
                        scores[i].append(s)
                    known = np.array([_under(min(s)) if len(s) == k else -np.inf for s in scores])
                    yield pd.DataFrame({
                        "home": [key], "q_ids": [np.stack([qid, qrow], 1).tobytes()], "q": [q.tobytes()], "known": [known.tobytes()],
                        "found": [[{"query_row": int(qrow[i]), "query_id": int(qid[i]), "vec_id": v, "score": s} for i, v, s in found]]})

    hit = "struct<query_row:long,query_id:long,vec_id:long,score:long>"
    homes = materialize(stored.mapInPandas(at_home, f"home long, q_ids binary, q binary, known binary, found array<{hit}>"), "queries")

    def away(queries: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        """A shard, and the queries of one part that were sent to it."""
        names = ["query_row", "query_id", "vec_id", "score"]
        out = [pd.DataFrame(columns=names, dtype="int64")]
        if len(queries):
            shard = load(*home[["ids", "rows", "kind", "d"]].iloc[0])
            qid, qrow = np.frombuffer(b"".join(queries["q_ids"]), np.int64).reshape(-1, 2).T
            q, known = _unpacked(queries["kind"], queries["q"], width), np.frombuffer(b"".join(queries["known"]))
            by_size = np.argsort(np.abs(q).max(axis=1), kind="stable")  # those that need integers of any size come together
            for a in range(0, len(q), query_block):
                own = by_size[a : a + query_block]
                found = shard.search(qrow[own], q[own], k, known[own])
                out.append(pd.DataFrame([(int(qrow[own[i]]), int(qid[own[i]]), v, s) for i, v, s in found], columns=names, dtype="int64"))
        return pd.concat(out)

    key = ["shard", "part"]
    sent = _routed(homes, stored, width, max_shared).withColumn("part", F.pmod(F.xxhash64("q_ids"), F.lit(parts)))
    copies = stored.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("part"), "ids", "rows", "kind", "d")
    met = sent.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(away, "query_row long, query_id long, vec_id long, score long")
    local = homes.select(F.explode("found").alias("f")).select("f.*")
    found = local.unionByName(met)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _routed(homes: DataFrame, stored: DataFrame, width: int, max_shared: int) -> DataFrame:
    """``shard, q_ids`` (vec_id and row), ``kind, q, known``: of each block of queries those whose bound over a shard reaches their k-th score, for every shard but their home.

    The shards' term maxima are broadcast, ``max_shared`` bytes at a time.
    """
    spark, out, some = homes.sparkSession, None, []

    def route(maxima: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r["shard"] for r in maxima], np.int64), *(
            np.stack([np.frombuffer(r[c]) for r in maxima]) for c in ("top", "low"))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shards, top, low = shared.value
            reach = np.maximum(np.abs(top), np.abs(low))
            for batch in batches:
                for home, q_ids, q, known in zip(batch["home"], batch["q_ids"], batch["q"], batch["known"]):
                    qid, q, known = np.frombuffer(q_ids, np.int64).reshape(-1, 2), np.frombuffer(q).reshape(-1, width), np.frombuffer(known)
                    for at in range(0, len(shards), 1024):
                        part = slice(at, at + 1024)
                        # sums of doubles may be off by a little: bounds are raised by more than that
                        with np.errstate(over="ignore", invalid="ignore"):
                            bound = np.maximum(q, 0) @ top[part].T + np.minimum(q, 0) @ low[part].T + np.abs(q) @ reach[part].T * 1e-12
                        bound[np.isnan(bound)] = np.inf
                        meets = (bound >= known[:, None]) & (shards[part] != home)
                        rows = [(int(shards[at + j]), qid[w].tobytes(), *_packed(q[w]), known[w].tobytes())
                                for j in np.flatnonzero(meets.any(axis=0)) for w in [np.flatnonzero(meets[:, j])]]
                        yield pd.DataFrame(rows, columns=["shard", "q_ids", "kind", "q", "known"])

        return homes.select("home", "q_ids", "q", "known").mapInPandas(run, "shard long, q_ids binary, kind string, q binary, known binary")

    for row in stored.select("shard", "top", "low").toLocalIterator():
        some.append(row)
        if len(some) * width * 16 >= max_shared:
            out, some = route(some) if out is None else out.unionByName(route(some)), []
    if some or out is None:
        last = route(some) if some else spark.createDataFrame([], "shard long, q_ids binary, kind string, q binary, known binary")
        out = last if out is None else out.unionByName(last)
    return out
