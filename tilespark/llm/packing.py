"""Best-fit packing of token pieces into sequences, certified by dual-feasible-function bounds.

Documents are tokenised once and cut into pieces of at most ``capacity`` tokens. Pieces are dealt by hash into
partitions of bounded size; best-fit decreasing packs each, and the largest of two families of dual-feasible functions
bounds its bin count from below. A partition that meets its bound is optimal and closed. The loose (not full) bins of
partitions with a gap are pooled, a bounded number of partitions at a time, and packed again; a pool's new packing is
taken only where it has fewer bins than its old one, so a round never makes things worse.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tilespark.functions.storage import materialize
from tilespark.llm.tokens import word_encoder

PIECE_SCHEMA = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, memo: int = 600_000) -> DataFrame:
    """``docs(doc_id, text)`` -> one row a piece: ``row_id, doc_id, piece, start, length, ids_crc32``.

    A null text counts as empty and gives one piece that holds ``end_id`` alone. Repeated rows stay apart; other
    columns are not read. ``memo`` words are kept by a Python worker. ``row_id`` tells rows apart and is stable only in a written table.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = word_encoder(tokenizer, memo).encode, np.array([end_id], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = memoryview((encode(text) if isinstance(text, str) else b"") + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((row, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    row += 1
            frame = pd.DataFrame(out, columns=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``lengths`` needs at least.

    Threshold functions f_a (over capacity-a: whole; under a: nothing; else itself) for every a up to half the
    capacity, and the rounding functions u_k (x to floor((k+1)x/C)/k, exact multiples kept) for k up to 40.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    count, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    a = np.arange(0, capacity // 2 + 1)
    whole = (count[-1] - count[capacity - a + 1]) * capacity
    middle = mass[capacity - a + 1] - mass[a]
    best = int(np.max(-(-(whole + middle) // capacity)))
    for k in range(1, 41):
        scaled = (k + 1) * size
        weight = np.where(scaled % capacity == 0, k * size, capacity * (scaled // capacity))
        best = max(best, math.ceil(int((n * weight).sum()) / (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Ties go to the earlier item and the latest opened bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0  # bit c of mask: some bin has c tokens free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            at, room, opened = opened, capacity, opened + 1
        bins[i], offsets[i] = at, capacity - room
        left = room - size
        if left:
            free[left].append(at)
            mask |= 1 << left
    return bins, offsets, opened


PACKED = PIECE_SCHEMA + ", sequence_id long, offset long, part long, loose boolean"
COLUMNS = [c.split()[0] for c in PACKED.split(", ")]
_BIN_BITS, _ROUND_BITS = 24, 58


def _repack(turn: int, capacity: int):
    """Pack one pool's loose bins again; the old bins stay unless the new ones are fewer."""

    def again(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_id", ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        before = frame["sequence_id"].nunique()
        frame["part"] = int(key[0])
        if n < before:
            frame = frame.assign(sequence_id=(turn << _ROUND_BITS) + (int(key[0]) << _BIN_BITS) + bins, offset=offsets)
        frame["loose"] = min(n, before) > lower_bound(lengths, capacity)
        return frame[COLUMNS]

    return again


def pack(pieces: DataFrame, capacity: int = 2048, items_per_part: int = 60_000, rounds: int = 3, pool: int = 4) -> DataFrame:
    """Pack a written table of pieces: adds ``sequence_id`` and ``offset``, gapless from 0 in every sequence.

    ``items_per_part`` bounds what one task holds; ``pool`` partitions with a gap share their loose bins in each of at
    most ``rounds`` exchanges. An empty table gives an empty result.
    """
    parts = max(1, math.ceil(pieces.count() / items_per_part))

    def first(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_id", ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, weights=lengths, minlength=n)
        gap = n > lower_bound(lengths, capacity)
        return frame.assign(sequence_id=(int(key[0]) << _BIN_BITS) + bins, offset=offsets, loose=(filled[bins] < capacity) & gap)

    placed = materialize(
        pieces.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(parts)))
        .groupBy("part").applyInPandas(lambda key, f: first(key, f)[COLUMNS], PACKED), "packed")
    for turn in range(1, rounds + 1):
        loose = placed.where("loose")
        gaps = loose.select("part").distinct().count()
        if not gaps or (turn > 1 and gaps == 1):
            break
        pools = math.ceil(gaps / pool)

        mixed = loose.withColumn("pool", F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(pools)))
        placed = materialize(placed.where("not loose").unionByName(mixed.groupBy("pool").applyInPandas(_repack(turn, capacity), PACKED)), "packed")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, memo: int = 600_000) -> DataFrame:
    """Tokenise, cut and pack ``docs``; see ``token_pieces`` and ``pack``."""
    return pack(materialize(token_pieces(docs, tokenizer, capacity, memo=memo), "pieces"), capacity)
