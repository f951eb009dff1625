"""Training-order materialisation: token ids in fixed-stride shards, in a keyed pseudo-random global order.

Each task joins its documents' ids (an end id after each) into one stream and cuts it into sequences of ``stride`` tokens, so
only a task's last sequence is padded. Texts are tokenised once: the streams are stored in compressed blocks of many sequences.
The blocks' counts (one small row a task) turn a task's own numbering into a global index, and a keyed Feistel permutation with
cycle walking maps the index to a slot below the number of sequences, one to one. A second pass reads the blocks and sends each
sequence to its range of slots. ``shard_slots`` slots make one shard file of records of equal size, so slot s is record
s mod shard_slots of shard s div shard_slots: readers go on from any slot. A task writes a run of shards, one after the other.

A shard is written under a name of its own attempt and renamed when complete; its contents follow from the key and the
stored blocks alone, so a repeated task gives the same file.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tilespark.functions.storage import discard, materialize, new_path
from tilespark.llm.batches import portions
from tilespark.llm.tokens import byte_encoder

def _round(half: np.ndarray, key: np.uint64, turn: int) -> np.ndarray:
    """Keyed mixing of a half (the finaliser of a splitmix generator)."""
    z = half + key + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1: balanced Feistel network on the smallest even number of bits, walked until it is below n."""
    if n <= 1:
        return np.zeros_like(index)
    half = np.uint64((max(2, (n - 1).bit_length()) + 1) // 2)
    low = np.uint64((1 << int(half)) - 1)
    secret = np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x >> half, x & low
            for turn in range(rounds):
                if inverse:
                    left, right = right ^ (_round(left, secret, rounds - 1 - turn) & low), left
                else:
                    left, right = right, left ^ (_round(right, secret, turn) & low)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


BLOCKS = "part int, block int, n int, last int, doc_ids array<array<long>>, ids binary"


def token_blocks(docs: DataFrame, ranks: str, pattern: str, stride: int = 1024, per_block: int = 512, chunk: int = 1 << 25) -> DataFrame:
    """``docs(doc_id, text)`` -> the tasks' streams in blocks of ``per_block`` sequences: ``n`` sequences, of which the ``last`` has so many ids.

    Null and empty texts give their end id alone. ``doc_ids`` lists the documents that each sequence touches, in order; rows
    without a doc_id are not named there. Texts are encoded about ``chunk`` bytes at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(ranks, pattern)
        end, size = np.array([encoder.eos], encoder.dtype).tobytes(), stride * encoder.width
        part, made, compress = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=6).compress
        buffer, owners = bytearray(), deque()  # owners: (doc_id, bytes of the stream up to its end)
        gone = filled = 0  # bytes of the stream that have left the buffer, and all so far

        def block(data: bytes) -> pa.RecordBatch:
            nonlocal made, gone
            names = []
            for at in range(gone, gone + len(data), size):
                stop, mine = min(at + size, gone + len(data)), []
                while owners and owners[0][1] <= stop:
                    mine.append(owners.popleft()[0])
                if owners and (not mine or owners[0][2] < stop):
                    mine.append(owners[0][0])
                names.append([d for d in mine if d is not None])
            last = (len(data) - (len(names) - 1) * size) // encoder.width
            row = {"part": part, "block": made, "n": len(names), "last": last, "doc_ids": names, "ids": compress(data)}
            made, gone = made + 1, gone + len(data)
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for ids, texts in portions(batch, chunk):
                for doc_id, data in zip(ids, encoder.encode_all(texts)):
                    start = filled
                    filled += len(data) + len(end)
                    buffer += data
                    buffer += end
                    owners.append((doc_id, filled, start))
                at = 0
                while len(buffer) - at >= per_block * size:
                    yield block(bytes(buffer[at : at + per_block * size]))
                    at += per_block * size
                del buffer[:at]
        if buffer:
            yield block(bytes(buffer))

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("last", pa.int32()), ("doc_ids", pa.list_(pa.list_(pa.int64()))), ("ids", pa.binary())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


SEQUENCES = "slot long, n_tokens int, doc_ids array<long>, ids_crc32 long, ids binary"


def sequence_counts(blocks: DataFrame) -> list[int]:
    """Sequences of each task's stream, in task order; one row a task reaches the driver."""
    found = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    return [found.get(p, 0) for p in range(max(found, default=-1) + 1)]


def token_sequences(blocks: DataFrame, counts: list[int], key: int, stride: int, width: int, per_block: int = 512) -> DataFrame:
    """Stored blocks -> sequences with their global ``slot``; ids compressed for the way to the shards."""
    starts, n = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), int(sum(counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compress, expand = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        size = stride * width
        for batch in batches:
            for part, block, count, last, names, packed in zip(*(batch[c] for c in ("part", "block", "n", "last", "doc_ids", "ids"))):
                data = expand(packed)
                pieces = [data[at : at + size] for at in range(0, len(data), size)]
                yield pd.DataFrame({
                    "slot": feistel(starts[part] + block * per_block + np.arange(count), n, key), "n_tokens": [stride] * (count - 1) + [last],
                    "doc_ids": list(names), "ids_crc32": list(map(zlib.crc32, pieces)), "ids": list(map(compress, pieces))})

    return blocks.mapInPandas(run, SEQUENCES)


INDEX = "slot long, shard int, position int, n_tokens int, doc_ids array<long>, ids_crc32 long"


def write_shards(sequences: DataFrame, n: int, folder: str, stride: int, width: int, shard_slots: int = 8192, max_tasks: int = 20_000) -> DataFrame:
    """Write the shard files of ``n`` sequences and return their index, one row a sequence: ``slot, shard, position, n_tokens, doc_ids, ids_crc32``.

    Up to ``max_tasks`` tasks share the shards out in runs.
    """
    shards = max(1, math.ceil(n / shard_slots))
    run_length = math.ceil(shards / max_tasks)
    owner = F.expr(f"cast(shard div {run_length} as int)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, shard, mine, expand = None, None, None, zstandard.ZstdDecompressor().decompress

        def close() -> None:
            if out is not None:
                out.close()
                store.move(mine, f"{base}/shard-{shard:08d}.bin")

        for batch in batches:
            for k, packed in zip(batch["shard"].tolist(), batch["ids"]):
                if k != shard:
                    close()
                    shard, mine = k, f"{base}/.shard-{k:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(mine)
                out.write(expand(packed).ljust(stride * width, b"\0"))
            yield batch.drop(columns="ids")
        close()

    slotted = sequences.withColumn("shard", F.expr(f"cast(slot div {shard_slots} as int)")).withColumn("position", F.expr(f"cast(slot % {shard_slots} as int)"))
    ranged = slotted.repartitionById(math.ceil(shards / run_length), owner).sortWithinPartitions("slot").select(*(c.split()[0] for c in INDEX.split(", ")), "ids")
    return materialize(ranged.mapInPandas(run, INDEX), "index")


def read_shards(spark: SparkSession, folder: str, index: DataFrame, stride: int, width: int, first_slot: int = 0) -> DataFrame:
    """``slot, ids`` of every sequence from ``first_slot`` on: each shard is read sequentially from its first wanted record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, start, slots, lengths in zip(batch["shard"], batch["start"], batch["slots"], batch["lengths"]):
                with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
                    f.seek(int(start) * stride * width)
                    rows = [np.frombuffer(f.read(stride * width), f"<u{width}")[:n].astype(np.int64) for n in lengths]
                yield pd.DataFrame({"slot": slots, "ids": rows})

    wanted = index.where(F.col("slot") >= first_slot).groupBy("shard").agg(
        F.min("position").alias("start"), F.array_sort(F.collect_list(F.struct("slot", "n_tokens"))).alias("s"))
    return wanted.select("shard", "start", "s.slot", "s.n_tokens").toDF("shard", "start", "slots", "lengths").mapInPandas(run, "slot long, ids array<long>")


def order_documents(docs: DataFrame, ranks: str, pattern: str, key: int = 20_240_229, stride: int = 1024, shard_slots: int = 8192) -> tuple[DataFrame, str]:
    """Tokenise ``docs(doc_id, text)``, permute and write; gives the index and the shards' folder. No documents give an empty index.

    Repeated rows stay; other columns are not read.
    """
    folder = new_path(docs.sparkSession, "shards")
    width = byte_encoder(ranks, pattern).width
    blocks = materialize(token_blocks(docs, ranks, pattern, stride), "blocks")
    counts = sequence_counts(blocks)
    index = write_shards(token_sequences(blocks, counts, key, stride, width), sum(counts), folder, stride, width, shard_slots)
    discard(blocks)
    return index, folder
