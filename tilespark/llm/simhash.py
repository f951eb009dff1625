"""SimHash near-duplicates by deletion variants.

A 64-bit fingerprint is cut into two 32-bit segments. Fingerprints that differ in at most three bits have one segment
that differs in at most one bit, so the two share a variant of that segment with one bit position masked out. Every
*distinct* fingerprint is indexed under its 2 x 32 variants; equal variants meet in an equality join and the full
distance is verified. Copies are folded into one fingerprint first, so groups of copies cost one row.

A bucket (one variant's fingerprints) may be large where many near copies exist. Buckets are cut into blocks of bounded
size; pairs of blocks are compared as bit matrices, and each comparison emits only a spanning forest of its links, which
keeps all connectivity without listing the pairs of a group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tilespark.functions.storage import materialize
from tilespark.operators.graph import connected_components

SEED = 42
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles: a bit is 1 where over half of the shingles' XXH64 values have it; no word gives 0."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    words = _WORDS.findall(data)
    if not words:
        return 0
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(norm[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, fp`` (the fingerprint's 64 bits as a signed long), one row a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t if isinstance(t, str) else None) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fps})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def _forest(left: np.ndarray, right: np.ndarray, same: bool, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of fingerprints (or within one)."""
    nodes = np.unique(np.concatenate([left, right]))
    label = np.arange(len(nodes))
    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    out = []
    for row, x in enumerate(left):
        first = row + 1 if same else 0
        near = first + np.flatnonzero(np.bitwise_count((right[first:] ^ x).view(np.uint64)) <= distance)
        own = label[at_left[row]]
        found, where = np.unique(label[at_right[near]], return_index=True)
        for other, j in zip(found, near[where]):
            if other != own:
                label[label == other] = own
                out.append((int(x), int(right[j])))
    return out


def links(fps: DataFrame, distance: int = 3, small: int = 16, block: int = 2048, spread: int = 1_000_000) -> DataFrame:
    """``fps(fp)``, distinct -> ``src, dst``: links at ``distance`` or fewer differing bits, enough to keep all connectivity.

    Buckets of at most ``small`` members are joined pair by pair; larger ones go through block comparisons. The join that collects
    a bucket's members has one row a bucket on its other side, so that adaptive execution splits a hot bucket over tasks;
    ``spread`` variants are made by one task.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one masked bit cover at most three differing bits")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    masked = [
        F.struct(F.lit(2 * bit + side).alias("slot"), seg.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).alias("value"))
        for side, seg in enumerate((low, high)) for bit in range(32)
    ]
    key = "v.slot * 4294967296L + v.value"
    # a fingerprint's 64 variants are made where it lies: spread the few fingerprints first
    fps = fps.repartition(max(1, math.ceil(fps.count() * len(masked) / spread)))
    variants = fps.select("fp", F.explode(F.array(*masked)).alias("v")).select("fp", F.expr(key).alias("key"))
    sizes = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lowest"), F.max("fp").alias("highest")).where("n > 1")
    sizes = materialize(sizes, "buckets")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    pairs = sizes.where("n = 2").select(F.col("lowest").alias("src"), F.col("highest").alias("dst")).where(near("src", "dst"))
    more = sizes.where("n > 2")
    members = materialize(variants.join(more.select("key", "n"), "key"), "members")
    few = members.where(F.col("n") <= small)
    mates = few.select("key", F.col("fp").alias("dst"))
    pairs = pairs.unionByName(few.select("key", F.col("fp").alias("src")).join(mates, "key").where("src < dst").where(near("src", "dst")).select("src", "dst"))

    many = members.where(F.col("n") > small).withColumn("blocks", F.ceil(F.col("n") * 2 / block).cast("int"))
    many = many.withColumn("at", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    packed = many.groupBy("key", "at").agg(F.first("blocks").alias("blocks"), F.collect_list("fp").alias("fps"))
    left = packed.select("key", "at", "fps", F.explode(F.sequence(F.col("at"), F.col("blocks") - 1)).alias("other"))
    right = packed.select("key", F.col("at").alias("other"), F.col("fps").alias("others"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, other, a, b in zip(batch["at"], batch["other"], batch["fps"], batch["others"]):
                out += _forest(np.asarray(a, np.int64), np.asarray(b, np.int64), at == other, distance)
            yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    blocks = left.join(right, ["key", "other"]).select("at", "other", "fps", "others")
    return pairs.unionByName(blocks.mapInPandas(compare, "src long, dst long")).distinct()


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, fingerprint, component_id``, one row a document.

    ``component_id`` is the smallest doc_id reachable over links of at most ``distance`` differing bits, the document's own
    included. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are kept.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    owners = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("owner")), "owners")
    groups = connected_components(links(owners.select("fp"), distance))
    labelled = owners.join(groups.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = labelled.groupBy("component").agg(F.min("owner").alias("component_id"))
    named = materialize(labelled.join(lowest, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
