"""Stored patch batches: pieces of equal numbers of positions and a manifest, read back from any position."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MANIFEST = "repetition int, folder string, patches long, cells long, piece int, columns array<string>, settings map<string,string>, check long"


def _check(columns: list[str]) -> Column:
    """An order-free checksum of whole rows that wraps nowhere."""
    return F.sum(F.xxhash64(*columns).bitwiseAND(F.lit((1 << 31) - 1)))


def write(batch: DataFrame, path: str, repetition: int, settings: dict[str, str] | None = None, piece: int = 4096, partitions: int | None = None) -> None:
    """Store a batch ``(position, ..)`` of patches, any number of rows a position, as repetition ``repetition`` under ``path``.

    Positions run from 0 without gaps; others, null ones too, are an error. A piece holds ``piece`` positions and is one folder. The manifest's row is
    written last and names the folder of its pieces: a repetition without it was cut off, is not read and can be written anew.
    """
    if piece < 1:
        raise ValueError("a piece holds at least one position")
    if "piece" in batch.columns:
        raise ValueError("the column name piece is taken")
    spark = batch.sparkSession
    if manifest(spark, path).where(F.col("repetition") == repetition).take(1):
        raise ValueError(f"repetition {repetition} is stored already")
    folder = f"repetition-{repetition}-{uuid.uuid4().hex}"
    keyed = batch.withColumn("piece", F.floor(F.col("position") / piece).cast("long"))
    dealt = keyed.repartitionByRange(*([partitions] if partitions else []), "piece", "position").sortWithinPartitions("piece", "position")
    dealt.write.partitionBy("piece").parquet(f"{path}/{folder}")
    found = None
    if batch.take(1):
        written = spark.read.parquet(f"{path}/{folder}").select(*batch.columns)
        found = written.agg(F.count("*").alias("cells"), F.count_distinct("position").alias("patches"), F.min("position").alias("low"), F.max("position").alias("high"),
                            F.count("position").alias("known"), _check(batch.columns).alias("check")).first()
    if found and (found["known"] != found["cells"] or found["low"] != 0 or found["high"] != found["patches"] - 1):
        raise ValueError("positions must run from 0 without gaps")
    row = (repetition, folder, found["patches"] if found else 0, found["cells"] if found else 0, piece, batch.columns, settings or {}, found["check"] if found else 0)
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row a whole repetition: its number, patches, rows, positions a piece, columns, settings and checksum. Nothing stored gives no rows."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, repetition: int, start: int = 0, count: int | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``count`` positions (all, if None) from ``start``, so that a reader goes on where it stopped; other pieces aren't listed.

    A repetition that isn't whole, and one whose settings differ from the ``settings`` asked for, are errors. Rows come in no order of their own.
    """
    found = manifest(spark, path).where(F.col("repetition") == repetition).take(1)
    if not found:
        raise ValueError(f"repetition {repetition} is not stored under {path}")
    row = found[0]
    other = {k for k, v in (settings or {}).items() if row["settings"].get(k) != v}
    if other:
        raise ValueError(f"stored with other settings: {sorted(other)}")
    if start < 0 or start > row["patches"] or (count is not None and count < 0):
        raise ValueError(f"position {start} is not in 0..{row['patches']}")
    if not row["patches"]:
        raise ValueError(f"repetition {repetition} is empty")
    stop = row["patches"] if count is None else min(row["patches"], start + count)
    stored = spark.read.parquet(f"{path}/{row['folder']}")
    held = F.col("piece").between(start // row["piece"], max(start, stop - 1) // row["piece"])
    return stored.where(held & (F.col("position") >= start) & (F.col("position") < stop)).select(*row["columns"])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """``repetition, cells, whole``: whether the stored rows of each repetition in the manifest are those that were written."""
    held = manifest(spark, path).collect()  # a row a repetition
    out = None
    for row in held:
        if not row["patches"]:
            part = spark.createDataFrame([(row["repetition"], 0, True)], "repetition int, cells long, whole boolean")
        else:
            part = spark.read.parquet(f"{path}/{row['folder']}").agg(F.count("*").alias("cells"), _check(row["columns"]).alias("check")).select(
                F.lit(row["repetition"]).alias("repetition"), "cells", ((F.col("cells") == row["cells"]) & F.col("check").eqNullSafe(F.lit(row["check"]))).alias("whole"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "repetition int, cells long, whole boolean")
