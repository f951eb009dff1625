"""Plain image files: read by Spark's image source, written as PNG, one file an image."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tilespark.operators.pointwise import wrap

PIXELS = "image_id string, r int, c int, ch int, v int"
#: Values of one batch of rows that leaves a task.
BATCH = 1 << 20


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Image files -> ``image_id, r, c, ch, v``; ``image_id`` is the file, channels are in the order red, green, blue (, alpha).

    Files that hold no image are left out, as Spark's image source does with ``dropInvalid``.
    """
    def unfold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, h, w, n, data in frame.itertuples(index=False):
                whole = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n)
                whole = whole[:, :, [2, 1, 0, 3][:n]] if n > 1 else whole
                step = max(1, BATCH // (w * n))
                for top in range(0, h, step):
                    part = whole[top:top + step]
                    r, c, ch = np.indices(part.shape)
                    yield pd.DataFrame({"image_id": file, "r": r.ravel() + top, "c": c.ravel(), "ch": ch.ravel(), "v": part.ravel().astype(int)})

    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(unfold, PIXELS)


def _png(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * n)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def encode_png(pixels: DataFrame, multiplier: int = 1, value: str = "v") -> DataFrame:
    """``pixels(image_id, r, c, ch, v)`` -> ``image_id, height, width, channels, content``; 8-bit values times the multiplier wrap.

    One or three channels; others are an error. Null and missing pixels are 0. A plain image is packed whole by one task: rasters
    too large for that stay pyramids.
    """
    lines = pixels.where(F.col("r").isNotNull() & F.col("c").isNotNull() & F.col("ch").isNotNull()).select(
        "image_id", "r", "c", "ch", F.coalesce(wrap(F.col(value).cast("long") * multiplier), F.lit(0)).alias("v"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        h, w, n = (int(frame[k].max()) + 1 for k in ("r", "c", "ch"))
        if n not in (1, 3):
            raise ValueError(f"a plain image has 1 or 3 channels, not {n}")
        whole = np.zeros((h, w, n), np.uint8)
        whole[frame["r"], frame["c"], frame["ch"]] = frame["v"]
        return pd.DataFrame({"image_id": [str(frame["image_id"].iloc[0])], "height": [h], "width": [w], "channels": [n], "content": [_png(whole)]})

    return lines.groupBy("image_id").applyInPandas(pack, "image_id string, height int, width int, channels int, content binary")


def write_plain(images: DataFrame, folder: str) -> DataFrame:
    """Write ``images(image_id, content)`` as ``<folder>/<image_id>.png`` from the tasks; gives ``path, bytes``, and files appear when it is run.

    The folder must exist and be shared. A task that is run again writes the same bytes to the same name; unfinished files have another name.
    """
    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = fs.FileSystem.from_uri(folder)
        for frame in frames:
            paths = []
            for name, content in frame.itertuples(index=False):
                path = f"{base.rstrip('/')}/{name}.png"
                with where.open_output_stream(path + ".part") as out:
                    out.write(content)
                where.move(path + ".part", path)
                paths.append(path)
            yield pd.DataFrame({"path": paths, "bytes": [len(c) for c in frame["content"]]})

    return images.select("image_id", "content").mapInPandas(save, "path string, bytes long")


def clear(pixels: DataFrame, value: str = "v") -> DataFrame:
    """The same image with all values 0."""
    return pixels.withColumn(value, F.lit(0).cast(pixels.schema[value].dataType))
