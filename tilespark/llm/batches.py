"""Arrow batches cut to a bounded size, for tasks that work on many texts together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def portions(batch: pa.RecordBatch, chunk: int) -> Iterator[tuple[list, pa.Array]]:
    """``doc_id`` and ``text`` of the rows of a batch, cut so that texts of about ``chunk`` bytes are worked on together (a longer text alone)."""
    ids, texts = batch.column("doc_id"), batch.column("text")
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, side="right")))
        yield ids[at:stop].to_pylist(), texts[at:stop]
        at = stop
