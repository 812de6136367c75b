"""Runs: rows gathered into blobs of text that one task opens at a time, and packed arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import slices, text_bytes

#: Bytes of text in a run, and how hard it is compressed: runs are stored once and sent a few times.
RUN_BYTES, LEVEL = 32 << 20, 6
#: Stands for a null doc_id.
NONE = -(2**63)


# ---------------------------------------------------------------- packing


def press(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte plane by byte plane."""
    planes = a.view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpress(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def press_sorted(a: np.ndarray) -> bytes:
    return press(np.diff(a, prepend=np.uint64(0)))


def unpress_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpress(blob, np.uint64), dtype=np.uint64)


# ---------------------------------------------------------------- runs


def _gather(batches, most: int):
    """Rows of one task as runs: ids, offsets and the compressed text."""
    task, ids, sizes, parts, held = TaskContext.get().partitionId(), [], [], [], 0
    made = 0

    def run():
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 24) + made]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(sizes).astype(np.int64).tobytes()], pa.binary()), pa.array([zstandard.compress(b"".join(parts), LEVEL)], pa.binary())],
            ["run", "ids", "sizes", "text"],
        )

    for batch in slices(batches, "text"):
        raw, offs = text_bytes(batch.column(1))
        ids.append(batch.column(0).cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False))
        sizes.append(np.diff(offs))
        parts.append(raw.tobytes())
        held += len(raw)
        if held >= most:
            yield run()
            made, ids, sizes, parts, held = made + 1, [], [], [], 0
    if ids:
        yield run()


class Run:
    """A run opened: document ids, document offsets, bytes."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.order = np.where(self.ids == NONE, 2**63 - 1, self.ids)  # a null doc_id comes after every other
        self.offs = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64))))
        self.raw = np.frombuffer(zstandard.decompress(text, max_output_size=int(self.offs[-1]) + 1) if self.offs[-1] else b"", np.uint8)

    def parts(self, most: int = 1 << 20):
        """(first, last) document numbers of stretches of about ``most`` bytes; a longer document is a stretch of its own."""
        a = 0
        while a < len(self.ids):
            b = max(a + 1, int(np.searchsorted(self.offs, self.offs[a] + most, side="right")) - 1)
            yield a, b
            a = b

    def docs(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, places, side="right") - 1


def gather(docs: DataFrame, most: int = RUN_BYTES) -> DataFrame:
    """run, ids, sizes, text: the rows of docs (doc_id, text) as runs of about ``most`` bytes; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda batches: _gather(batches, most), "run long, ids binary, sizes binary, text binary")
