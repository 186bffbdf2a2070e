"""What the operators share: tables in the shared folder, Arrow batches, column helpers.

``tidewheel`` must be importable on the executors (``--py-files`` or an installed package).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources.shared import delete, fresh_path, shared_dir, stored

__all__ = ["as_bytes", "discard", "fresh_path", "mixed", "packed", "packed_texts", "powers", "resident", "same", "sha256_utf8", "shared_dir", "signed", "slices", "small_table", "stored", "quoted", "text_slices", "unpacked", "unused"]

T = TypeVar("T")

#: Rows that Python code holds as objects at a time.
SLICE_ROWS = 256
#: Rows of a driver-made table up to which a join may broadcast it.
BROADCAST_ROWS = 20_000


def discard(df: DataFrame | None) -> None:
    """Deletes a stored() table that nothing reads any more."""
    if df is None:
        return
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/tidewheel/{df.sparkSession.sparkContext.applicationId}/" in parent:
            delete(df.sparkSession, parent)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of driver-made rows, broadcast in joins if its row count is checked to be small."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column has it, whatever the case."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> Column:
    """The column of exactly this name, also if it holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for a longer single text, ``size`` bytes in the column text."""
    for batch in slices(batches, rows):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


_ZSTD = pa.Codec("zstd", compression_level=1)


def packed(text: bytes | None) -> bytes | None:
    """A text on its way through a shuffle: its length and its zstd frame, well under the shuffle codec's size."""
    return None if text is None else len(text).to_bytes(8, "little") + _ZSTD.compress(text, asbytes=True)


def unpacked(body: bytes | None) -> bytes | None:
    if body is None:
        return None
    return _ZSTD.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), asbytes=True)


def packed_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, body) of rows of (doc_id, tag, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bodies = pa.array([packed(x) for x in as_bytes(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), bodies], names=["doc_id", "tag", "body"])

    return rows.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, body binary")


_RESIDENT: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], T]) -> T:
    """The one large object that a Python worker keeps from task to task; another key replaces it."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # what the C library has free goes back, where it can
            ctypes.CDLL(None).malloc_trim(0)
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's long of the same bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


def sha256_utf8(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes with all bits stirred."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
