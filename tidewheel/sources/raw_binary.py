"""Headerless binary element files as a Spark data source, read and written.

Reading: a partition is a byte range of whole batches; nothing is opened before the plan runs,
and then every file's size is checked before any batch flows. Several files of one length can
be read side by side, one column each. Writing to a file system with files that can be written
in place (local and file: paths): each task writes its elements at their own offsets in a new
file next to the target, which the commit renames; nothing goes through the driver. On other
file systems each task writes a part and the commit puts the parts together in order, through
the driver. A failed job leaves the old file as it was. Paths are local paths or URIs of
pyarrow's file systems that driver and executors share.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidewheel.errors import BOUNDS_TEXT, MISMATCH_TEXT, SizeMismatch
from tidewheel.functions.dtypes import DType, dtype

FORMAT = "tidewheel_raw"
BATCH_BYTES = 4 << 20
#: Bytes of the first file that a partition should hold.
PARTITION_BYTES = 64 << 20


def opened(path: str):
    """The file system and path behind a local path or URI."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def elements(path: str, width: int) -> int:
    """Whole elements in the file; raises SourceError text if it is absent or has a part of one."""
    from pyarrow import fs

    files, where = opened(path)
    info = files.get_file_info(where)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(f"SourceError: no file at {path}")
    if info.size % width:
        raise ValueError(f"SourceError: {path}: {SizeMismatch(info.size, width)}")
    return info.size // width


def to_arrow(raw: bytes, kind: DType) -> pa.Array:
    """Element bytes as the column that Spark stores."""
    values = np.frombuffer(raw, kind.numpy)
    if kind.width == 16:
        whole = [(int(hi) << 64) + int(lo) for lo, hi in zip(values["lo"].tolist(), values["hi"].tolist(), strict=True)]
        return pa.array(whole, pa.decimal128(38, 0))
    if kind.spark == T.DecimalType(20, 0):
        return pa.array(values).cast(pa.decimal128(20, 0))
    widened = {"u1": "<i2", "u2": "<i4", "u4": "<i8"}.get(kind.numpy.str[1:])
    return pa.array(values.astype(widened) if widened else values)


def to_bytes(column: pa.Array, kind: DType) -> bytes:
    """A stored column as element bytes; raises if a value is null."""
    if column.null_count:
        raise ValueError("a series has no nulls")
    if kind.width == 16:
        return b"".join(int(v).to_bytes(16, "little", signed=kind.low < 0) for v in column.to_pylist())
    if kind.spark == T.DecimalType(20, 0):
        return np.array([int(v) for v in column.to_pylist()], dtype=kind.numpy).tobytes()
    return column.to_numpy(zero_copy_only=False).astype(kind.numpy).tobytes()


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__((first, count))
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.kinds = [dtype(x) for x in json.loads(options["dtypes"])]
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.offset, self.most = int(options.get("offset", 0)), int(options.get("count", -1))

    def _batch(self) -> int:
        return max(1, min(max(1, self.batch_bytes // k.width) for k in self.kinds))

    def partitions(self) -> list[InputPartition]:
        sizes = {elements(p, k.width) for p, k in zip(self.paths, self.kinds, strict=True)}
        if len(sizes) > 1:
            raise ValueError(MISMATCH_TEXT)
        n = sizes.pop() - self.offset
        if self.most >= 0:
            if self.most > n:
                raise ValueError(f"a slice of {self.most} at {self.offset} is {BOUNDS_TEXT}")
            n = self.most
        batch = self._batch()
        step = max(1, PARTITION_BYTES // (batch * self.kinds[0].width)) * batch
        first = self.offset
        return [_Range(at, min(step, first + n - at)) for at in range(first, first + n, step)] or [_Range(first, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = ["idx", *(f"v{i}" for i in range(len(self.kinds)))] if len(self.kinds) > 1 else ["idx", "value"]
        files = []
        for path, kind in zip(self.paths, self.kinds, strict=True):
            system, where = opened(path)
            files.append(system.open_input_file(where))
            files[-1].seek(partition.first * kind.width)
        try:
            left, at, batch = partition.count, partition.first, min(self._batch(), 1 << 20)
            while left:
                n = min(batch, left)
                columns = [to_arrow(f.read(n * k.width), k) for f, k in zip(files, self.kinds, strict=True)]
                idx = pa.array(np.arange(at - self.offset, at - self.offset + n))
                yield pa.RecordBatch.from_arrays([idx, *columns], names=names)
                at, left = at + n, left - n
        finally:
            for f in files:
                f.close()


class _Part(WriterCommitMessage):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], dtype(options["dtype"])
        self.job = uuid.uuid4().hex

    def _opened(self):
        """The file system, the target in it, and whether its files can be written in place."""
        from pyarrow import fs

        files, where = opened(self.path)
        files.create_dir(where.rpartition("/")[0] or ".", recursive=True)
        return files, where, isinstance(files, fs.LocalFileSystem)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, where, in_place = self._opened()
        part = f"{where}.part-{self.job}-{uuid.uuid4().hex}"
        first, count = -1, 0
        with contextlib.ExitStack() as held:
            out = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                idx, raw = batch.column(0).to_numpy(), to_bytes(batch.column(1), self.kind)
                if out is None:
                    first = int(idx[0])
                    if in_place:
                        out = held.enter_context(os.fdopen(os.open(f"{where}.whole-{self.job}", os.O_RDWR | os.O_CREAT, 0o644), "r+b"))
                        out.seek(first * self.kind.width)
                    else:
                        out = held.enter_context(files.open_output_stream(part))
                if idx[0] != first + count or (np.diff(idx) != 1).any():
                    raise ValueError("positions of a series have no gaps")
                out.write(raw)
                count += batch.num_rows
        return _Part(part, first, count)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        files, where, in_place = self._opened()
        whole = f"{where}.whole-{self.job}"
        parts = sorted((m for m in messages if m is not None and m.count), key=lambda m: m.first)
        if [m.first for m in parts] != np.cumsum([0, *(m.count for m in parts)])[: len(parts)].tolist():
            raise ValueError("positions of a series have no gaps")
        if not in_place or not parts:
            with files.open_output_stream(whole) as out:
                for m in parts:
                    with files.open_input_stream(m.path) as part:
                        while chunk := part.read(BATCH_BYTES):
                            out.write(chunk)
        files.move(whole, where)
        self._drop()

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        files, where = opened(self.path)
        folder, _, name = where.rpartition("/")
        for info in files.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True)):
            if info.base_name.startswith((f"{name}.part-{self.job}-", f"{name}.whole-{self.job}")):
                files.delete_file(info.path)


class RawBinary(DataSource):
    """Options of a read: paths and dtypes (JSON lists), batch_bytes, offset, count; of a write: path, dtype."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        kinds = [dtype(x) for x in json.loads(self.options["dtypes"])]
        names = [f"v{i}" for i in range(len(kinds))] if len(kinds) > 1 else ["value"]
        return T.StructType([T.StructField("idx", T.LongType(), False), *(T.StructField(n, k.spark, False) for n, k in zip(names, kinds, strict=True))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawBinary)
