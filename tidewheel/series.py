"""Series: lazy plans over one-dimensional arrays, run by Spark.

Nothing runs before a terminal: collect, item, sink_file, or an action on to_df() (but the
positions of a table in some order are found by to_df() itself). Closures are functions from Column to Column, which Catalyst compiles; map_numpy and map_python take
Python functions on arrays and on elements where that cannot be.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.errors import BOUNDS_TEXT, OutOfBounds, SinkIntoSource, translated
from tidewheel.functions import dtypes as D
from tidewheel.operators import sums, zipper
from tidewheel.plans import nodes as N
from tidewheel.plans.lowering import lower
from tidewheel.sources import raw_binary, tables
from tidewheel.storage import Storage
from tidewheel.tensor import Tensor

DEFAULT_BATCH_BYTES = raw_binary.BATCH_BYTES
#: Positions that one row of a generated range of batches stands for, at most.
_PARTITION_ELEMENTS = 1 << 23


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.active()


def _positions(spark: SparkSession, n: int, batch: int) -> DataFrame:
    """idx of 0 .. n - 1, each batch in one partition, in order."""
    batches = -(-n // batch)
    parts = max(1, min(batches, max(spark.sparkContext.defaultParallelism, -(-n // _PARTITION_ELEMENTS))))
    begin = f"id * {batch}L"
    return spark.range(0, batches, 1, parts).select(F.explode(F.expr(f"sequence({begin}, least({begin} + {batch}L, {n}L) - 1L)")).alias("idx"))


def scan_file(path: str, dtype: str | D.DType = "f64", spark: SparkSession | None = None) -> Series:
    """A raw binary file of elements; opened when the plan runs."""
    kind = D.dtype(dtype)
    path = os.fspath(path)
    return Series(N.Source(f"scan_file {path} ({kind.name})", kind, None, True, (path, 0, -1)), spark)


def generate(n: int, f: Callable[[Column], Column], dtype: str | D.DType = "f64", spark: SparkSession | None = None) -> Series:
    """f(i) for i from 0 to n - 1, where f makes a Column of a long Column."""
    kind = D.dtype(dtype)

    def make(spark: SparkSession, batch_bytes: int) -> DataFrame:
        value = f(F.col("idx"))
        value = value.cast(kind.spark) if kind.is_float else D.checked(value, kind)
        return _positions(spark, n, max(1, batch_bytes // kind.width)).select("idx", value.alias("value"))

    return Series(N.Source(f"generate {n} ({kind.name})", kind, make, True, length=n), spark)


def generate_python(n: int, f: Callable[[int], object], dtype: str | D.DType = "f64", spark: SparkSession | None = None) -> Series:
    """f(i) by a Python function, in Arrow batches."""
    return generate(n, lambda i: _python_udf(f, D.dtype(dtype))(i), dtype, spark)


def zeros(n: int, dtype: str | D.DType = "f64", spark: SparkSession | None = None) -> Series:
    return generate(n, lambda i: F.lit(0), dtype, spark)


def from_elements(values: Iterable, dtype: str | D.DType | None = None, spark: SparkSession | None = None) -> Series:
    """Elements held by the driver, sent as Arrow."""
    return Tensor.from_elements(values, dtype).lazy(spark)


def from_dataframe(
    df: DataFrame,
    value: str | Column,
    order_by: list[str | Column] | None = None,
    idx: str | Column | None = None,
    dtype: str | D.DType | None = None,
    descending: bool = False,
    reads: Iterable[str] = (),
) -> Series:
    """A column of a table, in the order of order_by (least first unless descending), or at the positions in idx (0, 1, 2 ... without gaps).

    Positions of order_by are found by a job that to_df() and the terminals start. reads names
    files behind df, besides those that Spark knows of, which a sink must not replace.
    """
    if (order_by is None) == (idx is None):
        raise ValueError("give order_by or idx")
    column = F.col(value) if isinstance(value, str) else value
    kind = D.dtype(dtype) if dtype is not None else D.of_spark(df.select(column.alias("v")).schema["v"].dataType)
    keys = [F.col(k) if isinstance(k, str) else k for k in (order_by if idx is None else [idx])]
    table = N.TableColumn(df, keys, column, idx is not None, descending)
    made: list[DataFrame] = []

    def make(spark: SparkSession, batch_bytes: int) -> DataFrame:
        if not made:
            made.append(tables.of_column(table))
        value = F.col("value").cast(kind.spark) if kind.is_float else D.checked(F.col("value"), kind)
        return made[0].select("idx", value.alias("value"))

    return Series(N.Source(f"from_dataframe ({kind.name})", kind, make, table=table, reads=lambda: [*reads, *df.inputFiles()]), df.sparkSession)


def _python_udf(f: Callable, kind: D.DType):
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([f(v) for v in values.tolist()], dtype="object" if isinstance(kind.spark, T.DecimalType) else None)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind.spark)


class Series:
    """A lazy, typed, ordered sequence; immutable, and usable in several plans."""

    def __init__(self, node: N.Node, spark: SparkSession | None = None, batch_bytes: int | None = None, parallelism: int | None = None):
        self._node, self._spark = node, spark
        self._batch_bytes, self._parallelism = batch_bytes, parallelism

    def _next(self, node: N.Node) -> Series:
        return Series(node, self._spark, self._batch_bytes, self._parallelism)

    @property
    def dtype(self) -> D.DType:
        return self._node.dtype

    @property
    def batch_bytes(self) -> int:
        return DEFAULT_BATCH_BYTES if self._batch_bytes is None else self._batch_bytes

    @property
    def parallelism(self) -> int | None:
        return self._parallelism

    def with_batch_bytes(self, batch_bytes: int) -> Series:
        """Sets the batch size of the whole plan, wherever it is called; an element is the least batch."""
        return Series(self._node, self._spark, max(0, batch_bytes), self._parallelism)

    def with_parallelism(self, n: int) -> Series:
        """At most n tasks (1 at least) read a source of the plan at once; results do not depend on it."""
        return Series(self._node, self._spark, self._batch_bytes, max(1, n))

    with_threads = with_parallelism

    # maps

    def map(self, f: Callable[[Column], Column], dtype: str | D.DType | None = None) -> Series:
        """f of every element; the result has dtype (the series' own if not given)."""
        return self._next(N.Map(self._node, f, D.dtype(dtype or self.dtype)))

    def map_numpy(self, f: Callable[[np.ndarray], np.ndarray], dtype: str | D.DType | None = None) -> Series:
        """f of arrays of elements, in Arrow batches, for what no Column expression says."""
        kind = D.dtype(dtype or self.dtype)

        def run(values: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(f(values.to_numpy())))

        run.__annotations__ = {"values": pd.Series, "return": pd.Series}
        return self._next(N.Map(self._node, lambda c: F.pandas_udf(run, kind.spark)(c), kind, "map_numpy"))

    def map_python(self, f: Callable[[object], object], dtype: str | D.DType | None = None) -> Series:
        """f of every element as a Python value."""
        kind = D.dtype(dtype or self.dtype)
        return self._next(N.Map(self._node, lambda c: _python_udf(f, kind)(c), kind, "map_python"))

    def mul_scalar(self, scalar, wrap: bool = False) -> Series:
        kind = self.dtype
        return self.map(lambda c: D.mul(c, F.lit(scalar).cast(kind.spark), kind, wrap))

    def set_at(self, k: int, value) -> Series:
        """The series with element k replaced; the old one is as it was. Where there is no element k, the plan raises."""
        kind = self.dtype
        if k < 0:
            raise OutOfBounds(f"place {k} is {BOUNDS_TEXT}")
        new = F.lit(value).cast(kind.spark) if kind.is_float else D.checked(F.lit(value), kind)
        return self._next(N.Update(self._node, k, new, kind))

    def slice(self, offset: int, count: int) -> Series:
        """Elements offset .. offset + count - 1, counted from 0 again; of a raw file, a byte range.

        Where the series has not all of them, the plan raises OutOfBounds.
        """
        if offset < 0 or count < 0:
            raise OutOfBounds(f"a slice of {count} at {offset} is {BOUNDS_TEXT}")
        return self._next(N.Slice(self._node, offset, count, self.dtype))

    def reinterpret(self, dtype: str | D.DType) -> Series:
        """A raw file's bytes as elements of another type."""
        node = self._node
        if not isinstance(node, N.Source) or not node.raw or node.raw[1:] != (0, -1):
            raise TypeError("only a whole raw file can be seen as another type")
        other = scan_file(node.raw[0], dtype, self._spark)
        return Series(other._node, self._spark, self._batch_bytes, self._parallelism)

    # combining

    def zip_with(self, other: Series, f: Callable[[Column, Column], Column], dtype: str | D.DType | None = None, label: str = "zip_with") -> Series:
        """f of the elements at each position of both series, whose lengths must agree when the plan runs."""
        sizes = (self.batch_bytes, other.batch_bytes)
        threads = [p for p in (self._parallelism, other._parallelism) if p is not None]
        batch = None if self._batch_bytes is None and other._batch_bytes is None else min(sizes)
        return Series(N.Zip(self._node, other._node, f, D.dtype(dtype or self.dtype), label), self._spark or other._spark, batch, max(threads, default=None))

    def _same_type(self, other: Series, f, label: str, wrap: bool = False) -> Series:
        if other.dtype != self.dtype:
            raise TypeError(f"{self.dtype.name} and {other.dtype.name} differ; use zip_with")
        kind = self.dtype
        return self.zip_with(other, lambda a, b: f(a, b, kind, wrap), kind, label)

    def __add__(self, other: Series) -> Series:
        return self._same_type(other, D.add, "add")

    def __sub__(self, other: Series) -> Series:
        return self._same_type(other, D.sub, "sub")

    def __mul__(self, other) -> Series:
        return self._same_type(other, D.mul, "mul") if isinstance(other, Series) else self.mul_scalar(other)

    def wrapping_add(self, other: Series) -> Series:
        return self._same_type(other, D.add, "add", True)

    def wrapping_sub(self, other: Series) -> Series:
        return self._same_type(other, D.sub, "sub", True)

    def wrapping_mul(self, other: Series) -> Series:
        return self._same_type(other, D.mul, "mul", True)

    # reductions

    def sum(self) -> Series:
        """A series of one element, of the same type: zero if there are none."""
        return self._next(N.Reduce(self._node, self.dtype))

    def wide_sum(self, wrap: bool = False) -> DataFrame:
        """(idx 0, value): the sum of integers as a long or decimal, or wrapped to the type."""
        if self.dtype.is_float:
            raise TypeError("floats add in their own type; use sum")
        return sums.exact(self.to_df(), self.dtype, widen=not wrap, wrap=wrap)

    def batch_partials(self, batch: int) -> DataFrame:
        return sums.partials(self.to_df(), batch)

    # terminals and inspection

    def to_df(self) -> DataFrame:
        """(idx, value); rows come in no order. Only positions of an order_by are found at once."""
        return lower(_session(self._spark), self._node, self.batch_bytes, self._parallelism)

    def collect(self) -> Tensor:
        """Runs the plan and holds the whole result in the driver's memory, in order."""
        try:
            column = self.to_df().orderBy("idx").select("value").toArrow().column("value").combine_chunks()
        except (PySparkException, pa.ArrowException) as e:
            raise translated(e) from e
        return Tensor.from_storage(Storage.from_bytes(raw_binary.to_bytes(column, self.dtype)), self.dtype)

    def item(self):
        """The element of a series of one; raises ValueError for any other length."""
        return self.collect().item()

    def count(self) -> int:
        try:
            return self.to_df().count()
        except PySparkException as e:
            raise translated(e) from e

    __len__ = None  # counting runs a plan; ask for count()

    def is_empty(self) -> bool:
        return self.count() == 0

    def equals(self, other: Series) -> DataFrame:
        """One row, column equal: same length and elements, where NaN equals nothing."""
        return zipper.equal(self.to_df(), other.to_df())

    def spill(self) -> Series:
        """The series computed once and kept on the executors' disks."""
        return self._next(N.Spill(self._node, self.dtype, []))

    def sink_file(self, path: str) -> None:
        """Writes the elements, in order, to one raw binary file, which is replaced only when all are written."""
        path = os.fspath(path)
        if any(_same_file(p, path) for p in N.source_paths(self._node)):
            raise SinkIntoSource(f"the plan reads {path}")
        spark = _session(self._spark)
        raw_binary.register(spark)
        try:
            ordered = self.to_df().repartitionByRange("idx").sortWithinPartitions("idx")
            ordered.write.format(raw_binary.FORMAT).options(path=path, dtype=self.dtype.name).mode("append").save()
        except PySparkException as e:
            raise translated(e) from e

    def explain(self) -> str:
        """The plan as a tree, root first."""
        return N.rendered(self._node)

    def __repr__(self) -> str:
        return f"Series[{self.dtype.name}: {' '.join(self.explain().split())}]"


def _same_file(a: str, b: str) -> bool:
    """Whether two paths are one file, also through links; URIs other than file: are compared as text."""
    a, b = (re.sub("^file:/(//)?(?=[^/])", "/", p) for p in (a, b))
    if "://" in a or "://" in b:
        return a.rstrip("/") == b.rstrip("/")
    try:
        return os.path.samefile(a, b)
    except OSError:
        return False
