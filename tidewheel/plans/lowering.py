"""From plan nodes to DataFrames of (idx, value).

Maps become projections, so a chain of them is one generated loop. A zip of two chains over
one source is a projection too, as is one of two columns of a table in one order; a zip of two
raw files reads them side by side; sums meet in a join of single rows; only other zips join on
the position.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.errors import BOUNDS_TEXT, OutOfBounds
from tidewheel.functions.dtypes import checked
from tidewheel.operators import sums, zipper
from tidewheel.plans.nodes import Node, Reduce, Slice, Source, Spill, Update, Zip, base_of, batch_sizes, length_of
from tidewheel.sources import raw_binary, tables


def _applied(node: Node, base: Node, value: Column) -> Column:
    """The maps between node and base, applied to the base's column."""
    chain = []
    while node is not base:
        chain.append(node)
        node = node.input
    for step in reversed(chain):
        value = step.f(value)
        value = value.cast(step.dtype.spark) if step.dtype.is_float else checked(value, step.dtype)
    return value


def _typed(value: Column, node: Node) -> Column:
    return value.cast(node.dtype.spark) if node.dtype.is_float else checked(value, node.dtype)


def _raw(spark: SparkSession, nodes: list[Source], batch_bytes: int) -> DataFrame:
    raw_binary.register(spark)
    _, offset, count = nodes[0].raw
    options = {"paths": json.dumps([n.raw[0] for n in nodes]), "dtypes": json.dumps([n.dtype.name for n in nodes]), "batch_bytes": str(batch_bytes), "offset": str(offset), "count": str(count)}
    return spark.read.format(raw_binary.FORMAT).options(**options).load()


def _ordered(node: Node) -> bool:
    """Whether each batch of the lowered node lies in one partition, in order."""
    node = base_of(node)
    return isinstance(node, Source) and node.batch_ordered


def lower(spark: SparkSession, node: Node, batch_bytes: int, parallelism: int | None = None) -> DataFrame:
    """(idx, value) of a node; at most ``parallelism`` tasks read each source at once."""
    base = base_of(node)
    if isinstance(base, Source):
        df = _raw(spark, [base], batch_bytes) if base.raw else base.make(spark, batch_bytes)
        df = _at_once(df, parallelism)
    elif isinstance(base, Zip):
        left, right, met = _zip(spark, base, batch_bytes, parallelism)
        df = met.select("idx", _typed(base.f(left, right), base).alias("value"))
    elif isinstance(base, Reduce):
        inner = lower(spark, base.input, batch_bytes, parallelism)
        if base.dtype.is_float:
            sizes = batch_sizes(base.input, batch_bytes)
            df = sums.ordered(inner, base.dtype, sizes, _ordered(base.input))
        else:
            df = sums.exact(inner, base.dtype)
    elif isinstance(base, Slice):
        df = _slice(spark, base, batch_bytes, parallelism)
    elif isinstance(base, Update):
        inner = lower(spark, base.input, batch_bytes, parallelism)
        new = F.when(F.col("idx") == base.at, base.value).otherwise(F.col("value"))
        df = _bounded(base.input, inner, inner.select("idx", new.alias("value")), base.at, 1, f"place {base.at}")
    elif isinstance(base, Spill):
        if not base.held:
            base.held.append(lower(spark, base.input, batch_bytes, parallelism).persist(StorageLevel.DISK_ONLY))
        df = base.held[0]
    else:
        raise TypeError(type(base).__name__)
    return df if node is base else df.select("idx", _applied(node, base, F.col("value")).alias("value"))


def _at_once(df: DataFrame, parallelism: int | None) -> DataFrame:
    """Neighbouring partitions are read by one task, so batches stay whole and in order."""
    return df if parallelism is None else df.coalesce(parallelism)


def _bounded(node: Node, whole: DataFrame, df: DataFrame, offset: int, count: int, what: str) -> DataFrame:
    """df, which raises when it is read unless whole (node's rows) has the elements offset .. offset + count - 1.

    Where the length is not known beforehand, a count of these positions adds no row to df, or raises.
    """
    length = length_of(node)
    text = f"{what} is {BOUNDS_TEXT}"
    if length is not None:
        if offset + count > length:
            raise OutOfBounds(f"{text}, which has {length} elements")
        return df
    if not count:
        after = whole.agg(F.max("idx").alias("last")).where(F.when(F.coalesce("last", F.lit(-1)) + 1 < offset, F.raise_error(F.lit(text)).cast("boolean")).otherwise(F.lit(False)))
        return df.union(after.select(F.col("last").alias("idx"), F.lit(None).cast(df.schema["value"].dataType).alias("value")))
    there = whole.where((F.col("idx") >= offset) & (F.col("idx") < offset + count)).agg(F.count("*").alias("n"))
    short = there.where(F.when(F.col("n") != count, F.raise_error(F.lit(text)).cast("boolean")).otherwise(F.lit(False)))
    return df.union(short.select(F.col("n").alias("idx"), F.lit(None).cast(df.schema["value"].dataType).alias("value")))


def _slice(spark: SparkSession, node: Slice, batch_bytes: int, parallelism: int | None) -> DataFrame:
    inner, below = node.input, base_of(node.input)
    if isinstance(below, Source) and below.raw:  # a byte range of the file
        path, offset, _ = below.raw
        part = replace(below, raw=(path, offset + node.offset, node.count))
        df = _at_once(_raw(spark, [part], batch_bytes), parallelism)
        return df.select("idx", _applied(inner, below, F.col("value")).alias("value"))
    df = lower(spark, inner, batch_bytes, parallelism)
    window = df.where((F.col("idx") >= node.offset) & (F.col("idx") < node.offset + node.count)).select((F.col("idx") - node.offset).alias("idx"), "value")
    return _bounded(inner, df, window, node.offset, node.count, f"a slice of {node.count} at {node.offset}")


def _zip(spark: SparkSession, node: Zip, batch_bytes: int, parallelism: int | None) -> tuple[Column, Column, DataFrame]:
    """The columns of the two sides, and the frame that has them with idx."""
    left, right = base_of(node.left), base_of(node.right)
    sources = isinstance(left, Source) and isinstance(right, Source)
    if left is right:
        value = F.col("value")
        return _applied(node.left, left, value), _applied(node.right, right, value), lower(spark, left, batch_bytes, parallelism)
    if sources and left.raw and right.raw and left.raw[1:] == right.raw[1:]:
        df = _at_once(_raw(spark, [left, right], batch_bytes), parallelism)
        return _applied(node.left, left, F.col("v0")), _applied(node.right, right, F.col("v1")), df
    if sources and left.table and right.table and left.table.beside(right.table):
        df = _at_once(tables.side_by_side(left.table, right.table), parallelism)
        a, b = (_typed(F.col(c), s) for c, s in (("v0", left), ("v1", right)))
        return _applied(node.left, left, a), _applied(node.right, right, b), df
    a, b = (lower(spark, side, batch_bytes, parallelism) for side in (node.left, node.right))
    met = zipper.zipped_single(a, b) if length_of(node.left) == length_of(node.right) == 1 else zipper.zipped(a, b)
    return F.col("l"), F.col("r"), met


def side_by_side(spark: SparkSession, left: Node, right: Node, batch_bytes: int) -> DataFrame:
    """(idx, l, r) of two nodes of one length."""
    l, r, df = _zip(spark, Zip(left, right, lambda a, b: a, left.dtype), batch_bytes, None)
    return df.select("idx", l.alias("l"), r.alias("r"))
