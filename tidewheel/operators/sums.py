"""Sums that keep the element type.

Integers and decimals are exact in any order, so Spark's own aggregate does the work. Floats
add in a fixed order: each batch is summed pairwise, and the batches' sums are folded from zero
in order, so the result has the same bits however the data are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.errors import OVERFLOW_TEXT
from tidewheel.functions.dtypes import DType, checked, wrapped
from tidewheel.functions.kernels import pairwise_sum


def exact(df: DataFrame, kind: DType, widen: bool = False, wrap: bool = False) -> DataFrame:
    """(idx 0, value): the sum of integers, checked against the type unless widened or wrapped."""
    wide = T.DecimalType(38, 0) if kind.width >= 8 else T.LongType()
    some = F.try_sum(F.col("value").cast(wide))  # null where it overflows, in any ANSI mode
    over = F.raise_error(F.lit(f"{OVERFLOW_TEXT} sum of {kind.name}")).cast(T.DecimalType(38, 0))
    total = F.when(F.count("value") == 0, F.lit(0).cast(T.DecimalType(38, 0))).when(some.isNull(), over).otherwise(some.cast(T.DecimalType(38, 0)))
    if not widen:
        total = wrapped(total, kind) if wrap else checked(total, kind)
    return df.agg(total.alias("value")).select(F.lit(0).cast("long").alias("idx"), "value")


def _batch_sums(kind: np.dtype):
    """Sums of consecutive batches; rows come by batch and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        ids, sums = [], []
        for batch in batches:
            b = batch.column("b").to_numpy(zero_copy_only=False)
            v = batch.column("value").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if b[s] != now and held:
                    ids.append(now)
                    sums.append(pairwise_sum(np.concatenate(held)))
                    held = []
                now = int(b[s])
                held.append(v[s:e])
        if held:
            ids.append(now)
            sums.append(pairwise_sum(np.concatenate(held)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(sums, dtype=kind))], names=["b", "value"])

    return run


def _folded(kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = kind.type(0)
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                for v in batch.column("value").to_numpy(zero_copy_only=False):
                    total = kind.type(total + v)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array(np.array([total], dtype=kind))], names=["idx", "value"])

    return run


def ordered(df: DataFrame, kind: DType, batch_sizes: list[int], batch_ordered: bool) -> DataFrame:
    """(idx 0, value): the sum of floats in the order that the batch sizes fix.

    A batch is one unit of work, of batch_bytes at most. Sources that keep a batch in one
    partition, in order, need no shuffle; others are dealt by batch and sorted. The last fold
    runs over one number a batch, streamed through one task in order.
    """
    name = kind.spark.simpleString()
    batch = sum((F.expr(f"idx div {k}") for k in batch_sizes), F.lit(0).cast("long"))
    rows = df.select(batch.alias("b"), "idx", F.col("value").cast(kind.spark).alias("value"))
    if not batch_ordered:
        rows = rows.repartition("b").sortWithinPartitions("b", "idx")
    partial = rows.select("b", "value").mapInArrow(_batch_sums(kind.numpy), f"b long, value {name}")
    zero = df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("b"), F.lit(0).cast(kind.spark).alias("value"))
    partial = partial.union(zero)  # the sum of nothing
    return partial.repartition(1).sortWithinPartitions("b").mapInArrow(_folded(kind.numpy), f"idx long, value {name}")


def partials(df: DataFrame, batch: int) -> DataFrame:
    """(batch_id, partial): Spark's own sum of each batch, for exact types."""
    return df.groupBy(F.expr(f"idx div {batch}").alias("batch_id")).agg(F.sum("value").alias("partial"))
