"""Plans over tables that grow: Structured Streaming with the same element semantics.

The engine's own streaming is bounded-memory execution of finite input, which every plan has.
These are for input that keeps arriving.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import dtypes as D


def mapped(stream: DataFrame, value: str, f: Callable[[Column], Column], dtype: str | D.DType) -> DataFrame:
    """stream with the column value replaced by f of it, checked against dtype; a stateless projection."""
    kind = D.dtype(dtype)
    out = f(F.col(value))
    return stream.withColumn(value, out.cast(kind.spark) if kind.is_float else D.checked(out, kind))


def windowed_sum(stream: DataFrame, at: str, value: str, width: str, lateness: str) -> DataFrame:
    """(start, end, total, n) of tumbling windows of event time; rows later than lateness are left out."""
    rows = stream.select(F.col(at).cast("timestamp").alias("at"), F.col(value).alias("v")).withWatermark("at", lateness)
    summed = rows.groupBy(F.window("at", width).alias("w")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    return summed.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")
