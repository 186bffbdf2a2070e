"""Sort, top, group and join of series: beyond the plans' own operators, on Spark's built-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans.lowering import side_by_side
from tidewheel.plans.nodes import source_paths
from tidewheel.series import Series, from_dataframe


def sort(series: Series, descending: bool = False) -> Series:
    """The elements in order, with new positions."""
    return from_dataframe(series.to_df().select("value"), "value", order_by=["value"], dtype=series.dtype, descending=descending, reads=source_paths(series._node))


def top(series: Series, n: int) -> DataFrame:
    """(idx, value) of the n largest elements; ties go to the lower position."""
    return series.to_df().orderBy(F.col("value").desc(), "idx").limit(n)


def filtered(series: Series, keep: Callable[[Column], Column]) -> Series:
    """The elements for which keep holds, in order, with new positions."""
    df = series.to_df().where(keep(F.col("value")))
    return from_dataframe(df, "value", order_by=["idx"], dtype=series.dtype, reads=source_paths(series._node))


def group_sum(keys: Series, values: Series) -> DataFrame:
    """(key, total, n) over the positions of two series of one length."""
    both = keys.zip_with(values, lambda k, v: k)  # merges the settings
    met = side_by_side(both._spark or SparkSession.active(), keys._node, values._node, both.batch_bytes)
    return met.groupBy(F.col("l").alias("key")).agg(F.sum("r").alias("total"), F.count("*").alias("n"))


def join_on_value(left: Series, right: Series) -> DataFrame:
    """(value, left_idx, right_idx) of all pairs of equal elements."""
    a = left.to_df().select(F.col("idx").alias("left_idx"), "value")
    b = right.to_df().select(F.col("idx").alias("right_idx"), "value")
    return a.join(b, "value").select("value", "left_idx", "right_idx")
