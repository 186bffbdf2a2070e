"""Positional zip of two frames of (idx, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.errors import MISMATCH_TEXT


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """(idx, l, r); a position that one side lacks raises when the rows are read.

    One full outer equi-join on the position: both sides are dealt evenly, whatever the
    values. The check is a filter, which no projection can prune away.
    """
    a = left.select("idx", F.col("value").alias("l"), F.lit(True).alias("in_l"))
    b = right.select("idx", F.col("value").alias("r"), F.lit(True).alias("in_r"))
    both = a.join(b, "idx", "full_outer")
    whole = F.when(F.col("in_l").isNull() | F.col("in_r").isNull(), F.raise_error(F.lit(MISMATCH_TEXT)).cast("boolean")).otherwise(F.lit(True))
    return both.where(whole).select("idx", "l", "r")


def zipped_single(left: DataFrame, right: DataFrame) -> DataFrame:
    """(idx, l, r) of two frames of exactly one row each."""
    one = right.select("idx", F.col("value").alias("r"))
    return left.select("idx", F.col("value").alias("l")).join(F.broadcast(one), "idx")


def equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row, column equal: same length and equal elements, where NaN equals nothing."""
    a = left.select("idx", F.col("value").alias("l"))
    b = right.select("idx", F.col("value").alias("r"))
    same = F.col("l") == F.col("r")
    if dict(left.dtypes)["value"] in ("float", "double"):
        same = same & ~F.isnan("l")
    met = a.join(b, "idx", "full_outer")
    return met.agg(F.coalesce(F.bool_and(F.coalesce(same, F.lit(False))), F.lit(True)).alias("equal"))
