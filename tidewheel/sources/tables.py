"""Ordered columns of tables as series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.plans.nodes import TableColumn
from tidewheel.sources.shared import stored

#: Rows of a driver-made table up to which a join may broadcast it.
BROADCAST_ROWS = 20_000


def positioned(df: DataFrame, keys: list[Column], values: list[Column], descending: bool = False) -> DataFrame:
    """(idx, v0, v1 ...): values in the (ascending or descending) order of keys, with positions from 0 and no gaps.

    The rows are range-partitioned and sorted, and each partition's rows are numbered after
    those before it, so no task sees all rows. Ties in the keys are broken by the values, the first one first; rows
    that are equal in all cannot be told apart. The rows are written and counted when this is called.
    """
    names = [f"v{i}" for i in range(len(values))]
    flat = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], *[v.alias(n) for v, n in zip(values, names, strict=True)])
    order = [F.col(c).desc() if descending else F.col(c) for c in (*(f"k{i}" for i in range(len(keys))), *names)]
    local = flat.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("m"), *names)
    held = stored(local.select(F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at"), *names), "positions")
    counts = sorted(tuple(r) for r in held.groupBy("part").agg(F.count("*")).collect())  # one row a partition
    base, before = [], 0
    for part, n in counts:
        base.append((part, before))
        before += n
    bases = df.sparkSession.createDataFrame(base, "part long, base long")
    return held.join(F.broadcast(bases) if len(base) <= BROADCAST_ROWS else bases, "part").select((F.col("base") + F.col("at")).alias("idx"), *names)


def of_column(table: TableColumn) -> DataFrame:
    """(idx, value) of a table's column; the key of a dense one already counts 0, 1, 2 ... and is taken as it is."""
    if table.dense:
        return table.df.select(table.keys[0].cast("long").alias("idx"), table.value.alias("value"))
    return positioned(table.df, table.keys, [table.value], table.descending).withColumnRenamed("v0", "value")


def side_by_side(left: TableColumn, right: TableColumn) -> DataFrame:
    """(idx, v0, v1) of two columns of one table in one order, row by row."""
    values = [left.value, right.value]
    if left.dense:
        return left.df.select(left.keys[0].cast("long").alias("idx"), *(v.alias(f"v{i}") for i, v in enumerate(values)))
    return positioned(left.df, left.keys, values, left.descending)
