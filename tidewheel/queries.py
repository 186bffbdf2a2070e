"""The engine's queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import series as S
from tidewheel.functions import dtypes as D
from tidewheel.operators import tabular
from tidewheel.operators.sums import partials
from tidewheel.sources.shared import fresh_path
from tidewheel.tensor import Tensor


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, value: str = "value") -> S.Series:
    return S.from_dataframe(_table(spark, sf_dir, "events"), value, idx="event_id")


def _orders_like_events(spark: SparkSession, sf_dir: str, value: str = "o_totalprice") -> S.Series:
    """As many orders as there are events, so that the two can be combined."""
    n = _table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    orders = _table(spark, sf_dir, "orders")
    fewer = orders.where(F.col("o_orderkey") < n.scalar())
    return S.from_dataframe(fewer, value, idx="o_orderkey")


def _lines(spark: SparkSession, sf_dir: str, value, dtype=None) -> S.Series:
    """A column of lineitem for sums, which do not depend on the order."""
    return S.from_dataframe(_table(spark, sf_dir, "lineitem"), value, idx="l_orderkey", dtype=dtype)


def _total(series: S.Series, name: str = "total") -> DataFrame:
    return series.sum().to_df().select(F.col("value").alias(name))


def _integral(spark, sf_dir, column="l_quantity"):
    """An integer-valued double column as i64: its sum is exact in any order."""
    return _lines(spark, sf_dir, F.col(column).cast("long"))


def source_series(spark, sf_dir):
    return _events(spark, sf_dir).to_df()


def generate_squares(spark, sf_dir):
    return S.generate(1000, lambda i: i * i, "i64", spark).to_df()


def zeros(spark, sf_dir):
    return S.zeros(100, "f64", spark).to_df()


def map_affine(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda x: x * 2.0 + 1.0).to_df()


def map_changes_type(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda x: D.saturating_cast(F.floor(x * 10.0).cast("double"), "i64"), "i64").to_df()


def mul_scalar(spark, sf_dir):
    return (S.from_dataframe(_table(spark, sf_dir, "orders"), "o_totalprice", idx="o_orderkey") * 1.5).to_df()


def zip_add(spark, sf_dir):
    return (_events(spark, sf_dir) + _orders_like_events(spark, sf_dir)).to_df()


def zip_sub(spark, sf_dir):
    return (_orders_like_events(spark, sf_dir) - _events(spark, sf_dir)).to_df()


def zip_mul(spark, sf_dir):
    return (_events(spark, sf_dir) * _orders_like_events(spark, sf_dir)).to_df()


def zip_with_mixed(spark, sf_dir):
    return _events(spark, sf_dir).zip_with(_events(spark, sf_dir, "user_id"), lambda a, b: a + b.cast("double"), "f64").to_df()


def map_after_zip(spark, sf_dir):
    both = _events(spark, sf_dir, "event_id") + _orders_like_events(spark, sf_dir, "o_custkey")
    return both.map(lambda x: x * 10).to_df()


def same_lineage_zip(spark, sf_dir):
    events = _events(spark, sf_dir)
    return (events.map(lambda x: x * 2.0) - events).to_df()


def slice_window(spark, sf_dir):
    return _events(spark, sf_dir).slice(100, 100).to_df()


def point_update(spark, sf_dir):
    return _events(spark, sf_dir).set_at(0, 9.0).to_df()


def length(spark, sf_dir):
    return _events(spark, sf_dir).to_df().agg(F.count("*").alias("n"))


def equality(spark, sf_dir):
    return _events(spark, sf_dir).equals(_events(spark, sf_dir))


def sum_int(spark, sf_dir):
    return _lines(spark, sf_dir, "l_linenumber").wide_sum().select(F.col("value").alias("total"))


def sum_exact_float(spark, sf_dir):
    return _integral(spark, sf_dir).sum().map(lambda x: x.cast("double"), "f64").to_df().select(F.col("value").alias("total"))


def sum_decimal(spark, sf_dir):
    cents = _lines(spark, sf_dir, F.round(F.col("l_extendedprice") * 100).cast("long"))
    return cents.sum().to_df().select((F.col("value").cast("decimal(20,0)") / 100).cast("decimal(38,2)").alias("total"))


def sum_empty(spark, sf_dir):
    none = S.from_dataframe(_table(spark, sf_dir, "events").where("event_id < 0"), "value", idx="event_id")
    return _total(none)


def sum_then_map(spark, sf_dir):
    return _integral(spark, sf_dir).sum().map(lambda t: t.cast("double") / 10.0, "f64").to_df().select(F.col("value").alias("mean10"))


def reductions_compose(spark, sf_dir):
    ones = S.from_dataframe(_table(spark, sf_dir, "orders"), F.lit(1).cast("long"), idx="o_orderkey")
    both = _integral(spark, sf_dir).sum() - ones.sum()
    return both.to_df().select(F.col("value").cast("double").alias("diff"))


def sum_after_zip(spark, sf_dir):
    """Two columns of one table zipped by position, then summed; rows are placed by all their keys."""
    lines = _table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    quantity, number = (S.from_dataframe(lines, F.col(c).cast("long"), order_by=order) for c in ("l_quantity", "l_linenumber"))
    return (quantity + number).sum().map(lambda t: t.cast("double"), "f64").to_df().select(F.col("value").alias("total"))


def batch_partials(spark, sf_dir):
    cents = F.col("value").cast("decimal(18,2)").alias("value")
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), cents)
    return partials(events, 512).select("batch_id", F.col("partial").cast("decimal(38,2)").alias("partial"))


def sink_scan_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "roundtrip") + ".f64"
    _events(spark, sf_dir).sink_file(path)
    return S.scan_file(path, "f64", spark).to_df()


def deterministic_sum(spark, sf_dir):
    return _total(_events(spark, sf_dir).map(lambda x: x * 1.0001).with_batch_bytes(4096))


def ordered_by_key(spark, sf_dir):
    return S.from_dataframe(_table(spark, sf_dir, "customer"), "c_acctbal", order_by=["c_custkey"]).to_df()


def generate_udf(spark, sf_dir):
    return S.generate_python(1000, lambda i: (i * 7919) % 1009, "i64", spark).to_df()


def top_values(spark, sf_dir):
    return tabular.top(_events(spark, sf_dir), 20)


def group_sums(spark, sf_dir):
    return tabular.group_sum(_events(spark, sf_dir, "user_id"), _events(spark, sf_dir, "event_id"))


def wrapping_sum(spark, sf_dir):
    return _lines(spark, sf_dir, F.col("l_partkey") % 128, "u8").wide_sum(wrap=True).select(F.col("value").cast("int").alias("total"))


def collected_then_lazy(spark, sf_dir):
    """A collected tensor as the source of another plan."""
    return _events(spark, sf_dir).map(lambda x: x + 1.0).collect().lazy(spark).map(lambda x: x * 2.0).to_df()


def item_of_sum(spark, sf_dir):
    total = _integral(spark, sf_dir).sum().item()
    return S.from_elements([total], "i64", spark).to_df().select(F.col("value").cast("double").alias("total"))


def numpy_map(spark, sf_dir):
    return _events(spark, sf_dir).map_numpy(lambda v: np.floor(v * 2.0)).to_df()


def reinterpreted_bytes(spark, sf_dir):
    path = fresh_path(spark, "bytes") + ".i64"
    _events(spark, sf_dir, "event_id").sink_file(path)
    return S.scan_file(path, "i64", spark).reinterpret("u8").to_df()


def spilled_twice(spark, sf_dir):
    kept = _events(spark, sf_dir).map(lambda x: x * 3.0).spill()
    return (kept + kept.map(lambda x: x - 1.0)).to_df()


def wrapping_add(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    a, b = (S.from_dataframe(orders, F.col(c) % 256, idx="o_orderkey", dtype="u8") for c in ("o_custkey", "o_orderkey"))
    return a.wrapping_add(b).to_df().select("idx", F.col("value").cast("int").alias("value"))


def sorted_values(spark, sf_dir):
    return tabular.sort(_events(spark, sf_dir)).to_df()


def filtered_values(spark, sf_dir):
    return tabular.filtered(_events(spark, sf_dir), lambda v: v > 50.0).to_df()


def joined_values(spark, sf_dir):
    nations = S.from_dataframe(_table(spark, sf_dir, "nation"), "n_nationkey", order_by=["n_name"])
    suppliers = S.from_dataframe(_table(spark, sf_dir, "supplier"), "s_nationkey", order_by=["s_suppkey"])
    return tabular.join_on_value(nations, suppliers)


def eager_arithmetic(spark, sf_dir):
    a, b = Tensor.from_fn(1000, lambda i: i * 0.5), Tensor.from_elements(range(1000), "f64")
    return ((a + b) * (a - b) * 2.0).map(lambda v: v + 1.0).lazy(spark).to_df()


_PAIRS = "FROM events e JOIN orders o ON e.event_id = o.o_orderkey"

#: Batches of 512 elements, each one span or two; a span adds whole groups of 8 into 8 lanes, folds the lanes from zero,
#: then the elements left over; batches fold from zero in order.
_ORDERED_SUM = """
WITH elements AS (
  SELECT event_id // 512 AS b, event_id % 512 AS k, value * CAST(1.0001 AS DOUBLE) AS x,
    count(*) OVER (PARTITION BY event_id // 512) AS n FROM events),
halved AS (SELECT *, CASE WHEN n > 256 THEN (n // 2 + 7) // 8 * 8 ELSE n END AS cut FROM elements),
spans AS (
  SELECT b, x, CASE WHEN k < cut THEN 0 ELSE 1 END AS span, CASE WHEN k < cut THEN k ELSE k - cut END AS k,
    CASE WHEN k < cut THEN cut ELSE n - cut END AS m FROM halved),
lanes AS (
  SELECT b, span, k % 8 AS place, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(x ORDER BY k)), lambda p, q: p + q) AS x
  FROM spans WHERE k < m - m % 8 GROUP BY ALL),
folded AS (SELECT * FROM lanes UNION ALL SELECT b, span, k + 8 AS place, x FROM spans WHERE k >= m - m % 8),
summed AS (
  SELECT b, span, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(x ORDER BY place)), lambda p, q: p + q) AS x
  FROM folded GROUP BY b, span),
batches AS (SELECT b, list_reduce(list(x ORDER BY span), lambda p, q: p + q) AS x FROM summed GROUP BY b)
SELECT list_reduce(list_prepend(CAST(0 AS DOUBLE), list(x ORDER BY b)), lambda p, q: p + q) AS total FROM batches
"""

SQL = {
    "source_series": "SELECT event_id AS idx, value FROM events",
    "generate_squares": "SELECT CAST(i AS BIGINT) AS idx, CAST(i * i AS BIGINT) AS value FROM range(1000) t(i)",
    "zeros": "SELECT CAST(i AS BIGINT) AS idx, CAST(0 AS DOUBLE) AS value FROM range(100) t(i)",
    "map_affine": "SELECT event_id AS idx, value * CAST(2 AS DOUBLE) + CAST(1 AS DOUBLE) AS value FROM events",
    "map_changes_type": "SELECT event_id AS idx, CAST(floor(value * CAST(10 AS DOUBLE)) AS BIGINT) AS value FROM events",
    "mul_scalar": "SELECT o_orderkey AS idx, o_totalprice * CAST(1.5 AS DOUBLE) AS value FROM orders",
    "zip_add": f"SELECT e.event_id AS idx, e.value + o.o_totalprice AS value {_PAIRS}",
    "zip_sub": f"SELECT e.event_id AS idx, o.o_totalprice - e.value AS value {_PAIRS}",
    "zip_mul": f"SELECT e.event_id AS idx, e.value * o.o_totalprice AS value {_PAIRS}",
    "zip_with_mixed": "SELECT event_id AS idx, value + CAST(user_id AS DOUBLE) AS value FROM events",
    "map_after_zip": f"SELECT e.event_id AS idx, (e.event_id + o.o_custkey) * 10 AS value {_PAIRS}",
    "same_lineage_zip": "SELECT event_id AS idx, value * CAST(2 AS DOUBLE) - value AS value FROM events",
    "slice_window": "SELECT event_id - 100 AS idx, value FROM events WHERE event_id >= 100 AND event_id < 200",
    "point_update": "SELECT event_id AS idx, CASE WHEN event_id = 0 THEN CAST(9 AS DOUBLE) ELSE value END AS value FROM events",
    "length": "SELECT count(*) AS n FROM events",
    "equality": "SELECT bool_and(a.value = b.value AND NOT isnan(a.value)) AS equal FROM events a JOIN events b USING (event_id)",
    "sum_int": "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem",
    "sum_exact_float": "SELECT sum(l_quantity) AS total FROM lineitem",
    "sum_decimal": "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM lineitem",
    "sum_empty": "SELECT coalesce(sum(value), CAST(0 AS DOUBLE)) AS total FROM events WHERE event_id < 0",
    "sum_then_map": "SELECT sum(l_quantity) / CAST(10 AS DOUBLE) AS mean10 FROM lineitem",
    "reductions_compose": "SELECT (SELECT sum(l_quantity) FROM lineitem) - (SELECT CAST(count(*) AS DOUBLE) FROM orders) AS diff",
    "sum_after_zip": "SELECT sum(l_quantity + CAST(l_linenumber AS DOUBLE)) AS total FROM lineitem",
    "batch_partials": "SELECT event_id // 512 AS batch_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS partial FROM events GROUP BY 1",
    "sink_scan_roundtrip": "SELECT event_id AS idx, value FROM events",
    "deterministic_sum": _ORDERED_SUM,
    "collected_then_lazy": "SELECT event_id AS idx, (value + CAST(1 AS DOUBLE)) * CAST(2 AS DOUBLE) AS value FROM events",
    "item_of_sum": "SELECT sum(l_quantity) AS total FROM lineitem",
    "numpy_map": "SELECT event_id AS idx, floor(value * CAST(2 AS DOUBLE)) AS value FROM events",
    "reinterpreted_bytes": "SELECT event_id * 8 + k AS idx, CAST((event_id >> (8 * k)) & 255 AS SMALLINT) AS value FROM events, range(8) t(k)",
    "spilled_twice": "SELECT event_id AS idx, value * CAST(3 AS DOUBLE) + (value * CAST(3 AS DOUBLE) - CAST(1 AS DOUBLE)) AS value FROM events",
    "wrapping_add": "SELECT o_orderkey AS idx, CAST((o_custkey % 256 + o_orderkey % 256) % 256 AS INTEGER) AS value FROM orders",
    "sorted_values": "SELECT row_number() OVER (ORDER BY value) - 1 AS idx, value FROM events",
    "filtered_values": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value FROM events WHERE value > 50",
    "joined_values": """
        WITH n AS (SELECT n_nationkey AS value, row_number() OVER (ORDER BY n_name, n_nationkey) - 1 AS left_idx FROM nation),
        s AS (SELECT s_nationkey AS value, row_number() OVER (ORDER BY s_suppkey, s_nationkey) - 1 AS right_idx FROM supplier)
        SELECT value, left_idx, right_idx FROM n JOIN s USING (value)""",
    "eager_arithmetic": """
        SELECT CAST(i AS BIGINT) AS idx, (a + b) * (a - b) * CAST(2 AS DOUBLE) + CAST(1 AS DOUBLE) AS value
        FROM (SELECT i, CAST(i AS DOUBLE) * CAST(0.5 AS DOUBLE) AS a, CAST(i AS DOUBLE) AS b FROM range(1000) t(i))""",
    "ordered_by_key": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_acctbal AS value FROM customer",
    "generate_udf": "SELECT CAST(i AS BIGINT) AS idx, CAST((i * 7919) % 1009 AS BIGINT) AS value FROM range(1000) t(i)",
    "top_values": "SELECT event_id AS idx, value FROM events ORDER BY value DESC, event_id LIMIT 20",
    "group_sums": "SELECT user_id AS key, CAST(sum(event_id) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY user_id",
    "wrapping_sum": "SELECT CAST(sum(l_partkey % 128) % 256 AS INTEGER) AS total FROM lineitem",
}

_ALL = (
    source_series, generate_squares, zeros, map_affine, map_changes_type, mul_scalar, zip_add, zip_sub, zip_mul, zip_with_mixed,
    map_after_zip, same_lineage_zip, slice_window, point_update, length, equality, sum_int, sum_exact_float, sum_decimal, sum_empty,
    sum_then_map, reductions_compose, sum_after_zip, batch_partials, sink_scan_roundtrip, deterministic_sum, ordered_by_key,
    generate_udf, top_values, group_sums, wrapping_sum, collected_then_lazy, item_of_sum, numpy_map, reinterpreted_bytes,
    spilled_twice, wrapping_add, sorted_values, filtered_values, joined_values, eager_arithmetic,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and orders combined position by position, mapped, and summed in a fixed order."""
    both = _events(spark, sf_dir) + _orders_like_events(spark, sf_dir)
    return _total(both.map(lambda x: x * 2.0))
