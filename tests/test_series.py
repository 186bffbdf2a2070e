import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel import series as S
from tidewheel.errors import EngineError, LengthMismatch, OutOfBounds, Overflow, SinkIntoSource, SourceError
from tidewheel.functions import dtypes as D
from tidewheel.operators import tabular
from tidewheel.tensor import Tensor


def count(n, dtype="f64", f=lambda i: i):
    return S.generate(n, f, dtype)


def values(series):
    return series.collect().to_list()


def test_collect_is_in_order(spark):
    assert values(count(1000)) == list(map(float, range(1000)))
    assert values(count(100).map(lambda x: x + 1).with_batch_bytes(8)) == [i + 1.0 for i in range(100)]
    assert values(count(3, "u64").with_batch_bytes(0)) == [0, 1, 2]


def test_map_changes_type(spark):
    found = count(4).map(lambda x: D.saturating_cast(x * 10, "i64"), "i64").collect()
    assert found.dtype is D.I64 and found.to_list() == [0, 10, 20, 30]


def test_python_and_numpy_maps(spark):
    assert values(count(5, "i32").map_python(lambda v: v * v)) == [0, 1, 4, 9, 16]
    assert values(count(5).map_numpy(np.sqrt)) == [math.sqrt(i) for i in range(5)]
    assert values(S.generate_python(4, lambda i: 2**64 - 1 - i, "u64")) == [2**64 - 1 - i for i in range(4)]


def test_sums(spark):
    assert count(100, "u64").sum().with_batch_bytes(8).item() == 4950
    assert count(10).sum().map(lambda t: t / 10).item() == 4.5
    assert count(10_000, f=lambda i: i % 7).with_batch_bytes(256).sum().item() == sum(i % 7 for i in range(10_000))
    assert count(0).sum().item() == 0.0 and values(count(0)) == [] and count(0).is_empty()
    assert (count(10).sum() - count(10, f=lambda i: F.lit(1.0)).sum()).item() == 35.0
    assert S.from_elements([-0.0, -0.0]).sum().item() == 0.0 and math.copysign(1, S.from_elements([-0.0]).sum().item()) == 1
    assert S.from_elements([100, 27], "i8").sum().item() == 127
    with pytest.raises(EngineError):
        S.from_elements([100, 28], "i8").sum().item()
    assert S.from_elements([100, 28], "i8").wide_sum().first()["value"] == 128
    assert S.from_elements([100, 28], "i8").wide_sum(wrap=True).first()["value"] == -128


def pairwise(x):
    """The order of additions, written element by element."""
    if len(x) > 256:
        mid = -(-(len(x) // 2) // 8) * 8
        return pairwise(x[:mid]) + pairwise(x[mid:])
    lanes = [x.dtype.type(0)] * 8
    whole = len(x) - len(x) % 8
    for i in range(whole):
        lanes[i % 8] = lanes[i % 8] + x[i]
    total = x.dtype.type(0)
    for v in [*lanes, *x[whole:]]:
        total = total + v
    return total


def batched(x, sizes):
    total, now, start = x.dtype.type(0), None, 0
    for i in range(len(x) + 1):
        b = sum(i // k for k in sizes) if i < len(x) else None
        if b != now:
            if now is not None:
                total = total + pairwise(x[start:i])
            now, start = b, i
    return total


@pytest.mark.parametrize("kind", ["f64", "f32"])
def test_float_sums_have_the_same_bits_however_partitioned(spark, kind):
    n, size = 5000, D.dtype(kind).width
    plan = count(n, kind, lambda i: F.lit(1.0) / (i + 1)).map(lambda x: x * F.lit(1.0001).cast(D.dtype(kind).spark))
    x = plan.collect().as_slice()
    expected = batched(x, [1000 // size])
    df = plan.to_df()
    for parts in (1, 3, 7):
        shuffled = S.from_dataframe(df.repartition(parts, "value"), "value", idx="idx", dtype=kind).with_batch_bytes(1000)
        assert np.float64(shuffled.sum().item()).tobytes() == np.float64(expected).tobytes()
    assert np.float64(plan.with_batch_bytes(1000).sum().item()).tobytes() == np.float64(expected).tobytes()


def test_batches_of_a_zip_end_where_either_side_does(spark):
    a = S.from_elements(np.random.default_rng(1).normal(size=1000))
    b = S.from_elements(np.random.default_rng(2).normal(size=1000).astype(np.float32))
    both = a.zip_with(b, lambda x, y: x + y.cast("double")).with_batch_bytes(96)
    x = both.collect().as_slice()
    assert both.sum().item() == batched(x, [12, 24])


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 255, 256, 257, 1000, 4096])
def test_pairwise_sum_is_the_documented_order(n):
    x = np.random.default_rng(n).normal(size=n)
    assert Tensor.from_elements(x, "f64").sum() == (pairwise(x) if n else 0.0)
    assert Tensor.from_elements(np.arange(1, n + 1), "u64").sum() == n * (n + 1) // 2


def test_zips(spark):
    a, b = count(1000, f=lambda i: i % 13), count(1000, f=lambda i: i % 7)
    x, y = np.arange(1000) % 13, np.arange(1000) % 7
    assert values((a + b).with_batch_bytes(64)) == (x + y).tolist()
    assert values(a - b) == (x - y).tolist() and values(a * b) == (x * y).tolist()
    assert values(count(100).zip_with(count(100, "u8"), lambda p, q: p + q)) == [2.0 * i for i in range(100)]
    assert values((count(4, "i64") + count(4, "i64")).map(lambda v: v * 10)) == [0, 20, 40, 60]
    assert values(count(0) + count(0)) == []
    same = count(50)
    assert values(same.map(lambda v: v * 3) - same) == [2.0 * i for i in range(50)]
    assert "Join" not in (same.map(lambda v: v * 3) - same).to_df()._jdf.queryExecution().toString()
    with pytest.raises(TypeError):
        count(3, "i32") + count(3, "i64")


@pytest.mark.parametrize("n,m", [(5, 7), (7, 5), (1, 0), (0, 1)])
def test_lengths_must_agree_when_the_plan_runs(spark, n, m):
    plan = (count(n) + count(m)).map(lambda x: x * 2)  # building it is no error
    for run in (plan.collect, plan.count, lambda: plan.sum().item()):
        with pytest.raises(LengthMismatch):
            run()


def test_settings_of_a_zip(spark):
    a, b = count(3).with_batch_bytes(100).with_parallelism(2), count(3).with_batch_bytes(50).with_parallelism(0)
    assert (a + b).batch_bytes == 50 and (a + b).parallelism == 2
    assert (count(3).with_batch_bytes(10**9) + count(3)).batch_bytes == S.DEFAULT_BATCH_BYTES


def test_slices_updates_and_equality(spark):
    plan = count(100)
    assert values(plan.slice(10, 5)) == [10.0, 11.0, 12.0, 13.0, 14.0] and values(plan.slice(10, 5).slice(1, 2)) == [11.0, 12.0]
    assert values(plan.set_at(3, 9.0).slice(2, 3)) == [2.0, 9.0, 4.0] and values(plan.slice(3, 1)) == [3.0]
    assert plan.equals(count(100)).first()["equal"] and not plan.equals(plan.set_at(5, 1.0)).first()["equal"]
    assert not plan.equals(count(99)).first()["equal"] and count(0).equals(count(0)).first()["equal"]
    nan = S.from_elements([float("nan")])
    assert not nan.equals(nan).first()["equal"]
    with pytest.raises(IndexError):
        plan.slice(-1, 2)


def test_item_and_failures_in_closures(spark):
    with pytest.raises(ValueError):
        count(2).item()
    with pytest.raises(EngineError):
        count(100).map_python(lambda v: v if v < 50 else 1 / 0).collect()


def test_explain(spark):
    plan = (count(3).map(lambda x: x) + S.scan_file("/no/such/file")).sum()
    assert plan.explain().splitlines() == ["sum", "└─ add", "   ├─ map", "   │  └─ generate 3 (f64)", "   └─ scan_file /no/such/file (f64)"]
    assert "\n" not in repr(plan)


def test_scalar_multiplication_spill_and_reuse(spark):
    plan = count(10).spill()
    assert values(plan * 1.5) == [1.5 * i for i in range(10)] and values(plan) == list(map(float, range(10)))


# files


def write(path, x):
    path.write_bytes(np.asarray(x).tobytes())
    return str(path)


def test_files_round_trip(spark, tmp_path):
    source, sink = write(tmp_path / "a.f64", np.arange(5000.0)), str(tmp_path / "b.f64")
    assert S.scan_file(source).map(lambda x: x * 2).with_batch_bytes(1024).sum().item() == 2 * sum(range(5000))
    S.scan_file(source).map(lambda x: x + 0.5).with_batch_bytes(512).sink_file(sink)
    assert np.array_equal(np.fromfile(sink), np.arange(5000) + 0.5)
    assert values(S.scan_file(sink).slice(10, 2)) == [10.5, 11.5]
    both = S.scan_file(source) + S.scan_file(sink)
    assert "Join" not in both.to_df()._jdf.queryExecution().toString()
    assert np.array_equal(both.collect().as_slice(), 2 * np.arange(5000) + 0.5)
    assert sorted(os.listdir(tmp_path)) == ["a.f64", "b.f64"]


@pytest.mark.parametrize("name", list(D.DTYPES))
def test_every_type_round_trips(spark, tmp_path, name):
    kind = D.DTYPES[name]
    if kind.is_float:
        x = [0.0, -1.5, 2.0**60]
    else:
        x = [0, 1, 99, max(kind.low, -D.DECIMAL_MOST), min(kind.high, D.DECIMAL_MOST)]
    path = str(tmp_path / name)
    S.from_elements(x, name).sink_file(path)
    assert os.path.getsize(path) == len(x) * kind.width
    assert values(S.scan_file(path, name)) == x


def test_missing_short_and_empty_files(spark, tmp_path):
    missing = S.scan_file(str(tmp_path / "missing"))
    with pytest.raises(SourceError):
        missing.collect()
    with pytest.raises(SourceError):
        S.scan_file(write(tmp_path / "short", np.zeros(5, np.uint8))).collect()
    empty = write(tmp_path / "empty", np.zeros(0))
    assert values(S.scan_file(empty)) == [] and S.scan_file(empty).sum().item() == 0.0
    S.scan_file(empty).sink_file(str(tmp_path / "still-empty"))
    assert os.path.getsize(tmp_path / "still-empty") == 0
    with pytest.raises(LengthMismatch):
        (S.scan_file(empty) + S.scan_file(write(tmp_path / "one", np.zeros(1)))).collect()


def test_sinks_never_overwrite_a_source(spark, tmp_path):
    a, b = write(tmp_path / "a", [1.0]), write(tmp_path / "b", [2.0])
    os.link(a, tmp_path / "hard")
    os.symlink(a, tmp_path / "soft")
    plan = S.scan_file(b).map(lambda x: x) + S.scan_file(a)
    for target in ("a", "b", "hard", "soft"):
        with pytest.raises(SinkIntoSource):
            plan.sink_file(str(tmp_path / target))
    assert struct.unpack("<d", open(a, "rb").read()) == (1.0,)


def test_a_failed_sink_leaves_the_old_file(spark, tmp_path):
    old = write(tmp_path / "old", [7.0])
    with pytest.raises(EngineError):
        count(1000).map_python(lambda v: v if v < 900 else 1 / 0).sink_file(old)
    assert np.fromfile(old).tolist() == [7.0] and os.listdir(tmp_path) == ["old"]


def test_reinterpret(spark, tmp_path):
    path = write(tmp_path / "f", np.array([1.0, 2.0]))
    assert values(S.scan_file(path).reinterpret("u8")) == list(np.array([1.0, 2.0]).tobytes())
    with pytest.raises(TypeError):
        count(3).reinterpret("u8")


# types and tables


def test_checked_and_wrapping_arithmetic(spark):
    for kind, a, b in (("i8", 127, 1), ("u8", 255, 1), ("u16", 65535, 2), ("i32", 2**31 - 1, 1), ("u32", 2**32 - 1, 5), ("i64", 2**63 - 1, 1), ("u64", 2**64 - 1, 3), ("u64", 2**40, 2**30)):
        x, y = S.from_elements([a], kind), S.from_elements([b], kind)
        low, span = D.DTYPES[kind].low, 1 << 8 * D.DTYPES[kind].width
        for op, name, f in (("__add__", "wrapping_add", a + b), ("__mul__", "wrapping_mul", a * b), ("__sub__", "wrapping_sub", b - a)):
            left, right = (x, y) if op != "__sub__" else (y, x)
            wrapped = (f - low) % span + low
            assert getattr(left, name)(right).item() == wrapped
            if wrapped == f:
                assert getattr(left, op)(right).item() == f
            else:
                with pytest.raises(EngineError):
                    getattr(left, op)(right).item()


def test_saturating_casts_and_divisions(spark):
    x = S.from_elements([float("nan"), 1e30, -1e30, 2.9, -2.9, float("inf")])
    assert values(x.map(lambda v: D.saturating_cast(v, "i64"), "i64")) == [0, 2**63 - 1, -(2**63), 2, -2, 2**63 - 1]
    assert values(x.map(lambda v: D.saturating_cast(v, "u8"), "u8")) == [0, 255, 0, 2, 0, 255]
    z = S.from_elements([1.0, -1.0, 0.0, 4.0]).zip_with(S.from_elements([0.0, 0.0, 0.0, 2.0]), D.ieee_div)
    assert str(values(z)) == "[inf, -inf, nan, 2.0]"
    assert values(S.from_elements([0.5, 1.5, -2.5]).map(D.half_away)) == [1.0, 2.0, -3.0]


def test_tables_as_series(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("1000 - id AS k", "id * 1.5 AS v")
    by_key = S.from_dataframe(df, F.col("v").cast("double"), order_by=["k"])
    assert values(by_key) == [1.5 * (999 - i) for i in range(1000)]
    assert values(tabular.sort(by_key).slice(0, 3)) == [0.0, 1.5, 3.0] and values(tabular.sort(by_key, True).slice(0, 1)) == [1498.5]
    assert [tuple(r) for r in tabular.top(by_key, 2).collect()] == [(0, 1498.5), (1, 1497.0)]
    assert values(tabular.filtered(by_key, lambda v: v < 3.0)) == [1.5, 0.0]
    assert tabular.join_on_value(count(3), count(5)).count() == 3
    assert {tuple(r) for r in tabular.group_sum(count(6, "i64", lambda i: i % 2), count(6, "i64")).collect()} == {(0, 6, 3), (1, 9, 3)}


@pytest.mark.parametrize("made", ["generated", "table", "filtered"])
def test_nothing_reaches_past_the_end(spark, made):
    if made == "generated":
        plan = count(3)
    else:
        df = spark.range(3).selectExpr("id", "cast(id AS double) AS v")
        plan = S.from_dataframe(df, "v", idx="id")
        plan = tabular.filtered(plan, lambda v: v >= 0) if made == "filtered" else plan
    assert values(plan.slice(1, 2)) == [1.0, 2.0] and values(plan.slice(3, 0)) == []
    for wrong in (plan.slice(1, 100), plan.slice(10, 1), plan.slice(4, 0), plan.slice(0, 3).slice(2, 2), plan.slice(10, 1) + plan.sum(), plan.set_at(99, 1.0), plan.set_at(3, 1.0).sum()):
        with pytest.raises(OutOfBounds):
            wrong.collect()
    for wrong in (lambda: plan.slice(-1, 1), lambda: plan.set_at(-1, 1.0)):
        with pytest.raises(IndexError):
            wrong()
    assert values(plan.set_at(2, 7.0)) == [0.0, 1.0, 7.0] and values(plan.slice(2, 1) + plan.sum()) == [5.0]


def test_the_sink_guard_sees_every_source(spark, tmp_path):
    path, other = str(tmp_path / "a.f64"), str(tmp_path / "b.f64")
    count(3).sink_file(path)
    count(3).sink_file(other)
    link = str(tmp_path / "link.f64")
    os.symlink(path, link)
    scanned = S.scan_file(path)
    plans = [
        scanned.set_at(0, 9.0),
        scanned.spill().map(lambda x: x * 2),
        scanned.slice(0, 3).set_at(1, 1.0),
        S.scan_file(other) + scanned.set_at(2, 5.0),
        tabular.sort(scanned),
        tabular.filtered(scanned, lambda v: v > 0),
        S.from_dataframe(scanned.to_df(), "value", idx="idx", reads=[path]),
    ]
    for plan in plans:
        for target in (path, link, f"file://{path}"):
            with pytest.raises(SinkIntoSource):
                plan.sink_file(target)
    assert values(scanned) == [0.0, 1.0, 2.0]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_integers_overflow_loudly_in_any_mode(spark, ansi):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for kind in ("i8", "i32", "i64", "u32", "u64"):
            info = D.dtype(kind)
            top, one = S.from_elements([info.high, 0], kind), S.from_elements([1, 0], kind)
            for plan in (top + one, top * S.from_elements([2, 0], kind), S.from_elements([info.low, 0], kind) - one, (top + one).sum(), S.from_elements([info.high, 1], kind).sum()):
                with pytest.raises(EngineError):
                    plan.collect()
            assert values(top - one)[0] == info.high - 1 and values(top.wrapping_add(one))[0] == info.low
        with pytest.raises(Overflow):
            S.from_elements([300], "i64").map(lambda x: x, "u8").collect()
        with pytest.raises(Overflow):
            S.from_elements([-1], "i64").map(lambda x: x, "u32").collect()
        assert values(S.from_elements([200], "i64").map(lambda x: x, "u8")) == [200]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_parallelism_bounds_the_tasks_of_a_source(spark):
    plan = count(10_000).with_batch_bytes(64)
    assert plan.to_df().rdd.getNumPartitions() > 2
    assert plan.with_threads(2).to_df().rdd.getNumPartitions() == 2
    ninths = plan.map(lambda x: x / 9.0)
    assert ninths.sum().item() == ninths.with_threads(1).sum().item() == ninths.with_threads(3).sum().item()


def test_columns_of_one_table_are_read_together(spark):
    df = spark.range(100).selectExpr("id", "cast(id AS double) AS a", "id * 2 AS b", "id % 7 AS k")
    dense = [S.from_dataframe(df, c, idx="id") for c in ("a", "b")]
    both = dense[0].map(lambda x: x + 1).zip_with(dense[1], lambda x, y: x + y.cast("double"))
    assert "Join" not in both.to_df()._jdf.queryExecution().toString() and values(both) == [3.0 * i + 1 for i in range(100)]
    ordered = [S.from_dataframe(df, c, order_by=[F.col("k"), F.col("id")]) for c in ("a", "b")]
    rows = sorted(range(100), key=lambda i: (i % 7, i))
    assert values(ordered[0].zip_with(ordered[1], lambda x, y: x + y.cast("double"))) == [3.0 * i for i in rows]
    other = S.from_dataframe(df, "a", order_by=[F.col("id")])
    assert values(ordered[0] - other) == [float(i - j) for j, i in enumerate(rows)]
    groups = tabular.group_sum(S.from_dataframe(df, "k", idx="id"), dense[1]).collect()
    assert sorted((r["key"], r["total"], r["n"]) for r in groups) == [(k, sum(2 * i for i in range(100) if i % 7 == k), len(range(k, 100, 7))) for k in range(7)]


def test_sinks_write_in_place_and_leave_nothing_behind(spark, tmp_path):
    path = tmp_path / "deep" / "out.i32"
    many = S.generate(10_000, lambda i: i, "i32", spark).with_batch_bytes(256)
    many.sink_file(f"file://{path}")
    assert np.array_equal(np.fromfile(path, "<i4"), np.arange(10_000)) and os.listdir(path.parent) == ["out.i32"]
    with pytest.raises(EngineError):
        many.map(lambda x: F.when(x == 9_999, F.raise_error(F.lit("no")).cast("int")).otherwise(x)).sink_file(str(path))
    gap = S.from_dataframe(spark.range(10).where("id <> 4"), "id", idx="id")
    with pytest.raises(EngineError):
        gap.sink_file(str(path))
    assert np.array_equal(np.fromfile(path, "<i4"), np.arange(10_000)) and os.listdir(path.parent) == ["out.i32"]
    S.zeros(0, "i32", spark).sink_file(str(path))
    assert os.path.getsize(path) == 0
