import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidewheel import queries as engine
from tidewheel.streaming import running

SF = os.environ.get("TIDEWHEEL_SF", "/root/testdata/sf0.001")


def test_entry(spark):
    if not os.path.isdir(entry.SMOKE):
        pytest.skip("no test tables here")
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and math.isfinite(rows[0]["total"])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plain(v):
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_queries_agree_with_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    found = engine.QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in engine.SQL:
        assert rows
        return
    con = duckdb.connect()
    for table in ("events", "orders", "lineitem", "customer", "nation", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    expected = con.sql(engine.SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    order = sorted(found.columns)
    at = [expected.columns.index(c) for c in order]
    assert sorted(tuple(_plain(r[c]) for c in order) for r in rows) == sorted(tuple(_plain(r[i]) for i in at) for r in expected.fetchall())


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(i)) for i in range(300)]
    spark.createDataFrame(rows, "id long, at string, v double").selectExpr("id", "cast(at as timestamp) AS at", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp, v double").parquet(str(tmp_path / "in"))
    out = running.windowed_sum(running.mapped(stream, "v", lambda c: c * 2, "f64"), "at", "v", "1 minute", "10 seconds")
    query = out.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    found = {r["start"].minute: (r["total"], r["n"]) for r in spark.table("sums").collect()}
    assert found == {m: (2.0 * sum(range(60 * m, 60 * m + 60)), 60) for m in range(5)}


def test_without_the_training_data_operators(tmp_path):
    """The rest works when their subpackage and the pipeline are gone."""
    repo = Path(entry.__file__).parent
    shutil.copytree(repo / "tidewheel", tmp_path / "tidewheel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
