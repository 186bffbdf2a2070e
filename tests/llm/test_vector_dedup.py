import duckdb
import numpy as np
import pyarrow as pa

from tidewheel.llm import queries, vector_dedup


def vectors(seed=4, n=400, dim=64):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(n):
        base = rng.normal(size=dim)
        for k in range(int(rng.choice([1, 1, 1, 2, 6]))):
            noise = rng.normal(size=dim) * rng.choice([0, 0.15, 0.3, 0.35, 0.5])
            rows.append((i, [float(np.float32(v)) for v in base + noise * (k > 0)], int(rng.integers(0, 2)) if k % 3 == 2 else 1))
            i += 1
    hot = rng.normal(size=dim).astype(np.float32).astype(float).tolist()
    rows += [(i + k, hot, 0) for k in range(150)]
    rows += [(i + 200 + k, (np.array(hot) + rng.normal(size=dim) * 0.05).astype(np.float32).astype(float).tolist(), 0) for k in range(60)]
    rows += [(90001, None, 1), (90002, [0.0] * dim, 1), (90003, [float("nan")] * dim, 1), (90004, [None, *hot[1:]], 0), (90005, hot, None), (90006, [], 1), (None, hot, 0), (None, None, None), (90007, [2 * v for v in hot], 0), (90008, hot[:3], 0), (90009, hot[:3], 0), (90008, hot[:3], 0)]
    return rows


def brute(rows, threshold=0.93):
    ok = [r[1] is not None and len(r[1]) > 0 and r[2] is not None and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]
    links = {i: set() for i in range(len(rows))}
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if o else None for r, o in zip(rows, ok, strict=True)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    seen, out = set(), []
    for i in links:
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        out += [(rows[j][0], len(links[j]), min(ids, default=None), rows[j][0] is not None and rows[j][0] == min(ids)) for j in group]
    return out


def test_op10_against_brute_force(spark, table):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS m", "'x' AS n_links").repartition(3)
    found = [tuple(r) for r in queries.op10_embedding_dedup(spark, table(embeddings=df)).collect()]
    expected = brute(rows)
    links, hits = sum(r[1] for r in expected), sum(r[1] for r in found)
    assert len(found) == len(expected) and 0.99 * links <= hits <= links
    same = set(map(str, found)) & set(map(str, expected))
    assert len(same) >= 0.99 * len(set(map(str, expected)))


def test_few_dimensions_miss_nothing_and_pieces_agree(spark, table, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).astype(np.float32).astype(float).tolist(), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    expected = sorted(map(str, brute(rows, 0.99)))
    for members, asks, cell in ((4096, 32768, 2048), (4096, 32768, 10), (16, 8, 40)):
        for name, value in (("MEMBERS", members), ("QUERIES", asks), ("CELL", cell)):
            monkeypatch.setattr(vector_dedup, name, value)
        found = vector_dedup.link(df, 0.99).selectExpr("vec_id", "n_links", "component_id", "vec_id = component_id").collect()
        assert sorted(str(tuple(r)) for r in found) == expected


def test_recall_on_twenty_thousand_vectors(spark):
    """Groups of near copies over several cells of a label: links as brute force has them."""
    rng = np.random.default_rng(12)
    sizes = rng.choice([1, 1, 1, 2, 3, 8, 40], size=3600)
    sizes[0] = 900
    base = np.repeat(rng.normal(size=(len(sizes), 48)), sizes, axis=0)
    x = (base + rng.normal(size=base.shape) * rng.choice([0.05, 0.15, 0.25, 0.3], size=(len(base), 1))).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    assert len(x) >= 20_000
    rows = pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 48).cast(pa.list_(pa.float32())), "label": pa.array(label)})
    found = vector_dedup.link(spark.createDataFrame(rows)).toPandas().set_index("vec_id")["n_links"].to_numpy()
    links = np.zeros(len(x), dtype=np.int64)
    for own in (np.flatnonzero(label == k) for k in (0, 1)):
        u = vector_dedup.unit(x[own].astype(float))
        for at in range(0, len(own), 1000):
            links[own[at : at + 1000]] = (u[at : at + 1000] @ u.T >= vector_dedup.THRESHOLD).sum(axis=1) - 1
    assert links.sum() > 100_000 and (found <= links).all() and found.sum() >= 0.98 * links.sum()


def test_empty_table(spark, table):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert queries.op10_embedding_dedup(spark, table(embeddings=df)).count() == 0


def test_sql_agrees_with_brute_force():
    rows = [r for r in vectors(5, 60, 16) if r[0] is not None and (not r[1] or len(r[1]) == 16)]
    rows = list({r[0]: r for r in rows}.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(map(str, con.sql(queries.OP10).fetchall())) == sorted(map(str, brute(rows)))
