import hashlib
import random
import re
import zlib

import duckdb
import numpy as np

from tests.llm.conftest import EDGES, text_of
from tidewheel.llm import line_dedup, queries


def brute(rows):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    order = lambda d: (d is not None, d or 0)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and doc != max(holders[key(x)], key=order))]
        out.append((doc, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    common = [text_of(rng, 9) + " " + "é" * 20 for _ in range(6)] + ["ü" * 39, "ü" * 40, "A" * 40]
    rows = list(EDGES)
    for d in range(n):
        lines = [text_of(rng, rng.randrange(0, 20)) for _ in range(rng.randrange(4))]
        for c in common:
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", " ", "\t"]) + (c if rng.random() < 0.5 else c.upper() if c.isascii() else c) + rng.choice(["", "\r", " \x0b"]))
        rows.append((100 + d, "\n".join(lines)))
    rows += [(None, common[0]), (103, common[1]), (103, common[1] + "\n" + common[2])]
    return rows + [(1000 + i, common[0]) for i in range(200)]


def test_op8_equals_brute_force(spark, make, table):
    rows = corpus()
    found = queries.op8_line_dedup(spark, table(documents=make(rows)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_hot_line_over_many_ranges(spark, make, table):
    """One line in every document, cut into more ranges than it has neighbours."""
    rows = [(i, "the same line in every document of this table, forty code points or more") for i in range(500)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = queries.op8_line_dedup(spark, table(documents=make(rows)))
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmaps(spark, make):
    rows = [(i, "short\n" + "long enough to count as a line of its own, yes" + "\nend") for i in range(6)]
    found = line_dedup.keep_bitmaps(make(rows)).collect()
    assert {r["doc_id"] for r in found} == set(range(5))
    assert all(np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8), count=3).tolist() == [1, 0, 1] for r in found)


def test_sql_agrees_with_brute_force(tmp_path):
    rows = [r for r in corpus(6) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(queries.OP8).fetchall(), key=str) == brute(rows)


def test_empty_table(spark, make, table):
    assert queries.op8_line_dedup(spark, table(documents=make([]))).count() == 0
