import hashlib
import random
import re

import duckdb
import numpy as np

from tests.llm.conftest import EDGES, text_of
from tidewheel.llm import queries, substring_dedup


def brute(rows, window=50):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (doc, _), words in zip(rows, split, strict=True):
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc is not None:
                least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, _), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and least[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    passages = [text_of(rng, n) for n in (49, 50, 51, 80, 300)]
    rows = list(EDGES)
    for d in range(90):
        parts = [text_of(rng, rng.randrange(0, 60)) for _ in range(4)]
        for p in passages:
            if rng.random() < 0.3:
                parts.insert(rng.randrange(len(parts) + 1), p if rng.random() < 0.8 else p.replace(" ", "\n", 3))
        rows.append((100 + d, "  ".join(parts)))
    for k in range(40):
        rows.append((300 + k, passages[4]))
    rows += [(120, passages[3]), (120, passages[3]), (120, "x " + passages[3]), (None, passages[3]), (121, "a " * 120), (122, "a " * 70), (123, rows[30][1])]
    return rows


def test_op5_equals_brute_force(spark, make, table):
    rows = corpus()
    found = queries.op5_substring_dedup(spark, table(documents=make(rows)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_rolling_hashes_depend_on_the_words_alone():
    words = [b"w%d" % (i % 7) for i in range(500)]
    rolling = substring_dedup.Rolling(substring_dedup.word_hashes(words)).windows(50)
    for i in range(0, 451, 13):
        alone = substring_dedup.Rolling(substring_dedup.word_hashes(words[i : i + 50])).windows(50)
        assert rolling[i] == alone[0]
    assert len(set(rolling.tolist())) == 7


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64)
    for width in (1, 2, 35, 200):
        assert substring_dedup.sliding_least(x, width).tolist() == [int(x[i : i + width].min()) for i in range(200 - width + 1)]


def test_empty_table(spark, make, table):
    assert queries.op5_substring_dedup(spark, table(documents=make([]))).count() == 0


def test_sql_agrees_with_brute_force():
    rows = list({r[0]: r for r in corpus() if r[0] is not None}.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(str, con.sql(queries.OP5).fetchall())) == sorted(map(str, brute(rows)))
