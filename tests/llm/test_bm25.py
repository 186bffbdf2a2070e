import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from tests.llm.conftest import EDGES, text_of
from tidewheel.llm import bm25, queries


def brute(rows, asked, k=10):
    split = [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    counts = [Counter(s) for s in split]
    df = Counter(t for c in counts for t in c)
    mean = sum(map(len, split)) / len(rows)
    out = set()
    for q, text in asked:
        weights = Counter(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        found = []
        for (doc, _), c, words in zip(rows, counts, split, strict=True):
            norm = 1.2 * (0.25 + 0.75 * len(words) / mean)
            score = sum(n * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t, n in weights.items() if t in c)
            if score > 0:
                found.append((-round(score, 6), doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out |= {(q, i + 1, x[3], -x[0]) for i, x in enumerate(found[:k])}
    return out


def corpus(seed=11, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = list(EDGES)
    for d in range(n):
        words = [vocabulary[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.choice([3, 40, 200]))]
        rows.append((50 * d if d % 7 == 0 else 50 * d + 1, " ".join(words) + rng.choice(["", ". ", "!"]) + text_of(rng, 3)))
    return rows + [(30001 + i, rows[40][1]) for i in range(60)]


def test_op7_equals_brute_force(spark, make, table, monkeypatch):
    rows = corpus()
    expected = brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0])
    folder = table(documents=make(rows))
    assert {tuple(r) for r in queries.op7_top_k_search(spark, folder).collect()} == expected
    assert bm25._rounds(bm25.SHARD_DOCS) == 0
    monkeypatch.setattr(bm25, "SHARD_DOCS", 8)
    monkeypatch.setattr(bm25, "SAMPLE_OF", 4)
    assert bm25._rounds(len(rows)) == 3
    monkeypatch.setattr(bm25, "BATCH_TERMS", 500)
    assert {tuple(r) for r in queries.op7_top_k_search(spark, folder).collect()} == expected
    found = bm25.search(make(rows), make([r for r in rows if r[0] is not None and r[0] % 50 == 0]).withColumnRenamed("doc_id", "query_id"), 3)
    assert {tuple(r) for r in found.drop("tag").collect()} == {r for r in expected if r[1] <= 3}


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = random.Random(2)
    texts = [[b"%s%d" % (rng.choice([b"a", b"b"]) if i % 2 else b"c", rng.randrange(30)) for _ in range(50)] for i in range(1000)]
    texts = [[(b"x" if i < 500 else b"y") + t for t in words] for i, words in enumerate(texts)]
    shard = bm25.Shard()
    shard.add(list(range(1000)), [b" ".join(words) for words in texts])
    index = bm25.Index(shard, 50.0)
    contents = [Counter(words) for words in texts]

    def whole(terms):
        return np.array([sum(c[t] * 2.2 / (c[t] + 1.2) for t in terms if t in c) for c in contents])

    asked = [[b"xa1", b"xc2"], [b"yc3"], [b"xb5", b"ya7"], [b"nowhere"]]
    hashes = [bm25.hashed_terms([t])[0] for words in asked for t in words]
    own, at = np.unique(np.concatenate(hashes), return_inverse=True)
    for floor in (0.0, 1.2):
        batch = bm25.Queries([0] * 4, [0] * 4, own, np.cumsum([len(x) for x in asked]), at, np.ones(len(at)), np.full(4, floor))
        for terms, (docs, scores) in zip(asked, index.search(batch, 5), strict=True):
            expected = whole(terms)
            best = [i for i in np.lexsort((np.arange(1000), -np.round(expected, 6)))[:5].tolist() if expected[i] > max(0, floor - 1e-6)]
            assert index.ids[docs].tolist() == best and np.allclose(scores, expected[best], atol=1e-6)


def test_hashed_terms_are_those_of_a_plain_split(monkeypatch):
    texts = [r[1].encode() if r[1] is not None else None for r in EDGES] + [b"a b", b"", b"A  b", b"ab", b"ba", "Ünï ünï".encode(), b"x" * 3000]
    for size in (1 << 20, 64):
        monkeypatch.setattr(bm25, "_HASHED", size)
        monkeypatch.setattr(bm25, "_TABLES", [np.zeros(0, np.uint64)] * 2)
        hashes, lengths = bm25.hashed_terms(texts)
        words = [re.findall(rb"[a-z0-9\x80-\xff]+", (t or b"").lower()) for t in texts]
        assert lengths.tolist() == [len(w) for w in words]
        by = {}
        for word, h in zip([w for ws in words for w in ws], hashes.tolist(), strict=True):
            assert by.setdefault(word, h) == h
        assert len(set(by.values())) == len(by)
    assert bm25.hashed_terms([])[0].tolist() == []


def test_sql_agrees_with_brute_force():
    rows = list({r[0]: r for r in corpus(12, 150) if r[0] is not None}.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert set(con.sql(queries.OP7).fetchall()) == brute(rows, [r for r in rows if r[0] % 50 == 0])


def test_empty_table(spark, make, table):
    assert queries.op7_top_k_search(spark, table(documents=make([]))).count() == 0
