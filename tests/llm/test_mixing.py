import math
import random
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import EDGES, text_of
from tidewheel.llm import mixing, queries


def corpus(seed=17, n=600):
    rng = random.Random(seed)
    rows = [(d, t, None, s, None) for (d, t), s in zip(EDGES, ["a", None, "b", "z"] * 9, strict=False)]
    for d in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "Z", "ä", None])
        rows.append((1000 + d, text_of(rng, rng.choice([0, 1, 30, 300])), None, source, None))
    return rows


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]


def brute_targets(rows):
    total = {}
    for r, n in zip(rows, sizes(rows), strict=True):
        total[r[3]] = total.get(r[3], 0) + n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e9  # the share of one unit of weight, by bisection
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[s], 2 * total[s]) for s in names) < 1.5 * sum(total.values()) else (low, mid)
    return total, {s: min(low * weight[s], 2 * total[s]) for s in names}


def test_op6(spark, make, table):
    rows = corpus()
    folder = table(documents=make(rows))
    found = queries.op6_mixing(spark, folder).collect()
    total, aim = brute_targets(rows)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 3)) for r in found), key=str) == sorted(((r[0], n, total[r[3]], round(aim[r[3]], 3)) for r, n in zip(rows, sizes(rows), strict=True)), key=str)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken = {}
    for r in found:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    for s, n in total.items():
        assert abs(taken[n] - aim[s]) <= max(2 * mixing.BLOCK, 0.02 * aim[s])
    again = queries.op6_mixing(spark, folder).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_texts_hold_the_words_taken(spark, make):
    rows = [r for r in corpus() if r[0] is not None]
    docs = make(rows)
    plan = mixing.mix(docs)
    texts = mixing.mixed_documents(docs, plan)
    assert texts.columns == docs.columns
    out = {}
    for r in texts.collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    whole = {}
    for r in rows:
        whole.setdefault(r[0], set()).add(r[1])
    for r in plan.taken().collect():
        if r["doc_id"] != 8:  # repeated rows are one document in the texts
            assert sum(len(t.encode().split()) for t in out.get(r["doc_id"], [])) == r["taken"]
    for doc, each in out.items():
        for t in each:
            have = next(iter(whole[doc])).encode().split()
            assert all(w in have for w in t.encode().split())


def test_sequence_fills_every_slot_once(spark, make):
    plan = mixing.mix(make(corpus()), shard_slots=50)
    slots = plan.slots.collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) == sum(s[4] for s in plan.sources)
    assert len({(r["sid"], r["block"], r["epoch"]) for r in slots}) == len(slots)
    assert plan.sequence().select("shard", "slot").distinct().count() == len(slots)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32 - 1))
def test_permutations(size, key):
    assert sorted(mixing.permuted(np.arange(size), size, key).tolist()) == list(range(size))


def test_shard_counts_add_up():
    draws = [1000, 37, 0, 5000]
    before = np.zeros(4, dtype=int)
    for shard in range(-(-sum(draws) // 64)):
        count, earlier = mixing.shard_counts(draws, shard, 64, 3)
        assert (earlier == before).all() and count.sum() == min(64, sum(draws) - before.sum())
        before = before + count
    assert before.tolist() == draws


def test_empty_tables(spark, make, table):
    assert queries.op6_mixing(spark, table(documents=make([]))).count() == 0
    blank = make([(1, "", None, "a", None), (2, None, None, None, None)])
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).taken().collect()] == [(0, 0.0)] * 2
    assert mixing.mixed_documents(blank, mixing.mix(blank)).count() == 0


def test_large_draws_have_the_hypergeometric_distribution():
    for good, bad, need in ((7, 5, 4), (40, 200, 60), (300, 20, 310), (1, 9, 5)):
        exact = [math.comb(good, k) * math.comb(bad, need - k) / math.comb(good + bad, need) for k in range(max(0, need - bad), min(good, need) + 1)]
        first = max(0, need - bad)
        assert np.allclose([math.exp(mixing.log_hypergeometric(first + i, good, bad, need)) for i in range(len(exact))], exact, rtol=1e-9)
        rng = np.random.default_rng(3)
        drawn = np.bincount([mixing.large_draw(rng, good, bad, need) - first for _ in range(20_000)], minlength=len(exact))
        some = np.array(exact) * 20_000 > 5
        assert len(drawn) == len(exact)
        assert (((drawn - np.array(exact) * 20_000) ** 2)[some] / (np.array(exact) * 20_000)[some]).sum() < 3 * some.sum() + 12


def test_draws_far_beyond_the_generators_range():
    good, bad, need = 3 * 10**11, 7 * 10**12, 10**12
    k = need * good // (good + bad)
    for step in (0, 10**5, -(10**6)):  # ratios of neighbouring probabilities are exact fractions
        at = k + step
        ratio = (good - at) * (need - at) / ((at + 1) * (bad - need + at + 1))
        assert math.isclose(mixing.log_hypergeometric(at + 1, good, bad, need) - mixing.log_hypergeometric(at, good, bad, need), math.log(ratio), abs_tol=1e-6)
    rng = np.random.default_rng(5)
    for swap in (False, True):
        drawn = np.array([mixing.large_draw(rng, *((bad, good) if swap else (good, bad)), need) for _ in range(2000)], dtype=float)
        mean = need * (bad if swap else good) / (good + bad)
        sd = math.sqrt(need * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - need) / (good + bad - 1)))
        assert abs(drawn.mean() - mean) < 4 * sd / math.sqrt(2000) and 0.9 < drawn.std() / sd < 1.1


def test_targets_hold_when_every_draw_is_a_large_one(spark, make, monkeypatch):
    monkeypatch.setattr(mixing, "NUMPY_MOST", 0)
    left = np.array([700, 0, 90, 3000])
    counts = [mixing.shard_counts(left.tolist(), s, 128, 9) for s in range(-(-int(left.sum()) // 128))]
    assert np.array_equal(sum(c for c, _ in counts), left) and all((c >= 0).all() and c.sum() <= 128 for c, _ in counts)
    before = np.zeros(4, dtype=np.int64)
    for c, b in counts:
        assert np.array_equal(b, before)
        before = before + c


def test_many_buckets_are_numbered_without_gaps(spark, make, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_WORDS", 64)
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    rows = corpus()
    plan = mixing.mix(make(rows))
    blocks = {}
    for r in plan.pieces.select("sid", "block").distinct().collect():
        blocks.setdefault(r["sid"], set()).add(r["block"])
    assert all(blocks.get(i, set()) == set(range(n)) for i, (_, _, _, n, _) in enumerate(plan.sources))
    total, aim = brute_targets(rows)
    taken = {r["source_size"]: r["n"] for r in plan.taken().groupBy("source_size").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    assert all(abs(taken[n] - aim[s]) <= max(4 * mixing.BLOCK, 0.03 * aim[s]) for s, n in total.items())


#: What op 6 fixes without a draw: sizes, and targets by sharing the excess of full sources again.
PLAN = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, n, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w FROM (SELECT source, sum(size) AS n FROM sized GROUP BY source)),
levels AS (
  SELECT 0 AS r, (SELECT 1.5 * sum(n) FROM sources) / (SELECT sum(w) FROM sources WHERE n > 0) AS level
  UNION ALL
  SELECT r + 1, (SELECT 1.5 * sum(n) - coalesce(sum(2 * n) FILTER (level * w > 2 * n), 0) FROM sources) / (SELECT sum(w) FILTER (n > 0 AND level * w <= 2 * n) FROM sources)
  FROM levels WHERE r < 40 AND level IS NOT NULL),
last AS (SELECT level FROM levels ORDER BY r DESC LIMIT 1)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(CASE WHEN n = 0 THEN 0 ELSE least(2 * n, (SELECT level FROM last) * w) END, 3) AS target
FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source
"""


def test_what_needs_no_draw_agrees_with_sql(spark, make, table):
    rows = corpus()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(*r, *[None] * (5 - len(r))) for r in rows])
    found = queries.op6_mixing(spark, table(documents=make(rows))).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 3)) for r in found), key=str) == sorted(con.sql(PLAN).fetchall(), key=str)
