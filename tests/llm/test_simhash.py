import random
import re
import struct

import numpy as np
import xxhash

from tests.llm.conftest import EDGES, text_of
from tidewheel.llm import queries, simhash
from tidewheel.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [words] if len(words) < 4 else [words[i : i + 4] for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Least doc_id reachable over links of at most 4 bits."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, f"{fp:016x}", least.get(find(i))) for i, (doc, fp) in enumerate(prints)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    rows = list(EDGES)
    for g in range(12):
        base = text_of(rng, rng.choice([3, 6, 60, 400])).split()
        for k in range(rng.choice([1, 2, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(["Other", "words"])
            rows.append((1000 + 100 * g + k, " ".join(words)))
    return rows


def test_op1_equals_brute_force(spark, make, table):
    rows = corpus()
    found = queries.op1_simhash_dedup(spark, table(documents=make(rows))).collect()
    expected = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    assert sorted((tuple(r) for r in found), key=str) == expected


def test_fingerprints_are_spark_xxhash64(spark):
    text = "a b c d"
    assert simhash.fingerprint(text.encode()) == struct.unpack("<Q", struct.pack("<q", spark.sql(f"SELECT xxhash64('{text}')").first()[0]))[0]


def test_links_of_random_and_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = set()
    for c in centres.tolist():
        for _ in range(30):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            values.add(c ^ sum(1 << int(f) for f in flips))
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    x = np.array(values, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    label = np.array(signed)
    while (after := np.where(near, label[None, :], 2**63 - 1).min(axis=1)).tolist() != label.tolist():
        label = after
    for least in (4096, 8):
        old, simhash.CELL_ROWS = simhash.CELL_ROWS, least
        try:
            found = {r["node"]: r["component"] for r in components(simhash.links(prints)).collect()}
        finally:
            simhash.CELL_ROWS = old
        assert {v: found.get(v, v) for v in signed} == dict(zip(signed, label.tolist(), strict=True))


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 300)]
    edges = path + star + [(1, 1), (2, None), (3, 4), (4, 3), (3, 4)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 800)} | {3: 3, 4: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark, make):
    rows = corpus(2)
    docs = make(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {d for d, _, c in brute_components([(r[0], brute_fingerprint(r[1])) for r in rows]) if d == c}
    found = [r["doc_id"] for r in kept.collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_empty_table(spark, make, table):
    assert queries.op1_simhash_dedup(spark, table(documents=make([]))).count() == 0
