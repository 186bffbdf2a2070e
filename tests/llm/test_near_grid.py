import random

import numpy as np

from tests.llm.conftest import text_of
from tidewheel.llm import near_dups
from tidewheel.llm.near_dups import SKETCH, grids, shingles, wide_fingerprint

VOCABULARY = [f"w{i}" for i in range(500)]


def brute_bits(hashes):
    """Bit by bit: set where over half of the shingles' words have it."""
    mask, found = (1 << 64) - 1, []
    for f in near_dups._FACTORS.tolist():
        words = []
        for h in hashes.tolist():
            x = h * f & mask
            words.append((x ^ x >> 32) * int(near_dups._FACTORS[0]) & mask)
        found += [sum(w >> i & 1 for w in words) * 2 > len(words) for i in range(64)]
    return found


def pairs(seed=3, n=400):
    """Texts of 30 to 300 words and copies with one word in some 45 changed: similarity 0.8 to 0.83."""
    rng, found = random.Random(seed), []
    while len(found) < n:
        words = text_of(rng, rng.randrange(30, 300), VOCABULARY).split()
        other = list(words)
        for i in rng.sample(range(len(words)), max(1, len(words) // 45)):
            other[i] = "changed"
        x, y = (shingles(" ".join(w).encode()) for w in (words, other))
        common = len(np.intersect1d(x, y))
        if 0.8 <= common / (len(x) + len(y) - common) <= 0.83:
            found.append((x, y))
    return found


def test_wide_fingerprints_are_simhash():
    rng = random.Random(1)
    for n in (1, 6, 40, 700):
        hashes = shingles(text_of(rng, n, VOCABULARY).encode())
        bits = np.unpackbits(np.frombuffer(wide_fingerprint(hashes), np.uint8), bitorder="little")
        assert bits.astype(bool).tolist() == brute_bits(hashes)
    assert wide_fingerprint(shingles(None)) is None


def test_grids_hold_pairs_of_the_least_similarity_at_any_size():
    bits = [[np.unpackbits(np.frombuffer(wide_fingerprint(x), np.uint8), bitorder="little") for x in pair] for pair in pairs()]
    sketch = [int((a[:SKETCH] != b[:SKETCH]).sum()) for a, b in bits]
    same = np.array([a.reshape(-1, 2).sum(axis=1) == b.reshape(-1, 2).sum(axis=1) for a, b in bits])
    for n in (1000, 250_000, 15_000_000):
        met = same[:, grids(n)].all(axis=2).any(axis=1) & (np.array(sketch) <= near_dups.RADIUS)
        assert met.mean() > 0.97, n


def test_large_cells_are_cut_into_chunks_that_meet(spark, monkeypatch):
    rows = []
    for i, pair in enumerate(pairs(5, 30)):
        for j, x in enumerate(pair):
            rows.append((2 * i + j, bytearray(wide_fingerprint(x))))
    sets = spark.createDataFrame(rows, "uid long, print binary")
    found = []
    for most in (4096, 8):
        monkeypatch.setattr(near_dups, "CELL_ROWS", most)
        groups = {}
        for r in near_dups.candidates(sets).collect():
            groups.setdefault(r["key"], []).append((r["uid"], r["n"]))
        assert all(n == len(g) for g in groups.values() for _, n in g)
        found.append({(2 * i, 2 * i + 1) for i in range(30) if any({2 * i, 2 * i + 1} <= {u for u, _ in g} for g in groups.values())})
    assert found[0] == found[1] and len(found[0]) >= 29
