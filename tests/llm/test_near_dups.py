import random

import corpus_pipeline
from tests.llm.conftest import EDGES, text_of
from tidewheel.llm import near_dups

VOCABULARY = [f"w{i}" for i in range(500)]


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def corpus(seed=5):
    """Copies with 0 to 6 words changed in 150: from similarity 1 to about 0.65."""
    rng = random.Random(seed)
    rows = [(*r, "en", "a", None) for r in EDGES]
    for g in range(15):
        base = text_of(rng, rng.choice([20, 60, 150]), VOCABULARY).split()
        for k in range(rng.choice([2, 5, 40])):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 25)):
                words[rng.randrange(len(words))] = "changed"
            rows.append((1000 + 100 * g + k, " ".join(words), "en", "a", None))
    return rows


def firsts(rows):
    """Least doc_id of each component of the similar pairs."""
    sets = [sets_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    return sorted((min((d for d in ids if d is not None), default=None) for ids in least.values()), key=str)


def test_stage_equals_brute_force(spark, make, table):
    rows = corpus()
    docs = make(rows)
    for most in (128, 4):
        old, near_dups.PLACE = near_dups.PLACE, most
        try:
            kept = corpus_pipeline.simhash_dedup(spark, docs, "")
            assert kept.columns == docs.columns
            assert sorted((r["doc_id"] for r in kept.collect()), key=str) == firsts(rows)
        finally:
            near_dups.PLACE = old


def test_a_light_edit_is_a_near_copy(spark, make):
    rng = random.Random(9)
    rows = []
    for g in range(30):
        words = text_of(rng, 200, VOCABULARY).split()
        rows.append((2 * g, " ".join(words)))
        words[40] = words[90] = words[140] = "edited"  # 15 of 196 shingles: similarity 0.858
        rows.append((2 * g + 1, " ".join(words)))
    kept = corpus_pipeline.simhash_dedup(spark, make(rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * g for g in range(30)]


def test_empty_table(spark, make):
    assert corpus_pipeline.simhash_dedup(spark, make([]), "").count() == 0
