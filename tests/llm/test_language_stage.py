import random

import corpus_pipeline
from tests.llm.conftest import EDGES

ENGLISH = "the weather in the old town was fine and people walked along the river to see what they could buy at the market".split()
FRENCH = "le temps dans la vieille ville était beau et les gens marchaient le long de la rivière pour voir le marché".split()


def kept(spark, docs):
    return sorted((r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()), key=str)


def test_junk_and_unknown_scripts_go(spark, make):
    rng = random.Random(4)
    clean = [(k, " ".join(rng.choices(words, k=n)), lang) for k, (words, lang, n) in enumerate([(ENGLISH, "en", 40), (FRENCH, "fr", 40), (ENGLISH, "en", 1), (FRENCH, "fr", 2)] * 30)]
    junk = [(1000, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(60)), None), (1001, "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=400)), None), (1002, "这是一段没有学过的语言的文字" * 20, None)]
    assert kept(spark, make(clean + junk)) == sorted((r[0] for r in clean), key=str)


def test_without_labels_only_letterless_documents_go(spark, make):
    expected = sorted((r[0] for r in EDGES if any(c.isalpha() for c in r[1] or "")), key=str)
    assert expected and kept(spark, make(EDGES)) == expected
