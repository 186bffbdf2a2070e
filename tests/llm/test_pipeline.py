import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import EDGES, text_of
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tidewheel.llm import mixing


def packed(rows):
    return [(r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in rows]


def corpus(seed=23, n=120):
    rng = random.Random(seed)
    rows = [(*r, "en", "a", None) for r in EDGES]
    line = "a line that very many documents of this corpus share with each other"
    for d in range(n):
        text = text_of(rng, rng.choice([5, 50, 400])) + ("\n" + line if d % 3 == 0 else "")
        rows.append((1000 + d, text, rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), len(text)))
    return rows + [(2000 + k, rows[60][1], "en", "b", None) for k in range(30)]


def test_stages_and_run(spark, make, table):
    rows = corpus()
    folder = table(documents=make(rows))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        path = f"{folder}/{name}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
    identified, lines, groups, mixed = seen
    # documents without a letter go, all others stay
    assert sorted((r["text"] for r in identified)) == sorted(r[1] for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert len(lines) == len(identified) and sum("a line that very many" in r["text"] for r in lines) == 1
    # lines and groups as brute force has them, each from the rows that the stage before kept
    as_hash = sorted(((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in lines), key=str)
    assert as_hash == sorted(((r[0], r[3]) for r in brute_lines([(r["doc_id"], r["text"]) for r in identified])), key=str)
    classes = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in lines])
    assert {r["doc_id"] for r in groups} == {d for d, _, c in classes if d == c}
    # the mix takes what its plan says
    plan = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(spark.read.parquet(f"{folder}/simhash_dedup.parquet")).taken().collect()}
    taken = {}
    for r in mixed:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert taken == {d: n for (d, _), n in plan.items() if n}
    # of the copies, the last kept its lines; the others are one group
    copies = [r["doc_id"] for r in groups if r["doc_id"] is not None and 2000 <= r["doc_id"] < 3000]
    assert copies in ([2029], []) and len({r["doc_id"] for r in groups}) == len(groups)
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted(packed(found), key=str) == sorted(packed(corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()), key=str)


def test_empty_table(spark, make, table):
    assert corpus_pipeline.run(spark, table(documents=make([]))).count() == 0


def test_columns_that_clash_with_names_of_the_stages(spark, make):
    """Stages keep what they are given, whatever it is called."""
    extra = ["_doc", "_key", "_language", "_score", "_n_lines", "_n_dropped", "_tidewheel_keep", "_tidewheel_takes", "doc", "Key", "keep", "takes", "language", "score", "n_lines", "n_dropped", "fp", "uid", "component_id"]
    docs = make(corpus(3, 60), extra=False)
    for i, name in enumerate(extra):
        docs = docs.withColumn(name, F.lit(i))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[name] == i for r in rows for i, name in enumerate(extra)), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count()
