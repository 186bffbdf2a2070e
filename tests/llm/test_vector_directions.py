import numpy as np

from tidewheel.llm import vector_dedup


def test_no_pair_is_lost_where_vectors_lie_in_few_directions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 3)) @ np.linalg.qr(rng.normal(size=(64, 3)))[0].T
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: r["n_links"] for r in vector_dedup.link(docs, lists=40).collect()}
    cosine = x.astype(float) @ x.astype(float).T
    sure = (cosine >= vector_dedup.THRESHOLD + 1e-6).sum(axis=1) - 1
    assert all(found[i] >= n for i, n in enumerate(sure.tolist()))
