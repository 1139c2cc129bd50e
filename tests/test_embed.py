"""Embedding: default hashed vectors and the model plug-in."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from quire.operators import retrieve
from quire.operators.embed import buckets, embed, embed_with


def test_hashed_embedding_matches_definition(spark):
    text = "Alpha beta, alpha! Gamma 42 ÉTÉ"
    df = embed(spark.createDataFrame([(text,)], "t string"), "t", dims=16)
    vec = np.array(df.collect()[0].embedding, dtype=np.float64)
    counts = np.zeros(16)
    for w in ["alpha", "beta", "alpha", "gamma", "42", "été"]:
        counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
    assert np.allclose(vec, counts / np.linalg.norm(counts), atol=1e-7)
    jvm = spark.createDataFrame([(text,)], "t string").select(buckets("t", 16)).collect()[0][0]
    assert sorted(np.nonzero(np.bincount(jvm, minlength=16))[0]) == sorted(np.nonzero(counts)[0])


def test_text_without_words_is_zero_vector(spark):
    df = embed(spark.createDataFrame([("!!! ...",)], "t string"), "t", dims=8)
    assert df.collect()[0].embedding == [0.0] * 8


def test_embed_with_plugin_model_loaded_once_per_task(spark):
    def factory():
        scale = 2.0  # stands for loading model weights

        def model(texts):
            return [[len(t) * scale, 1.0] for t in texts]
        return model

    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    got = sorted(tuple(r.embedding) for r in embed_with(df, "t", factory).collect())
    assert got == [(4.0, 1.0), (8.0, 1.0)]


def test_l2_metric_is_root_of_l2sq(spark):
    c = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<float>")
    sq = {r.id: r.distance for r in retrieve.knn(c, q, 2).collect()}
    l2 = {r.id: r.distance for r in retrieve.knn(c, q, 2, metric="l2").collect()}
    assert sq == {"a": 25.0, "b": 1.0} and l2 == {"a": 5.0, "b": 1.0}


def test_similarity_expression(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "d double")
    assert [r[0] for r in df.select(retrieve.similarity(F.col("d"))).collect()] == [1.0, 0.5, 0.25]
