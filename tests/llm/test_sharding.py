"""k-d shards: near-equal bytes, gapless slots, edge rows."""

import random
import zlib

from pyspark.sql import functions as F

from quire.llm import sharding


def dims():
    return {"id": F.col("doc_id"), "length": F.length("text"), "lang": F.ascii("lang")}


SCHEMA = "doc_id long, text string, lang string, shard string, size string"


def shards_of(spark, rows, n, **how):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.kd_shards(docs, dims(), shards=n, **how).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        if r.doc_id is not None:
            body = texts[r.doc_id].encode()
            assert r["size"] == len(body) + 16 and r.text_crc32 == zlib.crc32(body)
    return by


def test_bytes_are_nearly_equal(spark):
    rng = random.Random(1)
    rows = [(i, "é" * int(rng.paretovariate(1.1) * 5 % 3000), rng.choice(["en", "de", "fr"]),
             "", "") for i in range(4000)]
    # A third of all rows are one group of copies, equal in every dimension.
    rows += [(10_000, "copy", "en", "", "")] * 2000
    by = shards_of(spark, rows, 40)
    sizes = [sum(r["size"] for r in by[s]) for s in range(40)]
    most = max(r["size"] for own in by.values() for r in own)
    mean = sum(sizes) / 40
    assert max(abs(s - mean) for s in sizes) <= 3 * most + 0.01 * mean


def test_target_bytes(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x" * 84).alias("text"),
                                    F.lit("en").alias("lang"))
    got = sharding.kd_shards(docs, dims(), target_bytes=10_000)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [100] * 10


def test_edge_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashes, empty table."""
    rows = [(1, None, None, "", ""), (2, "", "", "", ""), (3, "x" * 200_000, "en", None, None),
            (None, "y", "en", "", ""), (None, None, None, "", ""), (3, "x" * 200_000, "en", "", "")]
    by = shards_of(spark, rows, 4)
    assert sum(len(v) for v in by.values()) == 6 and set(by) <= set(range(4))
    assert len([s for s, own in by.items() for r in own if r["size"] > 1000]) == 2
    one = shards_of(spark, rows[:1], 40)
    assert len(one) == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.kd_shards(empty, dims(), shards=40).count() == 0
    plan = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), dims(), shards=3) \
        ._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
