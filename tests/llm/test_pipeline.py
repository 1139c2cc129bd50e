"""The pipeline keeps what its stages must keep, and drops the rest."""

import corpus_pipeline as P
import __spark_entry__ as E
from conftest import SF_SMALL
from quire.llm import decontam, simhash


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]
    assert E.queries()["pipeline"] is P.run and "pipeline" not in E.oracle_sql()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    seen = docs
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in seen.collect()}
        seen = P.materialize(stage(spark, seen, SF_SMALL), "test")
        after = {r.doc_id: r for r in seen.collect()}
        assert after.keys() <= before.keys() and seen.count() == len(after)
        if name != "packing":
            assert seen.dtypes == docs.dtypes
        if name in ("toxicity", "simhash", "decontamination"):
            assert all(after[i] == before[i] for i in after)
        if name == "toxicity":
            toxic = {r.doc_id for r in E.queries()["op6_toxicity"](spark, SF_SMALL)
                     .filter("predicted = 1").collect()}
            assert before.keys() - after.keys() == toxic
        elif name == "simhash":
            fps = {i: simhash.fingerprint(r.text) for i, r in before.items()}
            near = {i: {j for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 4} for i in fps}
            for i in before:  # one of each component stays, the smallest
                group, more = {i}, near[i]
                while more - group:
                    group |= more
                    more = set().union(*(near[j] for j in group))
                assert (i in after) == (i == min(group))
        elif name == "decontamination":
            match = next(decontam.matchers(
                spark.createDataFrame([(r.text,) for r in before.values()], "text string"),
                spark.createDataFrame(items, "item_id long, text string")))
            assert after.keys() == {i for i, r in before.items() if not match.spans(r.text)}
            assert after.keys() < before.keys()
        else:
            assert after.keys() == before.keys()
    assert {"doc_id", "n_tokens", "bucket", "batch", "slot"} <= set(seen.columns)
