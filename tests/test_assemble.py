"""Context prompt, metadata JSON, system prompt, messages, preview."""

import json

from pyspark.sql import functions as F

from quire.functions.text import json_string, preview
from quire.operators import assemble


def ordered_map_df(spark, rows, schema):
    """createDataFrame with the last column given as a dict, turned into a map
    with its insertion order kept (dicts sent from Python lose their order)."""
    rows = [r[:-1] + (list(r[-1].items()),) for r in rows]
    df = spark.createDataFrame(rows, schema + ", _m array<struct<key:string,value:string>>")
    return df.withColumn("metadata", F.map_from_entries("_m")).drop("_m")


def ctx(spark, docs):
    rows = [(1, i + 1, d, m) for i, (d, m) in enumerate(docs)]
    df = ordered_map_df(spark, rows, "query_id long, rank int, document string")
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    return {r.query_id: r.context for r in assemble.context_prompt(df, q).collect()}


def test_no_documents_gives_empty_context(spark):
    assert ctx(spark, [("x", {})])[2] == ""


TWO = """Here is relevant context from the knowledge base:

--- Document 1: Test Article ---
Metadata: {
  "source_file": "test.md",
  "title": "Test Article"
}
This is test content.

--- Document 2: Article Two ---
Metadata: {
  "source_file": "two.md",
  "title": "Article Two"
}
Content two.
"""
BARE = """Here is relevant context from the knowledge base:

--- Document 1: Untitled ---
Metadata: {}
Content here.
"""


def test_single_and_many_documents(spark):
    docs = [("This is test content.", {"source_file": "test.md", "title": "Test Article"}),
            ("Content two.", {"source_file": "two.md", "title": "Article Two"})]
    assert ctx(spark, docs)[1] == TWO


def test_missing_metadata(spark):
    assert ctx(spark, [("Content here.", {})])[1] == BARE


def test_line_separators_are_escaped(spark):
    values = ["end\x85", "end\u2028", "end\u2029", "\x85"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(json_string("v")).collect()] == [
        '"end\\u0085"', '"end\\u2028"', '"end\\u2029"', '"\\u0085"']


def test_json_string_matches_python(spark):
    values = ["plain", 'quote " and \\ slash', "tab\tnew\nline", "café", "emoji 😀", "\x7f\x01"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(json_string("v")).collect()]
    assert got == [json.dumps(v) for v in values]


def test_typed_metadata_json_order_and_override(spark):
    df = ordered_map_df(spark, [("a/b.md", 0, 2, {"title": "T", "source_file": "override.md"})],
                        "s string, i int, n int")
    got = df.select(assemble.metadata_json(F.col("metadata"), F.col("s"), F.col("i"),
                                           F.col("n"))) \
        .collect()[0][0]
    expected = {"source_file": "override.md", "chunk_index": 0, "total_chunks": 2, "title": "T"}
    assert got == json.dumps(expected, indent=2)


def test_system_prompt_and_messages(spark):
    df = spark.createDataFrame([("ctx",), ("",)], "c string")
    got = [r[0] for r in df.select(assemble.system_prompt(F.col("c"), "BASE")).collect()]
    assert got == ["BASE\n\nctx", "BASE"]
    h = spark.createDataFrame([([("user", "hi"), ("assistant", "hello")], "next?")],
                              f"h {assemble.MESSAGE_TYPE}, q string")
    msgs = h.select(assemble.messages(F.col("h"), F.col("q")).alias("m")).collect()[0].m
    assert [(m.role, m.content) for m in msgs] == [("user", "hi"), ("assistant", "hello"),
                                                   ("user", "next?")]


def test_build_requests(spark):
    q = spark.createDataFrame([(1, "why?")], "query_id long, question string")
    c = spark.createDataFrame([(1, "")], "query_id long, context string")
    r = assemble.build_requests(q, c, base_prompt="BASE").collect()[0]
    assert (r.model, r.max_tokens, r.system) == (assemble.DEFAULT_MODEL, 2048, "BASE")
    assert [(m.role, m.content) for m in r.messages] == [("user", "why?")]


def test_preview(spark):
    df = spark.createDataFrame([("x" * 250,), ("short",)], "t string")
    got = [r[0] for r in df.select(preview("t")).collect()]
    assert got == ["x" * 200 + "...", "short"]


def test_contexts_of_one_list_share_its_pieces(spark, monkeypatch):
    """Every prefix of a long list has the context of these rows alone."""
    monkeypatch.setattr(assemble, "PIECE_ROWS", 8)
    rows = [(1, i, f"text {i}", {"title": f"T{i}"}, "a.md", i, 30) for i in range(1, 31)]
    res = spark.createDataFrame(rows, "list_id long, rank int, document string, "
                                "metadata map<string,string>, source_file string, "
                                "chunk_index int, total_chunks int")
    cuts = [1, 8, 13, 30]
    pieces = assemble.context_pieces(
        res.withColumn("place", F.col("rank")).withColumn("cuts", F.array(*map(F.lit, cuts))),
        "list_id")
    assert [p["end"] for p in pieces.first().pieces] == [1, 8, 13, 16, 24, 30]
    for cut in cuts:
        want = assemble.context_prompt(res.filter(F.col("rank") <= cut)
                                       .withColumnRenamed("list_id", "query_id")).first().context
        assert pieces.select(assemble.context_upto(F.col("pieces"), F.lit(cut))).first()[0] == want
    assert pieces.select(assemble.context_upto(F.col("pieces"), F.lit(0))).first()[0] == ""
