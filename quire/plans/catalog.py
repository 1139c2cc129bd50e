"""Registered queries over the provided tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
are scalars or strings (maps, arrays and vectors are rendered or summarised)
so results compare exactly with the SQL restatements in
:mod:`quire.plans.oracle`. Every query reads whole tables and whole texts.

Derived inputs (all computed by Spark from the given tables):

* articles  - ``documents`` as markdown files: ``<lang>/doc_<id>.md`` with a
  frontmatter block (title, type = lang, author = source, tags list), except
  German documents, which have none;
* questions - ``benchmark`` rows, with per-row settings derived from the id;
* session log - ``conversations`` user turns, each answered by the following
  assistant turn (none = failed call);
* command log - ``events`` rendered as chat input lines (commands and
  questions) per user;
* fragments - assistant turns cut into 16-character stream fragments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import preview, token_count
from quire.operators import assemble, replay, retrieve
from quire.operators.chunking import chunk_audit, chunk_by_tokens, with_chunk_identity
from quire.operators.embed import hashed_embedding
from quire.operators.frontmatter import frontmatter_map, split_frontmatter
from quire.plans.ask import replay_requests, retrieve_asked
from quire.plans.ingest import articles_to_chunks
from quire.session import materialize, table_folder, table_path
from quire.sources.collection import add_chunks, count, get, ingest_stats, read_collection
from quire.sources.files import write_files
from quire.sources.markdown import list_markdown, scan_markdown

EMBED_DIMS = 256


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf, name))


# ---------------------------------------------------------------------------
# Derived inputs
# ---------------------------------------------------------------------------
def articles(spark: SparkSession, sf: str, collide: bool = False) -> DataFrame:
    d = _t(spark, sf, "documents")
    block = F.concat(
        F.lit("---\ntitle: Document "), F.col("doc_id").cast("string"),
        F.lit("\ntype: "), F.col("lang"), F.lit("\nauthor: "), F.col("source"),
        F.lit("\ntags: ["), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]\n---\n\n"),
        F.col("text"))
    text = F.when(F.col("lang") == "de", F.col("text")).otherwise(block)
    if collide:  # same stem for documents 2k and 2k+1, in different folders
        path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"),
                        F.lit("/doc_"), F.floor(F.col("doc_id") / 2).cast("string"),
                        F.lit(".md"))
    else:
        path = F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                        F.lit(".md"))
    return d.select(path.alias("source_file"), text.alias("text"))


def chunks(spark: SparkSession, sf: str, embedded: bool = False) -> DataFrame:
    return articles_to_chunks(articles(spark, sf), with_embedding=embedded, dims=EMBED_DIMS)


def questions(spark: SparkSession, sf: str, per_row: bool = False) -> DataFrame:
    b = _t(spark, sf, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    if per_row:
        i = F.col("query_id")
        q = q.select(
            "*",
            (F.lit(1) + F.pmod(i, F.lit(7))).cast("int").alias("n_results"),
            F.when(F.pmod(i, F.lit(4)) == 0, F.lit(0.6))
             .when(F.pmod(i, F.lit(4)) == 1, F.lit(0.0)).cast("double").alias("min_relevance"),
            F.when(F.pmod(i, F.lit(11)) == 3, F.lit("no such type"))
             .when(F.pmod(i, F.lit(3)) == 0, F.lit("en"))
             .when(F.pmod(i, F.lit(3)) == 2, F.lit("fr")).cast("string").alias("filter_type"),
            F.when(F.pmod(i, F.lit(5)) == 0,
                   F.concat(F.lit("src"), F.pmod(i, F.lit(20)).cast("string")))
             .cast("string").alias("filter_author"))
    return q.withColumn("embedding", hashed_embedding("question", EMBED_DIMS))


def session_log(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the answer that follows them (turns are consecutive):
    an equi-join on ``(conv_id, turn + 1)``, so no conversation is sorted as
    a whole in one task."""
    c = _t(spark, sf, "conversations")
    users = c.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"),
                   F.col("role").alias("_nr"), F.col("text").alias("_nt"))
    return users.join(nxt, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"),
        F.col("text").alias("input"),
        F.when(F.col("_nr") == "assistant", F.col("_nt")).alias("response"))


def command_log(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events") \
        .withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("_k")
    ks = k.cast("string")
    et = F.col("event_type")
    line = (
        F.when(et == "view", F.concat(F.lit("Tell me about topic "), ks))
        .when(et == "click",
              F.when(k < 40, F.concat(F.lit("/set n_results "), ks))
               .when(k < 44, F.concat(F.lit("/set n_results "), ks, F.lit("9" * 21)))
               .when(k < 46, F.concat(F.lit("/set n_results -"), ks, F.lit("9" * 21)))
               .when(k < 50, F.concat(F.lit("/set n_results x"), ks))
               .when(k < 60, F.concat(F.lit("  /SET N_RESULTS "), (k - 55).cast("string")))
               .when(k < 70, F.lit("/help"))
               .when(k < 80, F.lit("/config"))
               .when(k < 90, F.lit("/sources"))
               .otherwise(F.lit("   ")))
        .when(et == "purchase",
              F.when(k < 25, F.concat(F.lit("/set min_relevance 0."), ks))
               .when(k < 40, F.lit("/set min_relevance none"))
               .when(k < 42, F.lit("/set min_relevance -nan"))
               .when(k < 44, F.lit("/set min_relevance +NaN"))
               .when(k < 50, F.concat(F.lit("/set min_relevance 1"), ks))
               .when(k < 55, F.lit("/set filter_type en"))
               .when(k < 60, F.lit("/set filter_type NONE"))
               .when(k < 70, F.concat(F.lit("/set filter_author src"), (k - 60).cast("string")))
               .when(k < 75, F.lit("/set include_sources yes"))
               .when(k < 80, F.lit("/set include_sources off"))
               .when(k < 90, F.lit("/set n_results"))
               .otherwise(F.lit("/set unknown_opt 3")))
        .when(et == "signup",
              F.when(k < 50, F.lit("/clear")).otherwise(F.lit("/bogus")))
        .otherwise(
              F.when(k < 10, F.lit("/quit"))
               .when(k < 15, F.lit("/ Exit now"))
               .otherwise(F.concat(F.lit("why did "), ks, F.lit(" fail?")))))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
                    line.alias("input"))


def chat_log(spark: SparkSession, sf: str) -> DataFrame:
    """The command log with answers to two questions in three."""
    return command_log(spark, sf).withColumn(
        "response", F.when(F.pmod("seq", F.lit(3)) > 0,
                           F.concat(F.lit("answer "), F.col("seq").cast("string"))))


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations") \
        .filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", "text",
                    F.posexplode_outer(F.regexp_extract_all("text", F.lit(r"(?s).{1,16}"),
                                                            F.lit(0))).alias("seq", "frag")) \
        .filter(F.col("frag").isNotNull())


# ---------------------------------------------------------------------------
# Corpus (C*)
# ---------------------------------------------------------------------------
def q_token_counts(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", token_count("text").cast("int").alias("token_count"))


def q_chunk_documents(spark, sf):
    return chunks(spark, sf).select("id", "source_file", "chunk_index", "total_chunks",
                                    "token_count", "document")


def q_chunk_whole(spark, sf):
    return articles_to_chunks(articles(spark, sf), no_chunk=True, with_embedding=False) \
        .select("id", "source_file", "total_chunks", "token_count", "document")


def q_chunk_no_tokenizer(spark, sf):
    """Without a tokenizer a document is one chunk of which no token is counted."""
    bodies = split_frontmatter(articles(spark, sf), "text").select("source_file", "content")
    return with_chunk_identity(chunk_by_tokens(bodies, tokenizer=None)) \
        .select("id", "source_file", "total_chunks", "token_count", "document")


def q_chunk_audit(spark, sf):
    bodies = split_frontmatter(articles(spark, sf), "text").select("source_file", "content")
    return chunk_audit(chunks(spark, sf), contents=bodies) \
        .withColumn("end_kept", F.col("end_kept").cast("string"))


def q_frontmatter_split(spark, sf):
    s = split_frontmatter(articles(spark, sf), "text")
    return s.select("source_file", "fm", F.md5("content").alias("content_md5"),
                    F.length("content").cast("int").alias("content_length"))


def q_frontmatter_map(spark, sf):
    s = frontmatter_map(split_frontmatter(articles(spark, sf), "text"), "fm")
    return s.select("source_file", assemble.metadata_json(F.col("metadata"))
                    .alias("metadata_json"))


def q_chunk_metadata(spark, sf):
    c = chunks(spark, sf)
    return c.select("id", assemble.metadata_json(F.col("metadata"), F.col("source_file"),
                                                 F.col("chunk_index"), F.col("total_chunks"))
                    .alias("metadata_json"))


def q_hashed_embedding(spark, sf):
    c = chunks(spark, sf, embedded=True)
    e = F.col("embedding")
    weighted = F.aggregate(
        F.zip_with(e, F.sequence(F.lit(1), F.size(e)), lambda x, i: x.cast("double") * i),
        F.lit(0.0).cast("double"), lambda s, x: s + x)
    return c.select("id",
                    F.size(F.filter(e, lambda x: x != 0)).cast("int").alias("nnz"),
                    F.round(weighted, 6).alias("checksum"))


def q_where_filter(spark, sf):
    c = retrieve.where_filter(chunks(spark, sf), "fr")
    return c.select("id", "source_file")


def q_where_type_author(spark, sf):
    c = retrieve.where_filter(chunks(spark, sf), "en", "src3")
    return c.select("id", "source_file")


def q_chunk_ids(spark, sf):
    return chunks(spark, sf).select("id", "source_file", "chunk_index")


def titled_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles whose frontmatter title is the first six words of the text
    (non-ASCII for most languages) plus the language."""
    d = _t(spark, sf, "documents")
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"),
                                                            F.lit(0)), 1, 6), " ")
    text = F.concat(F.lit("---\ntitle: "), first_words, F.lit("\nlang: "), F.col("lang"),
                    F.lit("\n---\n"), F.col("text"))
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
                    .alias("source_file"), text.alias("text"))


def q_metadata_json(spark, sf):
    s = frontmatter_map(split_frontmatter(titled_articles(spark, sf), "text"), "fm")
    return s.select("source_file", assemble.metadata_json(F.col("metadata"))
                    .alias("metadata_json"))


# The forms of frontmatter values, around the columns of a document.
FORMS = r"""---
# forms
hash_title: "{source} #{id}"  # a comment
single: '{source} # notes'
escaped: "{source}\"\té{lang}"
flow: [{source}, "{lang}, {lang}'s", 7]
wide: {id}12345678901234567890
long_float: 0.1234567890123456
commented: {n} # characters
continued: {lang}
  {source}
literal: |
  {lang}
  {source}
folded: >
  {lang}
  {source}

items:
  - {source} # first
  - '{lang} x'
"quoted_key": {lang}
hex: 0x100{digit}
nothing: ~
flag: yes
clock: 12:03
---
"""


def form_articles(spark: SparkSession, sf: str) -> DataFrame:
    head = F.lit(FORMS)
    for name, value in (("source", F.col("source")), ("lang", F.col("lang")),
                        ("id", F.col("doc_id").cast("string")),
                        ("n", F.col("n_chars").cast("string")),
                        ("digit", F.pmod("doc_id", F.lit(10)).cast("string"))):
        head = F.replace(head, F.lit(f"{{{name}}}"), value)
    return _t(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("text"))


def q_frontmatter_forms(spark, sf):
    s = frontmatter_map(split_frontmatter(form_articles(spark, sf), "text"), "fm")
    names = [line.split(":")[0].strip('"') for line in FORMS.splitlines()
             if line[:1].isalpha() or line.startswith('"')]
    return s.select("doc_id", *[F.col("metadata")[n].alias(n) for n in names],
                    F.length("content").cast("bigint").alias("body_length"))


# ---------------------------------------------------------------------------
# Retrieval (D*)
# ---------------------------------------------------------------------------
def _vectors(spark, sf):
    e = _t(spark, sf, "embeddings")
    corpus = e.select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")
    qs = e.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return corpus, qs


def q_knn_vectors(spark, sf):
    corpus, qs = _vectors(spark, sf)
    r = retrieve.knn(corpus, qs, 5)
    return r.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def q_knn_filtered(spark, sf):
    corpus, qs = _vectors(spark, sf)
    r = retrieve.knn(corpus, qs, 3, filters={"label": F.col("label")})
    return r.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def q_knn_multi(spark, sf):
    """Every vector as a question, each with its own k (1 to 5)."""
    corpus, qs = _vectors(spark, sf)
    qs = qs.withColumn("n_results", (F.lit(1) + F.pmod("query_id", F.lit(5))).cast("int"))
    r = retrieve.knn(corpus, qs, "n_results")
    return r.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def q_similarity(spark, sf):
    corpus, qs = _vectors(spark, sf)
    r = retrieve.knn(corpus, qs, 3)
    return r.select("query_id", "rank", "id",
                    F.round(retrieve.similarity(F.col("distance")), 6).alias("similarity"))


def q_relevance_filter(spark, sf):
    corpus, qs = _vectors(spark, sf)
    r = retrieve.knn(corpus, qs, 5).withColumn("similarity",
                                               retrieve.similarity(F.col("distance")))
    r = retrieve.filter_by_relevance(r, 0.5)
    return r.select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


def collection(spark: SparkSession, sf: str) -> DataFrame:
    """The embedded chunk table, materialised once in the shared checkpoint
    folder (what an ingest run stores), so retrieval never recomputes
    tokenizing or embedding."""
    return materialize(chunks(spark, sf, embedded=True), "collection")


def _text_results(spark, sf, per_row: bool, keep_unfiltered: bool = False):
    qs = questions(spark, sf, per_row=per_row)
    return qs, retrieve.retrieve(collection(spark, sf), qs, per_row=per_row,
                                 keep_unfiltered=keep_unfiltered)


def q_retrieve_text(spark, sf):
    _, r = _text_results(spark, sf, per_row=False)
    return r.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def q_retrieve_per_row_config(spark, sf):
    _, r = _text_results(spark, sf, per_row=True)
    return r.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"),
                    F.round("similarity", 6).alias("similarity"))


def q_retrieval_report(spark, sf):
    qs, r = _text_results(spark, sf, per_row=True, keep_unfiltered=True)
    return retrieve.retrieval_report(r, qs)


def q_retrieval_log(spark, sf):
    _, r = _text_results(spark, sf, per_row=True, keep_unfiltered=True)
    return retrieve.retrieval_log(r).withColumn("kept", F.col("kept").cast("string"))


def q_sources(spark, sf):
    _, r = _text_results(spark, sf, per_row=True)
    return retrieve.sources(r)


def q_context_prompt(spark, sf):
    qs, r = _text_results(spark, sf, per_row=True)
    return assemble.context_prompt(r, qs)


def q_system_prompt(spark, sf):
    qs, r = _text_results(spark, sf, per_row=True)
    ctx = assemble.context_prompt(r, qs)
    return ctx.select("query_id", assemble.system_prompt(F.col("context")).alias("system"))


# ---------------------------------------------------------------------------
# Sessions (E*)
# ---------------------------------------------------------------------------
def q_history_replay(spark, sf):
    h = replay.replay_history(session_log(spark, sf))
    return h.select("session_id", "seq", "history_len",
                    assemble.render_messages(F.col("history")).alias("history_text"))


def q_requests(spark, sf):
    h = replay.replay_history(session_log(spark, sf))
    msgs = assemble.messages(F.col("history"), F.col("line"))
    return h.select("session_id", "seq",
                    F.lit(assemble.DEFAULT_MODEL).alias("model"),
                    F.lit(assemble.MAX_TOKENS).alias("max_tokens"),
                    F.size(msgs).cast("int").alias("n_messages"),
                    assemble.render_messages(msgs).alias("messages_text"))


def q_chat_requests(spark, sf):
    r = replay_requests(collection(spark, sf), chat_log(spark, sf), dims=EMBED_DIMS)
    return r.select("session_id", "seq", "model", "max_tokens", F.md5("system").alias("system_md5"),
                    "n_sources", F.size("messages").alias("n_messages"),
                    F.md5(assemble.render_messages(F.col("messages"))).alias("messages_md5"))


def q_response_assembly(spark, sf):
    fr = fragments(spark, sf).select(F.struct("conv_id", "turn").alias("request_id"),
                                     "seq", F.col("frag").alias("text"))
    a = replay.assemble_responses(fr)
    orig = _t(spark, sf, "conversations").filter(F.col("role") == "assistant") \
        .select(F.struct("conv_id", "turn").alias("request_id"), F.col("text").alias("_o"))
    return a.join(orig, "request_id").select(
        F.col("request_id.conv_id").alias("conv_id"), F.col("request_id.turn").alias("turn"),
        "response", "n_fragments", (F.col("response") == F.col("_o")).alias("matches"))


def q_running_response(spark, sf):
    fr = fragments(spark, sf).select(F.struct("conv_id", "turn").alias("request_id"),
                                     "seq", F.col("frag").alias("text"))
    r = replay.running_responses(fr)
    return r.select(F.col("request_id.conv_id").alias("conv_id"),
                    F.col("request_id.turn").alias("turn"), F.col("seq").cast("int").alias("seq"),
                    F.length("so_far").cast("int").alias("so_far_length"),
                    F.md5("so_far").alias("so_far_md5"))


def q_preview(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", preview("text", 200).alias("preview"))


def q_classify(spark, sf):
    c = replay.classify(command_log(spark, sf))
    return c.select("session_id", "seq", "kind", F.size("args").cast("int").alias("n_args"))


def q_until_quit(spark, sf):
    c = replay.until_quit(replay.classify(command_log(spark, sf)))
    return c.select("session_id", "seq", "kind")


def q_settings_at(spark, sf):
    s = replay.settings_at(command_log(spark, sf))
    return s.select("session_id", "seq", "kind", F.col("set_ok").cast("string").alias("set_ok"),
                    "n_results",
                    F.round("min_relevance", 6).alias("min_relevance"),
                    "filter_type", "filter_author", "include_sources")


def q_last_sources(spark, sf):
    s = replay.last_sources(command_log(spark, sf))
    return s.filter(F.col("kind") == "sources").select(
        "session_id", "seq", F.col("sources_of").cast("string").alias("sources_of"))


def q_shown_sources(spark, sf):
    """What ``/sources`` lists: every question retrieved with the settings in
    force at it."""
    log = materialize(command_log(spark, sf), "command-log")
    listed = replay.last_sources(log).filter(F.col("kind") == "sources") \
        .select("session_id", F.col("sources_of").alias("seq"))
    asked, results = retrieve_asked(collection(spark, sf), log, dims=EMBED_DIMS, listed=listed)
    found = asked.select("session_id", F.col("seq").alias("sources_of"), "query_id")
    shown = replay.shown_sources(log, retrieve.sources(results), questions=found)
    return shown.select("session_id", "seq", "n_sources", "position", "source_file", "title")


# ---------------------------------------------------------------------------
# Collections and sync (A*, B*, F1)
# ---------------------------------------------------------------------------
def article_files(spark: SparkSession, sf: str) -> DataFrame:
    """The articles under names of all kinds: spaces, signs that URLs encode,
    names and folders that begin with ``_`` or ``.``."""
    key = F.regexp_extract("source_file", r"(\d+)\.md$", 1).cast("long")
    lead = F.element_at(F.array(*map(F.lit, ["", "_", "."])), (key % 3 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ["", ".git/", "_new/x y/", "été+50%20/"])),
                          (key % 4 + 1).cast("int"))
    return articles(spark, sf).select(
        F.concat(folder, lead, F.regexp_extract("source_file", r"([^/]*)$", 1))
        .alias("source_file"), "text")


def q_scan_files(spark, sf):
    """Every article written as a file, then found and read again."""
    folder = table_folder(spark, "articles")
    write_files(article_files(spark, sf), folder)
    listed = list_markdown(spark, folder, reader="files")
    read = scan_markdown(spark, folder, reader="files")
    return read.join(listed, "source_file") \
        .select("source_file", "length", F.md5("text").alias("text_md5"))


def q_stream_ingest(spark, sf):
    """Articles that arrive in two waves, each ingested by a run of the stream
    that goes on from the same checkpoint."""
    from quire.streaming.ingest import stream_ingest  # noqa: PLC0415

    folder, root, state = (table_folder(spark, f"stream-{x}") for x in ("in", "out", "state"))
    german = F.col("source_file").startswith("de/")
    for wave in (german, ~german):
        write_files(articles(spark, sf).filter(wave), folder)
        stream_ingest(spark, folder, root, "live", state, with_embedding=False) \
            .awaitTermination()
    return get(read_collection(spark, root, "live"), ["source_file", "chunk_index"])


def q_ingest_stats(spark, sf):
    arts = articles(spark, sf)
    c = articles_to_chunks(arts, with_embedding=False)
    return ingest_stats(arts.count(), c, "documents")


def _collided(spark, sf):
    """Chunks of articles whose file stems collide, written once (as an
    ingest run writes its produced chunks) before the first-writer pass."""
    return materialize(articles_to_chunks(articles(spark, sf, collide=True),
                                          with_embedding=False), "collided")


def _stored(spark, sf) -> DataFrame:
    """The collection after the same articles were ingested twice."""
    root, chunks_ = table_folder(spark, "collections"), _collided(spark, sf)
    for _ in range(2):
        add_chunks(spark, chunks_, root, "documents")
    return read_collection(spark, root, "documents")


def q_add_chunks(spark, sf):
    return get(_stored(spark, sf), ["source_file", "chunk_index"])


def q_collection_count(spark, sf):
    return count(_stored(spark, sf))


def page_candidates(spark, sf) -> DataFrame:
    p = _t(spark, sf, "pages")
    return p.select("page_id", "url",
                    F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


def q_new_articles(spark, sf):
    from quire.operators.sync import new_articles  # noqa: PLC0415

    cand = page_candidates(spark, sf)
    known = cand.filter(F.col("url").contains("/en/")).select("url")
    return new_articles(cand, known, key="url", order="page_id").select("url", "title")


QUERIES = {
    "token_counts": q_token_counts,
    "chunk_documents": q_chunk_documents,
    "chunk_whole": q_chunk_whole,
    "chunk_no_tokenizer": q_chunk_no_tokenizer,
    "chunk_audit": q_chunk_audit,
    "frontmatter_split": q_frontmatter_split,
    "frontmatter_map": q_frontmatter_map,
    "frontmatter_forms": q_frontmatter_forms,
    "chunk_ids": q_chunk_ids,
    "chunk_metadata": q_chunk_metadata,
    "metadata_json": q_metadata_json,
    "hashed_embedding": q_hashed_embedding,
    "where_filter": q_where_filter,
    "where_type_author": q_where_type_author,
    "knn_vectors": q_knn_vectors,
    "knn_filtered": q_knn_filtered,
    "knn_multi": q_knn_multi,
    "similarity": q_similarity,
    "relevance_filter": q_relevance_filter,
    "retrieve_text": q_retrieve_text,
    "retrieve_per_row_config": q_retrieve_per_row_config,
    "retrieval_report": q_retrieval_report,
    "retrieval_log": q_retrieval_log,
    "sources": q_sources,
    "context_prompt": q_context_prompt,
    "system_prompt": q_system_prompt,
    "history_replay": q_history_replay,
    "requests": q_requests,
    "chat_requests": q_chat_requests,
    "response_assembly": q_response_assembly,
    "running_response": q_running_response,
    "preview": q_preview,
    "classify": q_classify,
    "until_quit": q_until_quit,
    "settings_at": q_settings_at,
    "last_sources": q_last_sources,
    "shown_sources": q_shown_sources,
    "ingest_stats": q_ingest_stats,
    "add_chunks": q_add_chunks,
    "collection_count": q_collection_count,
    "new_articles": q_new_articles,
    "scan_files": q_scan_files,
    "stream_ingest": q_stream_ingest,
}

