"""Physical-plan properties that matter at scale."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire.operators import retrieve
from quire.plans import catalog
from quire.sources.collection import first_writer


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted") \
        if hasattr(df._sc._jvm, "PythonSQLUtils") else plan_text(df)


def test_knn_has_no_pair_join_and_limits_before_shuffle(spark):
    corpus, qs = catalog._vectors(spark, SF_SMALL)
    top = retrieve.knn(corpus, qs, 5)
    p = plan_text(top)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p
    assert p.count("WindowGroupLimit") >= 2  # partial before and final after the shuffle
    assert "MapInArrow" in p


def test_knn_scan_reads_only_needed_columns(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    qs = e.select(F.col("vec_id").alias("query_id"), "embedding")
    p = plan_text(retrieve.knn(corpus, qs, 3))
    assert "label" not in p.split("MapInArrow")[-1]  # corpus scan prunes 'label'


def test_knn_grid_for_many_question_blocks(spark):
    """Beyond one block: a grid of cells, the corpus read once."""
    corpus, qs = catalog._vectors(spark, SF_SMALL)
    p = plan_text(retrieve.knn(corpus, qs, 3, max_broadcast_bytes=2_000))
    assert p.count("FlatMapCoGroupsInArrow") == 1 and "MapInArrow" not in p.replace(
        "FlatMapCoGroupsInArrow", "")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_reach_the_scan_of_a_stored_collection(spark, tmp_path):
    from quire.sources.collection import add_chunks, read_collection
    add_chunks(spark, catalog.chunks(spark, SF_SMALL, embedded=True), str(tmp_path), "c")
    coll = read_collection(spark, str(tmp_path), "c")
    r = retrieve.retrieve(coll, catalog.questions(spark, SF_SMALL), filter_type="fr")
    assert "EqualTo(type,fr)" in plan_text(r)
    assert {x.type for x in r.select(F.col("metadata")["type"].alias("type")).collect()} == {"fr"}


def test_retrieve_joins_back_with_broadcast(spark):
    coll = catalog.collection(spark, SF_SMALL)
    qs = catalog.questions(spark, SF_SMALL)
    p = plan_text(retrieve.retrieve(coll, qs))
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_chunking_is_narrow(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    arts = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))
                       .alias("source_file"), F.col("text").alias("content"))
    from quire.operators.chunking import chunk_by_tokens
    p = plan_text(chunk_by_tokens(arts))
    assert "Exchange" not in p  # no shuffle between scan and chunk rows
    assert "lang" not in p and "n_chars" not in p  # unused columns pruned at the scan


def test_whole_chunking_plan_has_no_exchange(spark):
    assert "Exchange" not in plan_text(catalog.q_chunk_documents(spark, SF_SMALL))


def test_first_writer_shuffles_ids_and_aggregates_repeats(spark):
    p = plan_text(first_writer(catalog._collided(spark, SF_SMALL)))
    assert "partial_count" in p  # repeated ids found from ids alone
    assert "partial_min_by" in p  # map-side combine before the shuffle
    assert "Window" not in p


def test_session_scans_are_blocked(spark):
    p = plan_text(catalog.q_settings_at(spark, SF_SMALL))
    assert "_blk" in p  # windows partitioned by (session, block)


def test_sync_aggregates_partially_and_broadcasts_known_urls(spark):
    p = plan_text(catalog.q_new_articles(spark, SF_SMALL))
    assert "partial_min_by" in p  # per-URL pick combined map-side
    assert "BroadcastHashJoin" in p and "LeftAnti" in p  # small known side: no shuffle


def test_session_log_answers_by_join_not_window(spark):
    p = plan_text(catalog.session_log(spark, SF_SMALL))
    assert "Window" not in p and "LeftOuter" in p
