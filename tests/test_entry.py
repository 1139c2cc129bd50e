"""Driver contract: entry runs, every query has a name-aligned SQL check, and
a sample of queries equals its SQL on the smallest provided tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["documents", "embeddings", "pages", "benchmark", "conversations", "events"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 40
    assert df.columns == ["query_id", "model", "max_tokens", "system", "messages_text"]


def test_every_query_has_sql():
    assert set(E.catalog.QUERIES) == set(E.queries_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def canon(records):
    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        return v
    return sorted(repr(tuple(norm(v) for _, v in sorted(r.items()))) for r in records)


@pytest.mark.parametrize("name", ["chunk_documents", "frontmatter_map", "knn_filtered",
                                  "retrieve_per_row_config", "context_prompt",
                                  "history_replay", "settings_at", "add_chunks"])
def test_query_equals_sql(spark, duck, name):
    s = [r.asDict() for r in E.queries()[name](spark, SF_SMALL).collect()]
    d = duck.sql(E.oracle_sql()[name]).df().to_dict("records")
    d = [{k: (None if v != v else v) if isinstance(v, float) else v for k, v in r.items()}
         for r in d]
    assert canon(s) == canon(d)


def test_intermediate_tables_are_dropped(spark):
    from quire.session import drop_tables, materialize

    drop_tables(spark)
    df = materialize(spark.range(3), "kept")
    assert df.count() == 3
    assert drop_tables(spark) == 1 and drop_tables(spark) == 0
