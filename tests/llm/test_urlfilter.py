"""URL verdicts: parsing, rules, list and Bloom filter."""

import re

from pyspark.sql import functions as F

from quire.llm import urlfilter as U
from quire.llm.queries import SQL, URL_RULES, op4_urlfilter

URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x", "http://a.example.org/en/1?x",
        "http://example.org/en/2#f", "http://notexample.org/es/", "http://x.com/fr/a",
        "http://x.com/de", "http://x.com/de/", "ftp://com/de/?q", "http://org/", "http://org",
        "http://h.net?x/y://z", "http://h.net#a/b", "http://user@h.net:80/p", "x://É.ORG/É"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host))
            and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, rule and rule.name, rule.verdict if rule else None


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)],
                                  "page_id long, url string, host string")
    got = U.judge(pages, pages.filter("false"), URL_RULES).orderBy("page_id").collect()
    for r, url in zip(got, URLS):
        host, path, rule, verdict = plain(url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_canonical(spark):
    same = ["http://www.Ab.com:80/p/?ref=x&utm_source=a#f", "https://ab.com/p.html", "x://ab.com/p"]
    other = ["http://ab.com/P", "http://ab.com/p?page=2", "http://ab.com/p?pref=1", None]
    rows = spark.createDataFrame([(u,) for u in same + other], "u string").select(
        U.canonical_url(F.col("u"))).collect()
    got = [r[0] for r in rows]
    assert set(got[:3]) == {"ab.com/p"}
    assert got[3:] == ["ab.com/P", "ab.com/p?page=2", "ab.com/p?pref=1", None]


def test_list_is_exact(spark):
    """Hits of the filter are checked: no listed URL passes, no other stops."""
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(
        F.lit("http://s.net/"), F.col("id") % 9000).alias("url"))
    listed = pages.filter("page_id % 7 = 0 and page_id < 9000").select("url")
    listed = listed.union(listed).union(spark.createDataFrame([(None,)], "url string"))
    got = U.judge(pages, listed, [])
    assert got.count() == 20_000
    wrong = got.filter((F.col("verdict") == "block") != (F.col("page_id") % 9000 % 7 == 0))
    assert wrong.count() == 0


def test_filter_rules_out_most_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("a"), "id").alias("u"))
    table, blocks = U.bloom_blocks(listed, "u", 5000)
    assert blocks == -(-5000 * U.BITS_PER_URL // 512)
    rows = spark.range(10_000).select(F.concat(F.lit("a"), "id").alias("u"), "id")
    maybe, ruled_out = U._split_by_filter(rows, "u", table, blocks)
    assert maybe.count() + ruled_out.count() == 10_000
    assert ruled_out.filter("id < 5000").count() == 0
    assert maybe.filter("id >= 5000").count() < 200


def test_empty_and_native(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c")],
                                  "page_id long, url string")
    assert [r.verdict for r in U.judge(pages, pages.select("url"), []).collect()] == ["block"] * 2
    assert U.judge(pages.filter("false"), pages.select("url"), []).count() == 0
    plan = U.judge(pages, pages.select("url"), URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(SQL["op4_urlfilter"])
    got = op4_urlfilter(spark, sf).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_clashing_names_and_null_urls(spark):
    pages = spark.createDataFrame([(i, None if i % 2 else f"http://h{i}.net/a") for i in range(40)],
                                  "page_id long, url string")
    for name in ("words", "_words", "block", "canonical", "listed"):
        pages = pages.withColumn(name, F.lit("x"))
    got = U.judge(pages, pages.filter("page_id = 4").select("url"), [])
    assert sorted(r.page_id for r in got.filter("verdict = 'block'").collect()) == [4]
    assert got.count() == 40 and got.filter("words = 'x'").count() == 40
