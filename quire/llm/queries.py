"""Registered queries of the corpus operators, and their SQL restatements
(DuckDB) where SQL can express them. Every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (decontam, embdedup, lexical, mixing, packing, pii, sharding, simhash,
                       tokenids, toxicity, urlfilter, warc, whitening)
from quire.llm.urlfilter import Rule
from quire.session import table_folder, table_path

# Demonstration key: a job that keeps real data apart passes its own.
PII_KEY = "pseudonym-key-1"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf, name))


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = table_folder(spark, "warc")
    pages = _t(spark, sf, "pages").select("page_id", "url",
                                          F.col("html").cast("binary").alias("payload"))
    warc.write_archive(pages, path, "page_id", min_bytes=0)
    return warc.read_archive(spark, path).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        "refers_to")


def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select(
        "doc_id", "text", F.size("pii").alias("n_replaced"),
        F.array_join(F.col("pii.kind"), ",").alias("kinds"))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_t(spark, sf, "documents"))


URL_RULES = [Rule("allow", "org"), Rule("block", "example.org", "/es/"),
             Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"),
             Rule("block", "com", "/de/")]
# Hosts whose pages make up the list of unwanted URLs.
UNWANTED_HOSTS = "casino|spam|pills|adult"


def op4_urlfilter(spark: SparkSession, sf: str) -> DataFrame:
    pages = _t(spark, sf, "pages").select("page_id", "url")
    host, _ = urlfilter.split_url(F.col("url"))
    listed = pages.filter(host.rlike(UNWANTED_HOSTS)).select("url")
    return urlfilter.judge(pages, listed, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.simhash_components(_t(spark, sf, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                        "component_id")


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_documents(_t(spark, sf, "documents"), _t(spark, sf, "labels"))


SHARDS = 40


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    dims = {"id": F.col("doc_id"), "length": F.length("text"),
            "source": F.regexp_extract("source", r"(\d{1,9})", 1).try_cast("long"),
            "lang": F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))}
    return kd_rows(sharding.kd_shards(docs, dims, shards=SHARDS))


def kd_rows(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                          "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_passages(_t(spark, sf, "documents"), _t(spark, sf, "benchmark"))


def op9_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embdedup.near_duplicates(_t(spark, sf, "embeddings"), cosine=0.9)


END_ID = 2


def op10_token_ids(spark: SparkSession, sf: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers  # noqa: PLC0415

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = table_folder(spark, "tokens")
    tokenids.write_tokens(_t(spark, sf, "documents"), path, tokenizer, END_ID)
    return tokenids.read_tokens(spark, path, with_ids=False)


def op11_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_t(spark, sf, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(_t(spark, sf, "documents"), _t(spark, sf, "benchmark"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_t(spark, sf, "embeddings"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_urlfilter": op4_urlfilter,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_token_ids": op10_token_ids,
    "op11_mixing": op11_mixing,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
}

_SQL_SPLIT = """
    CASE WHEN contains(coalesce(url, ''), '://')
         THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest"""

_SQL_CANONICAL = r"""
    CASE WHEN contains(url, '://') THEN
      regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(path, '(\.html?|/+)$', '')
      || CASE WHEN query <> '' THEN '?' || query ELSE '' END END"""

_SQL_TERMS = (f"regexp_extract_all(translate(text, '{urlfilter.UPPER}', '{urlfilter.LOWER}'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


def _sql_cut(k: int, levels: int) -> str:
    """Steps of one length level and the step at which its sample ends."""
    below = " + ".join(f"in{j}" for j in range(k, levels))
    return f"""
aim{k} AS (SELECT pos, aim * in{k} / ({below}) AS aim FROM left{k} WHERE in{k} > 0),
steps{k} AS (
  SELECT pos, rank, size, count(*) AS n FROM ranked WHERE open AND level = {k} GROUP BY ALL),
run{k} AS (SELECT s.*, aim, sum(n * size) OVER (PARTITION BY s.pos ORDER BY rank, size) AS upto
           FROM steps{k} AS s JOIN aim{k} USING (pos)),
cut{k} AS (
  SELECT *, upto - n * size AS before,
    greatest(0, least(n, round((aim - (upto - n * size)) / size)))::BIGINT AS take FROM run{k}
  QUALIFY row_number() OVER (PARTITION BY pos ORDER BY upto < aim,
    CASE WHEN upto < aim THEN -rank ELSE rank END, CASE WHEN upto < aim THEN -size ELSE size END)
    = 1),
left{k + 1} AS (SELECT l.* REPLACE (l.aim - coalesce(before + take * c.size, 0) AS aim)
               FROM left{k} AS l LEFT JOIN cut{k} AS c USING (pos))"""


def _sql_mixing() -> str:
    n = len(mixing.LEVELS) + 1
    whens = " ".join(f"WHEN size > target * {share!r} THEN {k}"
                     for k, share in enumerate(mixing.LEVELS))
    words = ", ".join(f"coalesce(sum(size) FILTER (WHERE open AND level = {k}), 0) AS in{k}"
                      for k in range(n))
    cuts = ",".join(_sql_cut(k, n) for k in range(n)).lstrip()
    every = " UNION ALL ".join(
        f"SELECT pos, {k} AS level, rank, size, take, n FROM cut{k}" for k in range(n))
    return rf"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(concat_ws(chr(31), '{mixing.SEED}', doc_id::VARCHAR, text)), 1, 13))::BIGINT
     + 0.5) / {1 << 52} AS u FROM documents),
placed AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos,
             1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
           FROM sized GROUP BY source),
filling AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, pos) AS nth,
    ((SELECT sum(source_size) FROM placed) - coalesce(sum(3 * source_size) OVER (
      ORDER BY source_size / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
    / (sum(w) OVER (ORDER BY source_size / w, pos
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS height
  FROM placed),
height AS (SELECT min_by(height, nth) AS height FROM filling WHERE 3 * source_size >= w * height),
targets AS (SELECT source, source_size, pos,
              least(w * (SELECT height FROM height), (3 * source_size)::DOUBLE) AS target FROM placed),
wanted AS (
  SELECT s.*, pos, source_size, target, CASE WHEN source_size > 0
      THEN least(target / source_size::DOUBLE, 3.0) ELSE 0 END AS wanted,
    floor(CASE WHEN source_size > 0 THEN least(target / source_size::DOUBLE, 3.0) ELSE 0 END)
      ::BIGINT AS whole,
    CASE {whens} ELSE {n - 1} END AS level
  FROM sized AS s JOIN targets AS t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, (u * (1 - (wanted - whole)))
      / (u * (1 - (wanted - whole)) + (wanted - whole) * (1 - u)) AS rank,
    whole < 3 AND size > 0 AS open FROM wanted),
left0 AS (SELECT pos, greatest(any_value(target) - sum(whole * size)::BIGINT, 0.0) AS aim, {words}
          FROM ranked GROUP BY pos),
{cuts},
told AS (
  SELECT r.doc_id, r.source, r.size, source_size, target, r.pos, whole, r.rank, open, l.aim AS gap,
    CASE WHEN NOT open THEN 0
      WHEN (r.rank, r.size) < (c.rank, c.size) THEN 1
      WHEN r.rank = c.rank AND r.size = c.size AND c.take = c.n THEN 1 ELSE 0 END AS more
  FROM ranked AS r LEFT JOIN ({every}) AS c ON r.pos = c.pos AND r.level = c.level
  JOIN left{n} AS l ON r.pos = l.pos),
last AS (SELECT pos, doc_id AS last FROM told
  WHERE open AND more = (gap < 0)::INT AND abs(abs(gap) - size) < abs(gap)
  QUALIFY row_number() OVER (PARTITION BY pos ORDER BY abs(abs(gap) - size), rank, doc_id) = 1),
final AS (SELECT t.*, whole + CASE WHEN doc_id = last THEN 1 - more ELSE more END AS copies
          FROM told AS t LEFT JOIN last USING (pos))
SELECT doc_id, source, size, source_size, target, copies::INTEGER AS copies,
  (copies * size)::BIGINT AS taken FROM final"""


SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex,
             min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5))::INT)
            >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""",
    "op4_urlfilter": f"""
WITH a AS (SELECT page_id, url, {_SQL_SPLIT} FROM pages),
b AS (SELECT page_id, url,
        translate(regexp_extract(rest, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}')
          AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        regexp_replace(regexp_replace(
            regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1),
            '(^|&)(utm_[^&=]*|ref|fbclid|gclid)(=[^&]*)?\\b', '', 'g'),
          '^&+|&+$', '', 'g') AS query FROM a),
c AS (SELECT *, {_SQL_CANONICAL} AS canonical FROM b),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '{UNWANTED_HOSTS}')
           AND canonical IS NOT NULL),
d AS (SELECT c.*, listed.canonical IS NOT NULL AS listed,
        CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
                  AND starts_with(path, '/en/1') THEN 'example.org/en/1'
             WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
                  AND starts_with(path, '/es/') THEN 'example.org/es/'
             WHEN (host = 'com' OR ends_with(host, '.com'))
                  AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN (host = 'com' OR ends_with(host, '.com'))
                  AND starts_with(path, '/de/') THEN 'com/de/'
             WHEN (host = 'org' OR ends_with(host, '.org'))
                  AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM c LEFT JOIN listed ON c.canonical = listed.canonical)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block'
       WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, canonical, listed
FROM d""",
    "op11_mixing": _sql_mixing(),
    "op12_lexical_search": f"""
WITH words AS (SELECT doc_id, {_SQL_TERMS} AS ts FROM documents),
stats AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs,
                 coalesce(sum(len(ts)), 0)::BIGINT AS n_all FROM words),
wanted AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS t FROM benchmark),
each AS (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM words),
tfs AS (SELECT doc_id, n, t, count(*) AS tf FROM each WHERE t IN (SELECT t FROM wanted)
        GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT
                   AS w FROM tfs, stats GROUP BY t),
parts AS (SELECT doc_id, t, w * ((1000000000 * tf)
                 // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_all))) AS s
          FROM tfs JOIN weights USING (t), stats),
scores AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM wanted JOIN parts USING (t)
           GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
           FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
