"""URL verdicts: host and path rules, then a list of canonical URLs.

The list is tested with a blocked Bloom filter: every listed URL sets bits in
one 512-bit block (eight 64-bit words, one bit in each), so a probe reads one
row. Possible hits, and only those, go through an exact hash join with the
list, which removes the false positives. Everything is built from DataFrame
functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

WORDS = 8             # 64-bit words of a block; one bit is set in each
BITS_PER_URL = 16
FILTER_BYTES = 64 << 20  # a filter up to this size is broadcast, a larger one shuffled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (between ``://`` and the first ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased) and path (up to ``?``, ``#`` or the end). Both are empty
    for a null URL and one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and its subdomains below ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) \
            & path.startswith(self.path)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls. Of equally
    long rules the first stated wins."""
    name = verdict = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = rule.fits(host, path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def canonical_url(url: Column) -> Column:
    """One spelling of a URL: no scheme, ``www.`` or default port; host in
    lower case; path without a trailing ``/`` or ``.html``; query without
    tracking fields; no fragment. Null without ``://``."""
    host, path = split_url(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path, r"(\.html?|/+)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(utm_[^&=]*|ref|fbclid|gclid)(=[^&]*)?(?=&|$)", "")
    query = F.regexp_replace(query, r"^&+|&+$", "")
    return F.when(F.locate("://", url) > 0, F.concat(
        host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


# --- blocked Bloom filter -------------------------------------------------
def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("long")


def _word_bit(url: Column, i: int) -> Column:
    """The bit a URL sets in word ``i``, from six bits of a second hash."""
    h = F.xxhash64(F.lit(f"bit{i // 8}"), url)
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(
        h, 6 * (i % 8) + 7).bitwiseAND(F.lit(63)).cast("int"))


def bloom_blocks(listed: DataFrame, url: str, n: int) -> tuple[DataFrame, int]:
    """Filter table ``(block, words)`` for about ``n`` URLs, and its number
    of blocks."""
    blocks = max(1, -(-n * BITS_PER_URL // (64 * WORDS)))
    u = F.col(url)
    words = listed.groupBy(_block(u, blocks).alias("block")).agg(
        *[F.bit_or(_word_bit(u, i)).alias(f"w{i}") for i in range(WORDS)])
    return words.select("block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("words")), blocks


def _split_by_filter(rows: DataFrame, url: str, filter_table: DataFrame,
                     blocks: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose URL passes the filter, and those it rules out."""
    u, lead = F.col(url), "_"
    while any(c.startswith(lead) for c in rows.columns):
        lead += "_"
    block, words, maybe = (lead + name for name in ("block", "words", "maybe"))
    if blocks * WORDS * 8 <= FILTER_BYTES:
        filter_table = F.broadcast(filter_table)
    # Rows without a URL meet no block of the filter and are spread over many.
    probed = rows.withColumn(block, F.when(u.isNotNull(), _block(u, blocks)).otherwise(
        -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 12)))) \
        .join(filter_table.toDF(block, words), block, "left")
    passed = u.isNotNull()
    for i in range(WORDS):
        bit = _word_bit(u, i)
        passed &= F.coalesce(F.get(words, F.lit(i)).bitwiseAND(bit) == bit, F.lit(False))
    probed = probed.withColumn(maybe, passed).drop(block, words)
    return probed.filter(maybe).drop(maybe), probed.filter(~F.col(maybe)).drop(maybe)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url",
          listed_url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``canonical``, ``listed``, ``rule``
    and ``verdict``.

    A rule that fits decides; otherwise listed URLs are blocked and all others
    allowed. URLs are compared in canonical form; a null URL and one without
    ``://`` have an empty host and path, no canonical form, fit no rule and
    are allowed. Repeated rows stay, repeated or null listed URLs count once
    or not at all, empty tables are fine; columns of ``pages`` with the names
    of the new ones are replaced.
    """
    added = ["host", "path", "canonical", "listed", "rule", "verdict"]
    pages = pages.drop(*[c for c in added if c != url])
    known = materialize(listed.select(canonical_url(F.col(listed_url)).alias("canonical"))
                        .filter("canonical is not null").distinct(), "listed-urls")
    table, blocks = bloom_blocks(known, "canonical", known.count())
    rows = pages.withColumn("canonical", canonical_url(F.col(url)))
    maybe, ruled_out = _split_by_filter(rows, "canonical", table, blocks)
    exact = maybe.join(known.withColumn("listed", F.lit(True)), "canonical", "left")
    judged = exact.unionByName(ruled_out.withColumn("listed", F.lit(False)))
    host, path = split_url(F.col(url))
    judged = judged.withColumns({"host": host, "path": path,
                                 "listed": F.coalesce("listed", F.lit(False))})
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumns({"rule": name, "verdict": F.coalesce(
        verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))}) \
        .select(*pages.columns, *added)
