"""SQL building blocks shared by the independent SQL checks (DuckDB dialect).

The SQL here restates each operator's semantics without Spark, using the same
fixed patterns, so a mismatch points at a real difference in behaviour.
"""

from __future__ import annotations

from quire.functions.text import PY_WHITESPACE, TOKEN_PIECE, WORD
from quire.operators.chunking import MAX_TOKENS, STRIDE, window_plan
from quire.operators.frontmatter import FRONTMATTER_RE


def lit(s: str) -> str:
    """A standard SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {lit(PY_WHITESPACE)})"


def pieces(expr: str) -> str:
    return f"regexp_extract_all({expr}, {lit(TOKEN_PIECE)})"


def words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {lit(WORD)})"


def n_windows(n: str, max_tokens: int = MAX_TOKENS, stride: int = STRIDE) -> str:
    body, step = window_plan(max_tokens, stride)
    return (f"(CASE WHEN {n} <= 0 THEN 0 WHEN {n} <= {body} THEN 1 "
            f"ELSE 1 + CAST(ceil(({n} - {body}) / {float(step)}) AS INTEGER) END)")


def chunks_cte(source_sql: str, max_tokens: int = MAX_TOKENS, stride: int = STRIDE) -> str:
    """CTE body producing ``source_file, chunk_index, total_chunks, document,
    token_count`` from a query with ``source_file, content``."""
    body, step = window_plan(max_tokens, stride)
    return f"""
    _tok AS (SELECT source_file, {pieces('content')} AS p FROM ({source_sql}) s),
    _win AS (SELECT source_file, p, {n_windows('len(p)', max_tokens, stride)} AS nw FROM _tok),
    _idx AS (SELECT source_file, p, unnest(range(nw)) AS w FROM _win),
    _raw AS (
      SELECT source_file, w,
             {strip(f"array_to_string(list_slice(p, w * {step} + 1, w * {step} + {body}), '')")}
               AS document,
             len(list_slice(p, w * {step} + 1, w * {step} + {body})) + 2 AS token_count
      FROM _idx),
    _chunks AS (
      SELECT source_file,
             CAST(row_number() OVER (PARTITION BY source_file ORDER BY w) - 1 AS INTEGER)
               AS chunk_index,
             CAST(count(*) OVER (PARTITION BY source_file) AS INTEGER) AS total_chunks,
             document, CAST(token_count AS INTEGER) AS token_count
      FROM _raw WHERE document <> '')"""


def stem(expr: str) -> str:
    return f"regexp_extract(regexp_extract({expr}, '([^/]*)$', 1), '^(.+?)(\\.[^.]+)?$', 1)"


FRONTMATTER = lit(FRONTMATTER_RE)
