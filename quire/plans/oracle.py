"""Independent SQL (DuckDB dialect) for every registered query.

Each statement restates the operator's semantics directly in SQL over the
provided tables: brute-force nearest neighbours, window functions for the
session state, string functions for the prompt text. Shared patterns come
from the same fixed values the Spark code uses.
"""

from __future__ import annotations

from quire.functions.text import WS_CLASS
from quire.operators.assemble import CONTEXT_HEADER, DEFAULT_MODEL, FALLBACK_SYSTEM_PROMPT, \
    MAX_TOKENS
from quire.operators.replay import FLOAT_RE, INT_RE
from quire.plans import sql_text as S
from quire.plans.catalog import EMBED_DIMS

NL = "chr(10)"
D = EMBED_DIMS
KEY_RE = r"^([^\s#:\-][^:]*?)\s*:(?:\s+|$)(.*)$"


def _json_full(x: str) -> str:
    """Python ``json.dumps`` of any string: printable ASCII kept (quote and
    backslash escaped), short escapes for \\b \\t \\n \\f \\r, every
    other character as \\uXXXX of its UTF-16 code units."""
    hx = "lpad(lower(hex({})), 4, '0')"
    ch = ("CASE WHEN unicode(c) = 34 THEN '\\\"' WHEN unicode(c) = 92 THEN '\\\\' "
          "WHEN unicode(c) BETWEEN 32 AND 126 THEN c "
          "WHEN unicode(c) = 8 THEN '\\b' WHEN unicode(c) = 9 THEN '\\t' "
          "WHEN unicode(c) = 10 THEN '\\n' WHEN unicode(c) = 12 THEN '\\f' "
          "WHEN unicode(c) = 13 THEN '\\r' "
          "WHEN unicode(c) < 65536 THEN '\\u' || " + hx.format("unicode(c)") + " "
          "ELSE '\\u' || " + hx.format("55296 + ((unicode(c) - 65536) >> 10)") +
          " || '\\u' || " + hx.format("56320 + ((unicode(c) - 65536) & 1023)") + " END")
    return (f"('\"' || array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), "
            f"lambda c: {ch}), '') || '\"')")


def _json(x: str) -> str:
    """Python json.dumps of an ASCII string (the test data's metadata)."""
    return ("('\"' || replace(replace(replace(replace(replace(" + x +
            ", '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
            " || '\"')")


# --- derived inputs ---------------------------------------------------------
def _articles(collide: bool = False) -> str:
    path = ("lang || '/' || CAST(doc_id AS VARCHAR) || '/doc_' || CAST(doc_id // 2 AS VARCHAR)"
            " || '.md'") if collide else "lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.md'"
    return f"""
    articles AS (
      SELECT {path} AS source_file,
             CASE WHEN lang = 'de' THEN text ELSE
               '---' || {NL} || 'title: Document ' || CAST(doc_id AS VARCHAR) || {NL} ||
               'type: ' || lang || {NL} || 'author: ' || source || {NL} ||
               'tags: [' || lang || ', ' || source || ']' || {NL} || '---' || {NL} || {NL} || text
             END AS text
      FROM documents)"""


def _scalar(v: str) -> str:
    return f"""(CASE
        WHEN regexp_matches({v}, '^".*"$') THEN regexp_extract({v}, '^"(.*)"$', 1)
        WHEN regexp_matches({v}, '^''.*''$') THEN replace(regexp_extract({v}, '^''(.*)''$', 1), '''''', '''')
        WHEN {v} IN ('yes','Yes','YES','true','True','TRUE','on','On','ON') THEN 'True'
        WHEN {v} IN ('no','No','NO','false','False','FALSE','off','Off','OFF') THEN 'False'
        WHEN {v} IN ('', '~', 'null', 'Null', 'NULL') THEN 'None'
        WHEN regexp_full_match({v}, '[-+]?(0|[1-9][0-9]*)') THEN CAST(CAST({v} AS BIGINT) AS VARCHAR)
        ELSE {v} END)"""


def _parsed(collide: bool = False) -> str:
    fm = S.FRONTMATTER
    return _articles(collide) + f""",
    parsed AS (
      SELECT source_file,
             CASE WHEN regexp_matches(text, {fm}) THEN coalesce(regexp_extract(text, {fm}, 1), '')
                  ELSE '' END AS fm,
             {S.strip(f"CASE WHEN regexp_matches(text, {fm}) THEN regexp_extract(text, {fm}, 2) ELSE text END")}
               AS content
      FROM articles),
    kv AS (
      SELECT source_file, content,
             list_transform(
               list_filter(string_split_regex(fm, '\\r?\\n'), lambda l: regexp_matches(l, {S.lit(KEY_RE)})),
               lambda l: {{'k': regexp_extract(l, {S.lit(KEY_RE)}, 1),
                          'v': {S.strip(f"regexp_extract(l, {S.lit(KEY_RE)}, 2)")}}}) AS raw
      FROM parsed),
    meta AS (
      SELECT source_file, content,
             list_transform(raw, lambda e: {{'k': e.k, 'v':
               CASE WHEN regexp_matches(e.v, '^\\[.*\\]$') THEN
                 array_to_string(list_transform(
                   list_filter(string_split(regexp_extract(e.v, '^\\[(.*)\\]$', 1), ','),
                               lambda s: {S.strip('s')} <> ''),
                   lambda s: {_scalar(S.strip('s'))}), ', ')
               ELSE {_scalar(S.strip("regexp_replace(e.v, '\\s+#.*$', '')"))} END}}) AS entries
      FROM kv)"""


def _chunks(collide: bool = False) -> str:
    return _parsed(collide) + "," + S.chunks_cte(
        "SELECT source_file, content FROM parsed") + f""",
    chunks AS (
      SELECT {S.stem('c.source_file')} || '_' || CAST(c.chunk_index AS VARCHAR) AS id,
             c.source_file, c.chunk_index, c.total_chunks, c.token_count, c.document,
             m.entries,
             list_extract(list_transform(list_filter(m.entries, lambda e: e.k = 'title'), lambda e: e.v), -1) AS title,
             list_extract(list_transform(list_filter(m.entries, lambda e: e.k = 'type'), lambda e: e.v), -1) AS type,
             list_extract(list_transform(list_filter(m.entries, lambda e: e.k = 'author'), lambda e: e.v), -1) AS author
      FROM _chunks c JOIN meta m USING (source_file))"""


def _embed(src: str, key: str, text: str, name: str) -> str:
    """Hashed bag-of-words vectors of ``text`` for rows of ``src``."""
    return f"""
    {name}_w AS (SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), {S.lit(S.WORD)})) AS w
                 FROM {src}),
    {name}_b AS (SELECT key, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {D} AS INTEGER) AS b,
                        count(*) AS c FROM {name}_w GROUP BY ALL),
    {name}_v AS (SELECT key, list(b) AS bs, list(c) AS cs, sum(c * c) AS ss FROM {name}_b GROUP BY key),
    {name} AS (
      SELECT s.{key} AS key,
             CASE WHEN v.ss IS NULL THEN list_transform(range({D}), lambda d: CAST(0.0 AS FLOAT))
             ELSE list_transform(range({D}), lambda d:
                    CAST(coalesce(list_extract(v.cs, list_position(v.bs, d)), 0)::DOUBLE
                         / sqrt(v.ss::DOUBLE) AS FLOAT)) END AS e
      FROM {src} s LEFT JOIN {name}_v v ON v.key = s.{key})"""


def _dist(a: str, b: str, dims: str) -> str:
    return (f"list_reduce(list_transform(range(1, {dims} + 1), lambda i: "
            f"({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)), "
            f"lambda x, y: x + y)")


def _questions(per_row: bool) -> str:
    cfg = """,
             CAST(1 + item_id % 7 AS INTEGER) AS n_results,
             CASE WHEN item_id % 4 = 0 THEN 0.6 WHEN item_id % 4 = 1 THEN 0.0 END::DOUBLE AS min_relevance,
             CASE WHEN item_id % 11 = 3 THEN 'no such type' WHEN item_id % 3 = 0 THEN 'en' WHEN item_id % 3 = 2 THEN 'fr' END AS filter_type,
             CASE WHEN item_id % 5 = 0 THEN 'src' || CAST(item_id % 20 AS VARCHAR) END AS filter_author
    """ if per_row else """,
             5 AS n_results, NULL::DOUBLE AS min_relevance, NULL::VARCHAR AS filter_type,
             NULL::VARCHAR AS filter_author"""
    return f"""
    questions AS (SELECT item_id AS query_id, text AS question {cfg} FROM benchmark)"""


def _text_results(per_row: bool, questions: str | None = None) -> str:
    return _chunks() + "," + (questions or _questions(per_row)) + "," + \
        _embed("chunks", "id", "document", "cemb") + "," + \
        _embed("questions", "query_id", "question", "qemb") + f""",
    cand AS (
      SELECT q.query_id, c.id, q.n_results, q.min_relevance,
             {_dist('qe.e', 'ce.e', str(D))} AS distance
      FROM questions q JOIN qemb qe ON qe.key = q.query_id
      JOIN chunks c ON (q.filter_type IS NULL OR q.filter_type = '' OR c.type = q.filter_type)
                   AND (q.filter_author IS NULL OR q.filter_author = '' OR c.author = q.filter_author)
      JOIN cemb ce ON ce.key = c.id),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank
      FROM cand),
    topk AS (
      SELECT r.*, 1.0 / (1.0 + r.distance) AS similarity,
             (r.min_relevance IS NULL OR 1.0 / (1.0 + r.distance) >= r.min_relevance) AS kept
      FROM ranked r WHERE r.rank <= r.n_results),
    results AS (
      SELECT t.*, c.source_file, c.chunk_index, c.total_chunks, c.document, c.entries, c.title,
             c.type
      FROM topk t JOIN chunks c USING (id) WHERE t.kept)"""


def _meta_json(entries: str, typed: bool) -> str:
    base = ""
    if typed:
        base = (f"['  \"source_file\": ' || {_json('source_file')}, "
                f"'  \"chunk_index\": ' || CAST(chunk_index AS VARCHAR), "
                f"'  \"total_chunks\": ' || CAST(total_chunks AS VARCHAR)]")
    fm = (f"list_transform({entries}, lambda e: '  ' || {_json('e.k')} || ': ' || {_json('e.v')})")
    items = f"list_concat({base}, {fm})" if typed else fm
    return (f"CASE WHEN len({items}) = 0 THEN '{{}}' ELSE "
            f"'{{' || {NL} || array_to_string({items}, ',' || {NL}) || {NL} || '}}' END")


def _session_log() -> str:
    return f"""
    conv AS (
      SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt
      FROM conversations),
    log AS (
      SELECT conv_id AS session_id, turn AS seq, text AS input,
             CASE WHEN nr = 'assistant' THEN nt END AS response
      FROM conv WHERE role = 'user')"""


def _classified(src: str) -> str:
    words = (f"list_filter(regexp_split_to_array(substr(line, 2), {S.lit(WS_CLASS + '+')}), "
             f"lambda w: w <> '')")
    return f"""
    cl0 AS (SELECT *, {S.strip('input')} AS line FROM {src}),
    cl1 AS (SELECT *, {words} AS words FROM cl0),
    classified AS (
      SELECT *,
        CASE WHEN line = '' THEN 'blank'
             WHEN NOT starts_with(line, '/') THEN 'question'
             WHEN lower(words[1]) IN ('quit', 'exit', 'q') THEN 'quit'
             WHEN lower(words[1]) IN ('help', 'config', 'sources', 'set', 'clear') THEN lower(words[1])
             ELSE 'unknown' END AS kind,
        CASE WHEN starts_with(line, '/') THEN words[2:] ELSE [] END AS args
      FROM cl1),
    q0 AS (
      SELECT *, coalesce(sum(CASE WHEN kind = 'quit' THEN 1 ELSE 0 END) OVER (
                  PARTITION BY session_id ORDER BY seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS quits_before
      FROM classified),
    processed AS (
      SELECT *, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER (
                  PARTITION BY session_id ORDER BY seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
      FROM q0 WHERE quits_before = 0)"""


def _history() -> str:
    return "WITH " + _session_log() + "," + _classified("log") + f""",
    hist AS (
      SELECT session_id, seq, line, kind,
        coalesce(sum(CASE WHEN kind = 'question' AND response IS NOT NULL THEN 1 ELSE 0 END) OVER w, 0) * 2
          AS history_len,
        list(CASE WHEN kind = 'question' AND response IS NOT NULL
                  THEN 'user: ' || line || {NL} || 'assistant: ' || response END) OVER w AS pairs
      FROM processed
      WINDOW w AS (PARTITION BY session_id, epoch ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _commands() -> str:
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
    ks = f"CAST({k} AS VARCHAR)"
    return f"""
    cmdlog AS (
      SELECT user_id AS session_id, event_id AS seq,
        CASE event_type
          WHEN 'view' THEN 'Tell me about topic ' || {ks}
          WHEN 'click' THEN CASE
            WHEN {k} < 40 THEN '/set n_results ' || {ks}
            WHEN {k} < 44 THEN '/set n_results ' || {ks} || '999999999999999999999'
            WHEN {k} < 46 THEN '/set n_results -' || {ks} || '999999999999999999999'
            WHEN {k} < 50 THEN '/set n_results x' || {ks}
            WHEN {k} < 60 THEN '  /SET N_RESULTS ' || CAST({k} - 55 AS VARCHAR)
            WHEN {k} < 70 THEN '/help'
            WHEN {k} < 80 THEN '/config'
            WHEN {k} < 90 THEN '/sources'
            ELSE '   ' END
          WHEN 'purchase' THEN CASE
            WHEN {k} < 25 THEN '/set min_relevance 0.' || {ks}
            WHEN {k} < 40 THEN '/set min_relevance none'
            WHEN {k} < 42 THEN '/set min_relevance -nan'
            WHEN {k} < 44 THEN '/set min_relevance +NaN'
            WHEN {k} < 50 THEN '/set min_relevance 1' || {ks}
            WHEN {k} < 55 THEN '/set filter_type en'
            WHEN {k} < 60 THEN '/set filter_type NONE'
            WHEN {k} < 70 THEN '/set filter_author src' || CAST({k} - 60 AS VARCHAR)
            WHEN {k} < 75 THEN '/set include_sources yes'
            WHEN {k} < 80 THEN '/set include_sources off'
            WHEN {k} < 90 THEN '/set n_results'
            ELSE '/set unknown_opt 3' END
          WHEN 'signup' THEN CASE WHEN {k} < 50 THEN '/clear' ELSE '/bogus' END
          ELSE CASE
            WHEN {k} < 10 THEN '/quit'
            WHEN {k} < 15 THEN '/ Exit now'
            ELSE 'why did ' || {ks} || ' fail?' END
        END AS input
      FROM events)"""


def _settings() -> str:
    opt = "lower(args[1])"
    val = "args[2]"
    is_set = "(kind = 'set' AND len(args) >= 2)"
    n_int = (f"coalesce(TRY_CAST(replace({val}, '_', '') AS BIGINT), "
             f"CASE WHEN {val} LIKE '-%' THEN 1 ELSE 9223372036854775807 END)")
    n_dbl = (f"CASE WHEN regexp_full_match({val}, '[+-]?(?i:nan)') THEN 'nan'::DOUBLE "
             f"ELSE TRY_CAST(replace({val}, '_', '') AS DOUBLE) END")
    return "WITH " + _commands() + "," + _classified("cmdlog") + f""",
    upd AS (
      SELECT *,
        CASE WHEN {is_set} AND {opt} = 'n_results' AND regexp_full_match({val}, {S.lit(INT_RE[2:-2])})
                  AND {n_int} IS NOT NULL
             THEN {{'v': CAST(greatest(1, {n_int}) AS BIGINT)}} END AS u_n,
        CASE WHEN {is_set} AND {opt} = 'min_relevance' AND lower({val}) = 'none'
               THEN {{'v': NULL::DOUBLE}}
             WHEN {is_set} AND {opt} = 'min_relevance' AND regexp_full_match({val}, {S.lit(FLOAT_RE[2:-2])})
                  AND {n_dbl} IS NOT NULL
               THEN {{'v': greatest(0.0, least(1.0, {n_dbl}))}} END AS u_r,
        CASE WHEN {is_set} AND {opt} = 'filter_type'
             THEN {{'v': CASE WHEN lower({val}) = 'none' THEN NULL ELSE {val} END}} END AS u_t,
        CASE WHEN {is_set} AND {opt} = 'filter_author'
             THEN {{'v': CASE WHEN lower({val}) = 'none' THEN NULL ELSE {val} END}} END AS u_a,
        CASE WHEN {is_set} AND {opt} = 'include_sources'
             THEN {{'v': lower({val}) IN ('true', '1', 'yes')}} END AS u_s
      FROM processed),
    folded AS (
      SELECT *,
        last_value(u_n IGNORE NULLS) OVER w AS l_n,
        last_value(u_r IGNORE NULLS) OVER w AS l_r,
        last_value(u_t IGNORE NULLS) OVER w AS l_t,
        last_value(u_a IGNORE NULLS) OVER w AS l_a,
        last_value(u_s IGNORE NULLS) OVER w AS l_s
      FROM upd
      WINDOW w AS (PARTITION BY session_id ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT session_id, seq, kind,
           CAST(CASE WHEN kind = 'set' THEN (u_n IS NOT NULL OR u_r IS NOT NULL OR u_t IS NOT NULL
                                         OR u_a IS NOT NULL OR u_s IS NOT NULL) END AS VARCHAR) AS set_ok,
           CASE WHEN l_n IS NULL THEN CAST(5 AS BIGINT) ELSE l_n.v END AS n_results,
           round(CASE WHEN l_r IS NULL THEN NULL ELSE l_r.v END, 6) AS min_relevance,
           CASE WHEN l_t IS NULL THEN NULL ELSE l_t.v END AS filter_type,
           CASE WHEN l_a IS NULL THEN NULL ELSE l_a.v END AS filter_author,
           CASE WHEN l_s IS NULL THEN TRUE ELSE l_s.v END AS include_sources
    FROM folded"""


def _fragments() -> str:
    return """
    frags AS (
      SELECT conv_id, turn, text, unnest(regexp_extract_all(text, '(?s).{1,16}')) AS frag,
             unnest(range(len(regexp_extract_all(text, '(?s).{1,16}')))) AS seq
      FROM conversations WHERE role = 'assistant')"""


def _vectors_knn(k: int, filtered: bool) -> str:
    on = "ON q.label = c.label" if filtered else "ON TRUE"
    return f"""
    WITH d AS (
      SELECT q.vec_id AS query_id, CAST(c.vec_id AS VARCHAR) AS id,
             {_dist('q.embedding', 'c.embedding', 'len(q.embedding)')} AS distance
      FROM embeddings q JOIN embeddings c {on}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER)
                      AS rank FROM d)
    """


def queries_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["token_counts"] = (f"SELECT doc_id, CAST(len({S.pieces('text')}) + 2 AS INTEGER) AS token_count "
                         f"FROM documents")
    q["chunk_documents"] = ("WITH " + _chunks() + "\nSELECT id, source_file, chunk_index, "
                            "total_chunks, token_count, document FROM chunks")
    q["chunk_whole"] = "WITH " + _parsed() + f"""
    SELECT {S.stem('source_file')} || '_0' AS id, source_file, 1 AS total_chunks,
           CAST(len({S.pieces('content')}) + 2 AS INTEGER) AS token_count, content AS document
    FROM meta WHERE content <> ''"""
    q["chunk_no_tokenizer"] = "WITH " + _parsed() + f"""
    SELECT {S.stem('source_file')} || '_0' AS id, source_file, 1 AS total_chunks,
           CAST(0 AS INTEGER) AS token_count, content AS document
    FROM meta WHERE content <> ''"""
    tail = ("CASE WHEN length(prev) > 50 THEN substr(prev, length(prev) - CAST(ceil(length(prev) / 5) "
            "AS INTEGER) + 1) ELSE prev END")
    head = ("CASE WHEN length(document) > 50 THEN substr(document, 1, length(document) // 3) "
            "ELSE document END")
    q["chunk_audit"] = "WITH " + _chunks() + f""",
    lagged AS (SELECT *, lag(document) OVER (PARTITION BY source_file ORDER BY chunk_index) AS prev
               FROM chunks),
    th AS (SELECT *, {tail} AS tl, {head} AS hd FROM lagged),
    ov AS (SELECT *, CASE WHEN prev IS NULL THEN NULL ELSE
             list_bool_or(list_transform(range(1, greatest(length(tl) - 9, 1) + 1),
                lambda o: length(substr(tl, o, 10)) >= 10 AND contains(hd, substr(tl, o, 10))))
             END AS overlap FROM th)
    SELECT source_file, CAST(count(*) AS INTEGER) AS n_chunks, max(total_chunks) AS total_chunks,
           max(token_count) AS max_token_count,
           CAST(sum(CASE WHEN token_count > 256 THEN 1 ELSE 0 END) AS INTEGER) AS oversized,
           CAST(sum(CASE WHEN {S.strip('document')} = '' THEN 1 ELSE 0 END) AS INTEGER) AS blank,
           CAST(sum(CASE WHEN overlap = FALSE THEN 1 ELSE 0 END) AS INTEGER) AS missing_overlap,
           max(chunk_index) + 1 = count(*) AS complete,
           CAST(ends_with(any_value(content), right(arg_max(document, chunk_index), 40)) AS VARCHAR)
             AS end_kept
    FROM ov JOIN parsed USING (source_file) GROUP BY source_file"""
    q["frontmatter_split"] = "WITH " + _parsed() + """
    SELECT source_file, fm, md5(content) AS content_md5, CAST(length(content) AS INTEGER) AS content_length
    FROM parsed"""
    q["frontmatter_map"] = "WITH " + _parsed() + f"""
    SELECT source_file, {_meta_json('entries', typed=False)} AS metadata_json FROM meta"""
    q["chunk_metadata"] = "WITH " + _chunks() + f"""
    SELECT id, {_meta_json('entries', typed=True)} AS metadata_json FROM chunks"""
    q["hashed_embedding"] = "WITH " + _chunks() + "," + _embed("chunks", "id", "document", "cemb") + f"""
    SELECT key AS id, CAST(len(list_filter(e, lambda x: x <> 0)) AS INTEGER) AS nnz,
           round(list_reduce(list_transform(range(1, {D} + 1), lambda i: e[i]::DOUBLE * i),
                             lambda x, y: x + y), 6) AS checksum
    FROM cemb"""
    q["where_filter"] = "WITH " + _chunks() + """
    SELECT id, source_file FROM chunks WHERE type = 'fr'"""
    q["where_type_author"] = "WITH " + _chunks() + """
    SELECT id, source_file FROM chunks WHERE type = 'en' AND author = 'src3'"""
    q["chunk_ids"] = "WITH " + _chunks() + """
    SELECT id, source_file, chunk_index FROM chunks"""
    first_words = "array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}]+')[1:6], ' ')"
    q["metadata_json"] = f"""
    WITH titled AS (
      SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.md' AS source_file,
             {first_words} AS title, lang FROM documents)
    SELECT source_file,
           '{{' || {NL} || '  "title": ' || {_json_full('title')} || ',' || {NL} ||
           '  "lang": ' || {_json_full('lang')} || {NL} || '}}' AS metadata_json
    FROM titled"""
    q["knn_multi"] = _vectors_knn(5, False) + """
    SELECT query_id, rank, id, round(distance, 6) AS distance FROM r
    WHERE rank <= 1 + query_id % 5"""
    q["similarity"] = _vectors_knn(3, False) + """
    SELECT query_id, rank, id, round(1.0 / (1.0 + distance), 6) AS similarity FROM r
    WHERE rank <= 3"""
    q["knn_vectors"] = _vectors_knn(5, False) + \
        "SELECT query_id, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 5"
    q["knn_filtered"] = _vectors_knn(3, True) + \
        "SELECT query_id, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 3"
    q["relevance_filter"] = _vectors_knn(5, False) + """
    SELECT query_id, rank, id, round(1.0 / (1.0 + distance), 6) AS similarity FROM r
    WHERE rank <= 5 AND 1.0 / (1.0 + distance) >= 0.5"""
    q["retrieve_text"] = "WITH " + _text_results(False) + """
    SELECT query_id, rank, id, round(distance, 6) AS distance FROM results"""
    q["retrieve_per_row_config"] = "WITH " + _text_results(True) + """
    SELECT query_id, rank, id, round(distance, 6) AS distance, round(similarity, 6) AS similarity
    FROM results"""
    q["retrieval_report"] = "WITH " + _text_results(True) + """,
    t2 AS (SELECT t.*, c.source_file FROM topk t JOIN chunks c USING (id))
    SELECT q.query_id, CAST(count(t2.id) AS INTEGER) AS n_returned,
           CAST(count(CASE WHEN kept THEN 1 END) AS INTEGER) AS n_kept,
           round(min(distance), 4) AS min_distance, round(max(distance), 4) AS max_distance,
           arg_min(coalesce(source_file, 'unknown'), rank) FILTER (t2.id IS NOT NULL) AS top_source
    FROM questions q LEFT JOIN t2 ON t2.query_id = q.query_id GROUP BY q.query_id"""
    q["retrieval_log"] = "WITH " + _text_results(True) + """
    SELECT t.query_id, t.rank, round(t.distance, 4) AS distance,
           coalesce(c.source_file, 'unknown') AS source_file, CAST(t.kept AS VARCHAR) AS kept
    FROM topk t JOIN chunks c USING (id)"""
    # Every form with a value from the table; the answers are written out.
    q["frontmatter_forms"] = f"""
    SELECT doc_id, source || ' #' || doc_id AS hash_title, source || ' # notes' AS single,
           source || '"' || chr(9) || chr(233) || lang AS escaped,
           source || ', ' || lang || ', ' || lang || chr(39) || 's, 7' AS flow,
           doc_id || '12345678901234567890' AS wide, '0.1234567890123456' AS long_float,
           CAST(n_chars AS VARCHAR) AS commented, lang || ' ' || source AS continued,
           lang || {NL} || source || {NL} AS literal, lang || ' ' || source || {NL} AS folded,
           source || ', ' || lang || ' x' AS items, lang AS quoted_key,
           CAST(16 * 256 + doc_id % 10 AS VARCHAR) AS hex, 'None' AS nothing, 'True' AS flag,
           CAST(12 * 60 + 3 AS VARCHAR) AS clock, length({S.strip('text')}) AS body_length
    FROM documents"""
    q["sources"] = "WITH " + _text_results(True) + """
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS position,
           coalesce(source_file, 'unknown') AS source_file,
           substr(coalesce(title, 'untitled'), 1, 40) AS title, coalesce(type, '') AS type
    FROM results"""
    ctx = "WITH " + _text_results(True) + f""",
    blocks AS (
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i,
             '--- Document ' || CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS VARCHAR)
             || ': ' || coalesce(title, 'Untitled') || ' ---' || {NL} || 'Metadata: '
             || {_meta_json('entries', typed=True)} || {NL} || document || {NL} AS block
      FROM results),
    ctx AS (
      SELECT query_id, {S.lit(CONTEXT_HEADER)} || {NL} || string_agg(block, {NL} ORDER BY i) AS context
      FROM blocks GROUP BY query_id),
    full_ctx AS (
      SELECT q.query_id, coalesce(c.context, '') AS context
      FROM questions q LEFT JOIN ctx c USING (query_id))"""
    q["context_prompt"] = ctx + "\nSELECT query_id, context FROM full_ctx"
    q["system_prompt"] = ctx + f"""
    SELECT query_id, CASE WHEN context <> '' THEN {S.lit(FALLBACK_SYSTEM_PROMPT)} || {NL} || {NL} || context
                          ELSE {S.lit(FALLBACK_SYSTEM_PROMPT)} END AS system
    FROM full_ctx"""
    hist_text = f"array_to_string(list_filter(pairs, lambda p: p IS NOT NULL), {NL})"
    q["history_replay"] = _history() + f"""
    SELECT session_id, seq, CAST(history_len AS INTEGER) AS history_len,
           coalesce({hist_text}, '') AS history_text
    FROM hist WHERE kind = 'question'"""
    q["requests"] = _history() + f"""
    SELECT session_id, seq, {S.lit(DEFAULT_MODEL)} AS model, {MAX_TOKENS} AS max_tokens,
           CAST(history_len + 1 AS INTEGER) AS n_messages,
           CASE WHEN history_len > 0 THEN {hist_text} || {NL} ELSE '' END || 'user: ' || line
             AS messages_text
    FROM hist WHERE kind = 'question'"""
    head, tail = _settings().rsplit("    SELECT session_id, seq, kind,", 1)
    head = head.replace("      FROM events)", """      FROM events),
    chatlog AS (SELECT *, CASE WHEN seq % 3 > 0 THEN 'answer ' || seq END AS response
                FROM cmdlog AS lines)""") \
        .replace("FROM cmdlog),", "FROM chatlog),")
    distinct = """
    texts AS (SELECT DISTINCT line AS text_id, line AS question FROM s WHERE kind = 'question'),
    questions AS (SELECT DISTINCT line, n_results, min_relevance, filter_type, filter_author
                  FROM s WHERE kind = 'question')"""
    # Questions with the settings in force at them, and their results.
    found = head + f""",
    s AS (SELECT line, response, epoch, session_id, seq, kind, {tail}),""" \
        + _chunks() + "," + distinct + "," + _embed("chunks", "id", "document", "cemb") + "," \
        + _embed("texts", "text_id", "question", "qemb") + f""",
    dist AS (SELECT qe.key AS line, c.id, c.type, c.author,
                    {_dist('qe.e', 'ce.e', str(D))} AS distance
             FROM qemb qe JOIN chunks c ON TRUE JOIN cemb ce ON ce.key = c.id),
    ranked AS (
      SELECT q.*, d.id, d.distance, row_number() OVER (
               PARTITION BY q.line, q.n_results, q.min_relevance, q.filter_type, q.filter_author
               ORDER BY d.distance, d.id) AS rank
      FROM questions q JOIN dist d ON d.line = q.line
       AND (q.filter_type IS NULL OR q.filter_type = '' OR d.type = q.filter_type)
       AND (q.filter_author IS NULL OR q.filter_author = '' OR d.author = q.filter_author)),
    results AS (
      SELECT r.line, r.n_results, r.min_relevance, r.filter_type, r.filter_author, r.rank,
             c.source_file, c.chunk_index, c.total_chunks, c.document, c.entries, c.title
      FROM ranked r JOIN chunks c USING (id) WHERE r.rank <= r.n_results
       AND (r.min_relevance IS NULL OR 1.0 / (1.0 + r.distance) >= r.min_relevance)),"""
    q["chat_requests"] = found + f"""
    blocks AS (
      SELECT *, row_number() OVER (PARTITION BY line, n_results, min_relevance, filter_type,
                                   filter_author ORDER BY rank) AS i FROM results),
    ctx AS (
      SELECT line, n_results, min_relevance, filter_type, filter_author, count(*) AS n,
             {S.lit(CONTEXT_HEADER)} || {NL} || string_agg(
               '--- Document ' || CAST(i AS VARCHAR) || ': ' || coalesce(title, 'Untitled')
               || ' ---' || {NL} || 'Metadata: ' || {_meta_json('entries', typed=True)} || {NL}
               || document || {NL}, {NL} ORDER BY i) AS context
      FROM blocks GROUP BY ALL),
    hist AS (
      SELECT *, coalesce(sum(CASE WHEN kind = 'question' AND response IS NOT NULL THEN 1 ELSE 0 END)
                         OVER w, 0) * 2 AS history_len,
             list(CASE WHEN kind = 'question' AND response IS NOT NULL
                       THEN 'user: ' || line || {NL} || 'assistant: ' || response END) OVER w AS pairs
      FROM s WINDOW w AS (PARTITION BY session_id, epoch ORDER BY seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT h.session_id, h.seq, {S.lit(DEFAULT_MODEL)} AS model, {MAX_TOKENS} AS max_tokens,
           md5({S.lit(FALLBACK_SYSTEM_PROMPT)}
               || coalesce({NL} || {NL} || c.context, '')) AS system_md5,
           CAST(coalesce(c.n, 0) AS INTEGER) AS n_sources,
           CAST(h.history_len + 1 AS INTEGER) AS n_messages,
           md5(CASE WHEN h.history_len > 0 THEN {hist_text} || {NL} ELSE '' END
               || 'user: ' || h.line) AS messages_md5
    FROM hist h LEFT JOIN ctx c ON c.line = h.line AND c.n_results = h.n_results
     AND c.min_relevance IS NOT DISTINCT FROM h.min_relevance
     AND c.filter_type IS NOT DISTINCT FROM h.filter_type
     AND c.filter_author IS NOT DISTINCT FROM h.filter_author
    WHERE h.kind = 'question'"""
    q["response_assembly"] = "WITH " + _fragments() + """
    SELECT conv_id, turn, string_agg(frag, '' ORDER BY seq) AS response,
           CAST(count(*) AS INTEGER) AS n_fragments,
           string_agg(frag, '' ORDER BY seq) = any_value(text) AS matches
    FROM frags GROUP BY conv_id, turn"""
    q["running_response"] = "WITH " + _fragments() + """,
    run AS (SELECT conv_id, turn, seq,
                   string_agg(frag, '' ORDER BY seq) OVER (PARTITION BY conv_id, turn ORDER BY seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
            FROM frags)
    SELECT conv_id, turn, CAST(seq AS INTEGER) AS seq, CAST(length(so_far) AS INTEGER) AS so_far_length,
           md5(so_far) AS so_far_md5 FROM run"""
    q["preview"] = """
    SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END
      AS preview FROM conversations"""
    q["classify"] = "WITH " + _commands() + "," + _classified("cmdlog") + """
    SELECT session_id, seq, kind, CAST(len(args) AS INTEGER) AS n_args FROM classified"""
    q["until_quit"] = "WITH " + _commands() + "," + _classified("cmdlog") + """
    SELECT session_id, seq, kind FROM processed"""
    q["settings_at"] = _settings()
    q["last_sources"] = "WITH " + _commands() + "," + _classified("cmdlog") + """,
    ls AS (SELECT *, last_value(CASE WHEN kind = 'question' THEN seq END IGNORE NULLS) OVER (
                  PARTITION BY session_id, epoch ORDER BY seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sources_of
           FROM processed)
    SELECT session_id, seq, CAST(sources_of AS VARCHAR) AS sources_of FROM ls WHERE kind = 'sources'"""
    q["shown_sources"] = found + """
    src AS (SELECT *, CAST(row_number() OVER (PARTITION BY line, n_results, min_relevance,
                           filter_type, filter_author ORDER BY rank) AS INTEGER) AS position
            FROM results),
    ls AS (SELECT session_id, seq, kind, last_value(CASE WHEN kind = 'question' THEN seq END
                  IGNORE NULLS) OVER (PARTITION BY session_id, epoch ORDER BY seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM s),
    shown AS (
      SELECT ls.session_id, ls.seq, q.* EXCLUDE (session_id, seq) FROM ls
      LEFT JOIN s AS q ON q.session_id = ls.session_id AND q.seq = ls.asked
      WHERE ls.kind = 'sources')
    SELECT h.session_id, h.seq, CAST(count(src.position) OVER (PARTITION BY h.session_id, h.seq)
             AS INTEGER) AS n_sources, src.position,
           CASE WHEN src.position IS NOT NULL THEN coalesce(src.source_file, 'unknown') END
             AS source_file,
           CASE WHEN src.position IS NOT NULL THEN substr(coalesce(src.title, 'untitled'), 1, 40)
           END AS title
    FROM shown AS h LEFT JOIN src ON src.line = h.line AND src.n_results = h.n_results
     AND src.min_relevance IS NOT DISTINCT FROM h.min_relevance
     AND src.filter_type IS NOT DISTINCT FROM h.filter_type
     AND src.filter_author IS NOT DISTINCT FROM h.filter_author"""
    q["ingest_stats"] = "WITH " + _chunks() + """
    SELECT (SELECT count(*) FROM documents) AS files_processed,
           (SELECT count(*) FROM chunks) AS chunks_added, 'documents' AS collection_name"""
    winners = "WITH " + _chunks(collide=True) + """,
    w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY string_split(source_file, '/')) AS rn
          FROM chunks)"""
    q["add_chunks"] = winners + "\nSELECT id, source_file, chunk_index FROM w WHERE rn = 1"
    q["collection_count"] = winners + "\nSELECT count(*) AS count FROM w WHERE rn = 1"
    q["stream_ingest"] = q["chunk_ids"]
    q["scan_files"] = "WITH " + _parsed() + """,
    named AS (SELECT *, CAST(regexp_extract(source_file, '([0-9]+)[.]md$', 1) AS BIGINT) AS key
              FROM articles)
    SELECT ['', '.git/', '_new/x y/', 'été+50%20/'][key % 4 + 1] || ['', '_', '.'][key % 3 + 1]
             || regexp_extract(source_file, '([^/]*)$', 1) AS source_file,
           CAST(strlen(text) AS BIGINT) AS length, md5(text) AS text_md5
    FROM named"""
    q["new_articles"] = """
    WITH cand AS (
      SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title
      FROM pages),
    fresh AS (SELECT * FROM cand WHERE url NOT IN (SELECT url FROM cand WHERE contains(url, '/en/')))
    SELECT url, arg_min(title, page_id) AS title FROM fresh GROUP BY url"""
    return q
