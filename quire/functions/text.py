"""Column expressions for text: strip, token pieces, counts, previews.

Every helper returns a ``Column`` built from built-in Spark functions, so it
stays inside whole-stage code generation and runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must not change: results depend on them)
# ---------------------------------------------------------------------------
# Python's str.strip() removes exactly the characters for which str.isspace()
# is true. This is that set, in code-point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Unicode White_Space as a regex class; the same spelling works in Java regex
# and in RE2, so the SQL oracle can use the identical pattern.
WS_CLASS = r"[\s\x{0b}\x{85}\p{Z}]"

# One token piece: the whitespace before a token, then the token. A token is a
# run of letters/marks/digits or one other visible character (punctuation,
# symbol). Concatenating all pieces of a text gives the text back minus its
# trailing whitespace, so a window of pieces maps to an exact substring.
TOKEN_PIECE = WS_CLASS + r"*(?:[\p{L}\p{M}\p{N}]+|[^\s\x{0b}\x{85}\p{Z}])"

# Word pattern used by the hashed embedding (on lower-cased text).
WORD = r"[\p{L}\p{M}\p{N}]+"

# Tokens added by the encoder around every sequence ([CLS] ... [SEP]).
SPECIAL_TOKENS = 2


def py_strip(col: Column | str) -> Column:
    """Python ``str.strip()``: trim the full Unicode whitespace set."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c, F.lit(PY_WHITESPACE))


def token_pieces(col: Column | str) -> Column:
    """``array<string>`` of token pieces (see ``TOKEN_PIECE``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit(TOKEN_PIECE), F.lit(0))


def token_count(col: Column | str, tokenizer: str | None = "pieces") -> Column:
    """Number of tokens including the two special tokens; 0 without tokenizer.

    Mirrors the reference: no truncation, special tokens counted.
    """
    if tokenizer is None:
        return F.lit(0)
    return F.size(token_pieces(col)) + F.lit(SPECIAL_TOKENS)


def preview(col: Column | str, n: int = 200) -> Column:
    """First ``n`` characters, with ``...`` appended when the text is longer."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))) \
        .otherwise(c)


def file_stem(col: Column | str) -> Column:
    """``Path(name).stem``: the file name without its last suffix."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(c, r"^(.+?)(\.[^.]+)?$", 1)


def json_string(col: Column | str) -> Column:
    """Render a string as a JSON literal the way Python ``json.dumps`` does.

    ASCII printable characters are kept, quote and backslash are escaped,
    the usual control characters get their short escapes and everything else
    becomes ``\\uXXXX`` (UTF-16 code units, so astral characters give a
    surrogate pair). Null renders as ``null``.
    """
    c = F.col(col) if isinstance(col, str) else col
    simple = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
                     ("\b", "\\b"), ("\f", "\\f")):
        simple = F.replace(simple, F.lit(raw), F.lit(esc))
    # Only strings with characters outside printable ASCII pay for the
    # per-character path.
    per_char = F.array_join(
        F.transform(
            F.regexp_extract_all(simple, F.lit(r"(?s)."), F.lit(0)),
            lambda ch: F.when(ch.rlike(r"\A[ -~]\z"), ch).otherwise(
                F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))),
                                 r"(.{4})", r"\\u$1")),
        ),
        "",
    )
    body = F.when(simple.rlike(r"\A[ -~]*\z"), simple).otherwise(per_char)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))
