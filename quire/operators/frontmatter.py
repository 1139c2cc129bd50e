"""Frontmatter: split a markdown text into its metadata block and body (C1),
and turn the block into ``map<string,string>`` (C2).

The split is one anchored regex per row. The map comes in two flavours:

* ``mode="flat"`` -- native Spark expressions: scalars with their YAML 1.1
  types, quoted strings with escapes, ``[a, "b, c"]`` flow lists, ``- item``
  block lists, folded and continued values, ``|`` and ``>`` blocks, quoted
  keys, comments. No Python worker. What lies outside of this (nested
  mappings, anchors, tags, zoned timestamps) is kept as text and can be told
  by :func:`frontmatter_covered`.
* ``mode="yaml"`` -- full YAML through a pandas UDF over the block column
  only (the body never leaves the JVM). Needs PyYAML on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import WS_CLASS, py_strip

# Group 1: the block between the opening and the closing ``---`` lines (may
# be absent when the block is empty); group 2: the rest after the closing
# line. The opening line must be the first non-blank line. Without a closed
# block the whole text is the body. Same spelling in Java regex and RE2.
FRONTMATTER_RE = (
    r"(?s)\A" + WS_CLASS + r"*-{3,}[ \t]*\r?\n(.*?\n)?-{3,}[ \t]*(\r?\n.*)?\z"
)
# The same block without the body: the match ends at the closing line, so
# finding it costs the size of the block, not of the document.
FRONTMATTER_HEAD_RE = (
    r"(?s)\A" + WS_CLASS + r"*-{3,}[ \t]*\r?\n(.*?\n)?-{3,}[ \t]*(?:\r?\n|\z)"
)

# YAML 1.1 words PyYAML reads as booleans and nulls.
YAML_TRUE = ["yes", "Yes", "YES", "true", "True", "TRUE", "on", "On", "ON"]
YAML_FALSE = ["no", "No", "NO", "false", "False", "FALSE", "off", "Off", "OFF"]
YAML_NULL = ["", "~", "null", "Null", "NULL"]


def split_frontmatter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``fm`` (raw block, ``''`` if none) and ``content`` (stripped body).

    Only the head of the text is matched; the body is the substring after
    the matched head, so no regex runs over the whole document.
    """
    t = F.col(text_col)
    staged = df.withColumn("_fm_head", F.regexp_extract(t, FRONTMATTER_HEAD_RE, 0))
    head = F.col("_fm_head")
    has = head != ""
    return (staged
            .withColumn("fm", F.when(has, F.regexp_extract(head, FRONTMATTER_HEAD_RE, 1))
                        .otherwise(F.lit("")))
            .withColumn("content", py_strip(
                F.when(has, F.substr(t, F.length(head) + 1)).otherwise(t)))
            .drop("_fm_head"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _py_float(v: Column) -> Column:
    """Python ``repr`` of a double: digits and decimal point of its shortest
    form, with an exponent below 1e-4 and from 1e16 on."""
    def written(x: Column) -> Column:
        text = F.abs(x).cast("string")
        mantissa, exponent = F.substring_index(text, "E", 1), F.regexp_extract(text, "E(.*)", 1)
        whole = F.substring_index(mantissa, ".", 1)
        fraction = F.regexp_extract(mantissa, r"\.(.*)", 1)
        joined = F.regexp_replace(F.concat(whole, fraction), "^0+", "")
        zeros = F.length(F.concat(whole, fraction)) - F.length(joined)
        # The value is 0.<digits> * 10 ** point.
        point = F.length(whole) - zeros + F.coalesce(exponent.try_cast("int"), F.lit(0))
        return _let(F.struct(F.regexp_replace(joined, "0+$", "").alias("d"), point.alias("p")),
                    digits)

    def digits(n: Column) -> Column:
        d, p = n["d"], n["p"]
        size = F.length(d)
        power = F.lpad(F.abs(p - 1).cast("string"), F.greatest(
            F.lit(2), F.length(F.abs(p - 1).cast("string"))), F.lit("0"))
        return (F.when(d == "", F.lit("0.0"))
                .when((p < -3) | (p > 16), F.concat(
                    F.substring(d, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substr(
                        d, F.lit(2)))).otherwise(""), F.lit("e"),
                    F.when(p - 1 < 0, "-").otherwise("+"), power))
                .when(p <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
                .when(p >= size, F.concat(d, F.repeat(F.lit("0"), p - size), F.lit(".0")))
                .otherwise(F.concat(F.substr(d, F.lit(1), p), F.lit("."), F.substr(d, p + 1))))
    return _let(v, lambda x: F.when(F.abs(x) == float("inf"), F.lit("inf"))
                .otherwise(written(x)))


LIMB = 1_000_000_000  # numbers of any size are kept as base-1e9 digits, the last ones first


def _chunks(digits: Column, n: int) -> Column:
    """Digits in groups of ``n`` from the right."""
    filled = F.lpad(digits, F.ceil(F.length(digits) / n).cast("int") * n, "0")
    return F.regexp_extract_all(filled, F.lit(f".{{{n}}}"), F.lit(0))


def _times_plus(limbs: Column, times: int, plus: Column) -> Column:
    """``limbs * times + plus``, both below ``LIMB``."""
    start = F.struct(plus.cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        v = x * F.lit(times).cast("long") + s["carry"]
        return F.struct(F.floor(F.call_function("div", v, F.lit(LIMB).cast("long"))).alias("carry"),
                        F.concat(s["out"], F.array(v % LIMB)).alias("out"))
    return F.aggregate(limbs, start, step, lambda s: F.when(
        s["carry"] > 0, F.concat(s["out"], F.array(s["carry"]))).otherwise(s["out"]))


def _decimal(limbs: Column) -> Column:
    """Limbs as decimal digits without leading zeros."""
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(
        x.cast("string"), 9, "0")), "")
    bare = F.regexp_replace(text, r"\A0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def _based(digits: Column, base: int) -> Column:
    """Digits of a base as a decimal number of any size."""
    n = {2: 24, 8: 9, 16: 7}[base]
    return _decimal(F.aggregate(
        _chunks(digits, n), F.array().cast("array<long>"),
        lambda a, c: _times_plus(a, base ** n, F.conv(c, base, 10).cast("long"))))


def _sexagesimal(v: Column) -> Column:
    """``12:30:45`` as the number of its last unit."""
    parts = F.split(v, ":")
    first = F.reverse(F.transform(_chunks(F.element_at(parts, 1), 9), lambda x: x.cast("long")))
    return _decimal(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), first,
                                lambda a, c: _times_plus(a, 60, c.try_cast("long"))))


def _plain_to_py_str(v: Column) -> Column:
    """``str(value)`` of a YAML 1.1 plain scalar (the implicit types of
    PyYAML): booleans, nulls, integers of any size, floats. Anything else,
    dates included, stays as written."""
    sign = F.when(v.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    bare = F.replace(F.regexp_replace(v, r"^[-+]", ""), F.lit("_"), F.lit(""))

    def signed(digits: Column) -> Column:
        return F.coalesce(F.when(digits == "0", F.lit("0")).otherwise(F.concat(sign, digits)), v)
    number = bare.try_cast("double")
    numeric = (F.when(v.rlike(r"\A[-+]?(0|[1-9][0-9_]*)\z"), signed(bare))
                .when(v.rlike(r"\A[-+]?0[0-7_]+\z"), signed(_based(bare, 8)))
                .when(v.rlike(r"\A[-+]?0x[0-9a-fA-F_]+\z"),
                      signed(_based(F.substr(bare, F.lit(3)), 16)))
                .when(v.rlike(r"\A[-+]?0b[01_]+\z"), signed(_based(F.substr(bare, F.lit(3)), 2)))
                .when(v.rlike(r"\A[-+]?[1-9][0-9_]*(?::[0-5]?[0-9])++\z"), signed(_sexagesimal(bare)))
                .when(v.rlike(r"\A[-+]?\.(inf|Inf|INF)\z"), F.concat(sign, F.lit("inf")))
                .when(v.rlike(r"\A\.(nan|NaN|NAN)\z"), F.lit("nan"))
                .when(v.rlike(r"\A([-+]?[0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)?"
                              r"|\.[0-9][0-9_]*([eE][-+][0-9]+)?)\z"),
                      F.coalesce(F.concat(sign, _py_float(number)), v))
                .otherwise(v))
    return (F.when(v.isin(*YAML_TRUE), F.lit("True"))
             .when(v.isin(*YAML_FALSE), F.lit("False"))
             .when(v.isin(*YAML_NULL), F.lit("None"))
             # only text starting like a number pays for the numeric patterns
             .when(F.substring(v, 1, 1).isin(*list("0123456789+-.")), numeric)
             .otherwise(v))


# What follows the backslash in a double-quoted YAML string.
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v",
           "f": "\f", "r": "\r", "e": "\x1b", "N": "\x85", "_": "\xa0", "L": "\u2028",
           "P": "\u2029"}


def _unescape(v: Column) -> Column:
    """Body of a double-quoted string with its escapes decoded."""
    def one(x: Column) -> Column:
        kind, code = F.substring(x, 2, 1), F.substr(x, F.lit(3))
        out = F.when(~x.startswith("\\"), x) \
            .when((kind == "x") & (F.length(x) == 4),
                  F.decode(F.unhex(F.concat(F.lit("00"), code)), "UTF-16BE")) \
            .when((kind == "u") & (F.length(x) == 6), F.decode(F.unhex(code), "UTF-16BE")) \
            .when((kind == "U") & (F.length(x) == 10), F.decode(F.unhex(code), "UTF-32"))
        for name, char in ESCAPES.items():
            out = out.when(kind == name, F.lit(char))
        return out.otherwise(kind)
    parts = F.regexp_extract_all(v, F.lit(
        r"(?s)\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)|[^\\]+"), F.lit(0))
    return F.when(v.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(v)


DOUBLE_QUOTED, SINGLE_QUOTED = r'"(?:[^"\\]|\\.)*+"', r"'(?:[^']|'')*+'"
TRAILER = r"[ \t]*(?:[ \t]#.*)?"  # blanks and a comment after a value


def _scalar_to_py_str(v: Column) -> Column:
    """``str(value)`` of one trimmed scalar, quoted or plain, which a comment
    may follow. Line breaks are folded already."""
    quoted = {'"': (DOUBLE_QUOTED, _unescape),
              "'": (SINGLE_QUOTED, lambda x: F.replace(x, F.lit("''"), F.lit("'")))}
    out = None
    for mark, (pattern, read) in quoted.items():
        whole = v.rlike(rf"(?s)\A{pattern}{TRAILER}\z")
        text = read(F.regexp_extract(v, rf"(?s)\A{mark}((?:{pattern[1:-1]})){mark}", 1))
        out = (F if out is None else out).when((F.substring(v, 1, 1) == mark) & whole, text)
    return out.otherwise(_plain_to_py_str(py_strip(F.regexp_replace(v, r"(?:^|[ \t])#.*$", ""))))


# One entry: a plain or quoted key at the start of a line, the rest of that
# line, and the lines that belong to it (indented, blank, ``- item`` or
# comment lines); blanks at the ends are stripped later. Groups: 1 key, 2 inline value, 3 following lines. The lines
# are repeated without going back (``*+``), which the engine does in a loop:
# an entry may have any number of them.
KEY = rf"{DOUBLE_QUOTED}|{SINGLE_QUOTED}|[^\s#:\-\"'\[\]{{}}&*!|>%@`,?][^:\r\n]*+|-[^\s:][^:\r\n]*+"
KV_RE = (rf"(?m)^({KEY})[ \t]*:(?:[ \t]+([^\r\n]*+))?\r?$"
         r"((?:\r?\n(?:[ \t]+[^\r\n]*|-(?:[ \t][^\r\n]*)?|#[^\r\n]*)?(?=\r?\n|\r?\z|\z))*+)")
ITEM_RE = r"(?m)^[ \t]*-[ \t]+([^\r\n]*+)\r?$"
FLOW_ITEM_RE = rf"\s*((?:{DOUBLE_QUOTED}|{SINGLE_QUOTED}|[^,\"'\s][^,]*?)?)\s*(?:,|\z)"


def _folded(v: Column) -> Column:
    """Line breaks inside a value: one is a space, blank lines stay breaks."""
    blanks = r"(?<![ \t])[ \t]*+"  # from the first blank of a run on only
    return F.regexp_replace(
        F.regexp_replace(v, blanks + r"\r?\n(?:[ \t]*\r?\n)[ \t]*", "\n"),
        blanks + r"\r?\n[ \t]*", " ")


def _block_scalar(header: Column, lines: Column) -> Column:
    """``|`` and ``>`` blocks without more-indented lines."""
    # Split and indent once, not again for every line.
    parts = F.struct(F.split(lines, r"\r?\n").alias("lines"),
                     F.regexp_extract(lines, r"\n([ \t]+)[^\s]", 1).alias("indent"))
    rows = _let(parts, lambda p: F.transform(
        F.slice(p["lines"], F.lit(2), F.greatest(F.size(p["lines"]), F.lit(1))),
        lambda x: F.when(py_strip(x) == "", F.lit("")).otherwise(F.when(
            x.startswith(p["indent"]), F.substr(x, F.length(p["indent"]) + 1)).otherwise(x))))
    text = F.regexp_replace(F.array_join(rows, "\n"), r"(?<!\n)\n+\z", "")
    fold = F.regexp_replace(F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " "), r"\n(\n+)", "$1")
    body = F.when(header.startswith(">"), fold).otherwise(text)
    tail = F.when(header.contains("-") | (body == ""), F.lit("")) \
        .when(header.contains("+"), F.concat(F.lit("\n"), F.regexp_extract(
            F.array_join(rows, "\n"), r"[^\n](\n*)\z", 1))).otherwise(F.lit("\n"))
    return F.concat(body, tail)


def _no_comment(lines: Column) -> Column:
    return F.regexp_replace(lines, r"(?m)^[ \t]*#[^\r\n]*$", "")


def _value(inline: Column, lines: Column) -> Column:
    """Rendered value of one entry."""
    rest = _no_comment(lines)
    first = py_strip(inline)
    empty = (first == "") | first.startswith("#")
    whole = py_strip(_folded(F.concat(F.when(empty, F.lit("")).otherwise(first), rest)))
    is_list = empty & rest.rlike(r"\A\s*-(?:[ \t]|\r?\n|\z)")
    is_flow = whole.rlike(rf"(?s)\A\[.*\]{TRAILER}\z")
    flow = F.regexp_extract_all(F.regexp_extract(whole, r"(?s)\A\[(.*)\]", 1),
                                F.lit(FLOW_ITEM_RE), F.lit(1))
    raw = (F.when(is_list, F.regexp_extract_all(rest, F.lit(ITEM_RE), F.lit(1)))
            .when(is_flow, F.filter(flow, lambda x: x != "")).otherwise(F.array(whole)))
    return F.when(first.rlike(r"\A[|>][-+0-9]*[ \t]*(#.*)?\z"),
                  _block_scalar(F.regexp_extract(first, r"\A[|>][-+]?", 0), lines)) \
        .otherwise(F.array_join(F.transform(raw, lambda x: _scalar_to_py_str(py_strip(x))), ", "))


def frontmatter_covered(fm_col: str = "fm") -> Column:
    """Whether the native reading covers a block: every line belongs to an
    entry or is blank or a comment, and no value is a nested mapping or list,
    a flow mapping, an anchor, alias, tag, zoned timestamp or an indented
    block of uneven depth."""
    fm = F.col(fm_col)
    left = F.regexp_replace(F.regexp_replace(fm, KV_RE, ""), r"(?m)^[ \t]*(#[^\r\n]*)?\r?$", "")
    odd = fm.rlike(
        r"(?m)^[^\s#:][^:\r\n]*:[ \t]+([&*!{]|-(?:[ \t]|\r?$)|\[.*[\[{].*\]|\d{4}-\d\d?-\d\d?(?:[Tt]|[ \t]+)\d)"
        r"|^[ \t]+[^\s#\-\"'][^:\r\n]*:(?:[ \t]|\r?$)|^[ \t]*-[ \t]+(?:[&*!{\[]|-[ \t]|[^\s\"'#][^\r\n]*:"
        r"(?:[ \t]|\r?$))|:[ \t]+[|>][-+]?[0-9]")
    return (fm == "") | ((py_strip(left) == "") & ~odd)


def frontmatter_entries(df: DataFrame, fm_col: str = "fm") -> DataFrame:
    """Add ``_fm_kv``: ``array<struct<key, value>>`` in block order.

    Three aligned ``regexp_extract_all`` calls (same pattern, one group each)
    give keys, inline values and list lines; one ``transform`` renders the
    values. Linear in the block size, no Python.
    """
    fm = F.col(fm_col)
    return df.withColumn("_fm_kv", F.transform(
        F.arrays_zip(F.regexp_extract_all(fm, F.lit(KV_RE), F.lit(1)).alias("k"),
                     F.regexp_extract_all(fm, F.lit(KV_RE), F.lit(2)).alias("v"),
                     F.regexp_extract_all(fm, F.lit(KV_RE), F.lit(3)).alias("i")),
        lambda e: F.struct(F.when(F.substring(e["k"], 1, 1).isin('"', "'"), _scalar_to_py_str(
            e["k"])).otherwise(F.rtrim(e["k"], F.lit(" \t"))).alias("key"), _value(e["v"], e["i"]).alias("value"))))


def entries_to_map(kv: Column) -> Column:
    """Python dict semantics: a repeated key keeps its first position and
    takes its last value."""
    def last_values(s: Column) -> Column:
        """From entries sorted by key and place: each key's first place and
        last value, in the order of the places."""
        first = F.filter(s, lambda x, i: ~x["key"].eqNullSafe(
            F.when(i > 0, F.get(s, i - 1))["key"]))
        last = F.filter(s, lambda x, i: ~x["key"].eqNullSafe(F.get(s, i + 1)["key"]))
        both = F.array_sort(F.zip_with(first, last, lambda a, b: F.struct(
            a["at"].alias("at"), b["key"].alias("key"), b["value"].alias("value"))))
        return F.transform(both, lambda x: F.struct(x["key"].alias("key"),
                                                    x["value"].alias("value")))
    sorted_entries = F.array_sort(F.transform(kv, lambda p, i: F.struct(
        p["key"].alias("key"), i.alias("at"), p["value"].alias("value"))))
    once = F.size(F.array_distinct(F.transform(kv, lambda p: p["key"]))) == F.size(kv)
    return F.map_from_entries(F.when(once, kv).otherwise(_let(sorted_entries, last_values)))


def _py_str(value) -> str:
    """``str(v)`` with lists joined by ``", "`` (the reference's rule)."""
    if isinstance(value, list):
        return ", ".join(str(v) for v in value)
    return str(value)


def _yaml_to_json(on_error: str):
    def parse(blocks):
        """pandas Series of YAML blocks -> Series of JSON objects (str values)."""
        import json  # noqa: PLC0415 - executor-side imports

        import yaml  # noqa: PLC0415

        out = []
        for block in blocks:
            meta = {}
            if block:
                try:
                    loaded = yaml.safe_load(block)
                except yaml.YAMLError:
                    if on_error == "raise":
                        raise
                    loaded = None
                if isinstance(loaded, dict):
                    meta = loaded
            out.append(json.dumps({str(k): _py_str(v) for k, v in meta.items()}))
        return blocks.__class__(out)

    return parse


def frontmatter_map(df: DataFrame, fm_col: str = "fm", mode: str = "flat",
                    out_col: str = "metadata", on_error: str = "raise") -> DataFrame:
    """Add ``out_col`` (``map<string,string>``) parsed from the block column.

    In ``yaml`` mode an unparsable block raises (as the reference's parser
    does) unless ``on_error="empty"``, which gives it empty metadata so one
    bad file does not stop a corpus-wide run.
    """
    if on_error not in ("raise", "empty"):
        raise ValueError(f"unknown on_error: {on_error}")
    empty = F.create_map().cast("map<string,string>")
    if mode == "flat":
        staged = frontmatter_entries(df, fm_col)
        return staged.withColumn(
            out_col,
            F.when(F.size("_fm_kv") == 0, empty).otherwise(entries_to_map(F.col("_fm_kv")))
        ).drop("_fm_kv")
    if mode != "yaml":
        raise ValueError(f"unknown frontmatter mode: {mode}")
    # Scalar pandas UDF over the block column only: the body stays in the JVM.
    parse = F.pandas_udf(_yaml_to_json(on_error), T.StringType())
    return df.withColumn(
        out_col,
        F.when(F.col(fm_col) == "", empty)
         .otherwise(F.from_json(parse(F.col(fm_col)), "map<string,string>")))
