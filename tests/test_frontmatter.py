"""Frontmatter split and metadata map."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from quire.operators.frontmatter import frontmatter_map, split_frontmatter


def parse(spark, text, mode="flat", keys=False):
    df = spark.createDataFrame([(text,)], "text string")
    out = frontmatter_map(split_frontmatter(df, "text"), "fm", mode=mode)
    row = out.withColumn("_keys", F.map_keys("metadata")).collect()[0]
    if keys:  # map order as Spark holds it (a collected dict loses it)
        return list(row["_keys"])
    return dict(row.metadata), row.content


def read(name):
    with open(os.path.join(FIXTURES, name), encoding="utf-8") as fh:
        return fh.read()


@pytest.mark.parametrize("mode", ["flat", "yaml"])
def test_frontmatter_fields(spark, mode):
    meta, content = parse(spark, read("plain.md"), mode)
    assert meta == {"title": "Plain Note", "date": "2024-03-05", "tags": "alpha, plain"}
    assert content.startswith("# Plain Note")
    assert "single heading" in content


@pytest.mark.parametrize("mode", ["flat", "yaml"])
def test_all_fields(spark, mode):
    meta, _ = parse(spark, read("all_fields.md"), mode)
    assert meta["id"] == "2024-05-20_field-check"
    assert meta["type"] == "long_read"
    assert meta["author"] == "Pat Writer"
    assert meta["url"] == "https://example.org/field-check"
    assert parse(spark, read("all_fields.md"), mode, keys=True)[:3] == ["id", "title", "type"]


def test_no_frontmatter(spark):
    meta, content = parse(spark, read("bare.md"))
    assert meta == {}
    assert content.startswith("# Note Without Header Block")


def test_empty_text(spark):
    assert parse(spark, "") == ({}, "")


def test_later_rule_stays_in_body(spark):
    meta, content = parse(spark, "---\na: 1\n---\nbody\n\n---\n\nmore")
    assert meta == {"a": "1"}
    assert content == "body\n\n---\n\nmore"


def test_unclosed_block_is_body(spark):
    meta, content = parse(spark, "---\na: 1\nno end here")
    assert meta == {}
    assert content == "---\na: 1\nno end here"


def test_leading_blank_lines_and_empty_block(spark):
    assert parse(spark, "\n\n---\n---\nx") == ({}, "x")


@pytest.mark.parametrize("mode", ["flat", "yaml"])
def test_scalar_rendering_like_python_str(spark, mode):
    text = ("---\nflag: true\noff_flag: no\nnothing: null\nnum: 007x\ncount: 42\n"
            "quoted: \"a: b\"\nitems:\n  - one\n  - two\n---\nx")
    meta, _ = parse(spark, text, mode)
    assert meta["flag"] == "True" and meta["off_flag"] == "False"
    assert meta["nothing"] == "None" and meta["count"] == "42"
    assert meta["quoted"] == "a: b" and meta["items"] == "one, two"


@pytest.mark.parametrize("mode", ["flat", "yaml"])
def test_crlf_line_endings(spark, mode):
    text = "---\r\ntitle: Windows Note\r\ntags:\r\n  - a\r\n  - b\r\ncount: 3\r\n---\r\n\r\nBody line\r\n"
    meta, content = parse(spark, text, mode)
    assert meta == {"title": "Windows Note", "tags": "a, b", "count": "3"}
    assert content == "Body line"


def test_yaml_errors_raise_or_give_empty_metadata(spark):
    from pyspark.errors import PythonException

    df = split_frontmatter(spark.createDataFrame([("---\nkey: [unclosed\n---\nbody",)],
                                                 "text string"), "text")
    with pytest.raises(PythonException):
        frontmatter_map(df, "fm", mode="yaml").collect()
    row = frontmatter_map(df, "fm", mode="yaml", on_error="empty").collect()[0]
    assert dict(row.metadata) == {} and row.content == "body"


FORMS = [
    ('title: "Issue #42: foo"', "Issue #42: foo"), ("a: 'C # notes'", "C # notes"),
    ('a: "He said \\"hi\\""', 'He said "hi"'), ('a: "\\u00e9\\x41\\t|"', "\xe9A\t|"),
    ('a: ["a, b", c]', "a, b, c"), ("a: [x, 'it''s', 3]", "x, it's, 3"), ("a: []", ""),
    ("a: 12345678901234567890", "12345678901234567890"),
    ("a: 0xFFFFFFFFFFFFFFFFFF", "4722366482869645213695"), ("a: 0b101", "5"), ("a: 017", "15"),
    ("a: 0.1234567890123456", "0.1234567890123456"), ("a: 1.5e+3", "1500.0"),
    ("a: 1.0E+20", "1e+20"), ("a: 0.00001", "1e-05"), ("a: 1e3", "1e3"), ("a: -1.50", "-1.5"),
    ("a: 123456789012345678.0", "1.2345678901234568e+17"), ("a: 12:30", "750"),
    ('"quoted key": v', "v"), ("a: plain # comment", "plain"), ("a: foo#bar", "foo#bar"),
    ("a: >\n  folded text\n  more\nb: 1", "folded text more\n"),
    ("a: |-\n  lit\n  two\n\nb: 2", "lit\ntwo"), ("a: first\n  continued\nb: c", "first continued"),
    ("a:\n- x\n- 'y, z'\nb: 1", "x, y, z"), ("a:\n\nb: ~", "None"), ("# c\na: [a,\n  b]", "a, b"),
    ("a: https://x.y/z#frag", "https://x.y/z#frag"), ("a: 2024-01-01", "2024-01-01")]


def test_native_forms(spark):
    """Values as YAML reads them; a wide number stops no other file."""
    from quire.operators.frontmatter import frontmatter_covered

    df = spark.createDataFrame([(i, f"---\n{f}\n---\nbody") for i, (f, _) in enumerate(FORMS)],
                               "i int, text string")
    out = frontmatter_map(split_frontmatter(df, "text"), "fm").withColumn(
        "ok", frontmatter_covered("fm")).orderBy("i").select(
        F.map_values("metadata")[0].alias("v"), "ok").collect()
    for (form, value), row in zip(FORMS, out):
        assert (row.v, row.ok) == (value, True), form


@pytest.mark.parametrize("block", ["a:\n  b: 1", "a: {b: 1}", "a: &x 1", "a:\n  - b: 1", "a: - b",
                                   "a: [[1], 2]", "a: 2001-12-14T21:59:43Z", "loose line"])
def test_uncovered_forms_are_told(spark, block):
    from quire.operators.frontmatter import frontmatter_covered

    df = spark.createDataFrame([(block,)], "fm string")
    assert df.select(frontmatter_covered("fm")).first()[0] is False


def _maps(spark, blocks):
    df = spark.createDataFrame(list(enumerate(blocks)), "i int, fm string")
    return [r.metadata for r in frontmatter_map(df).orderBy("i").collect()]


def test_blocks_of_any_length(spark):
    """Long lists, many keys, long runs of blanks and digits: no task is lost
    and the other rows are as they are."""
    import time

    n = 100_000
    t = time.time()
    got = _maps(spark, [
        "tags:\n" + "".join(f"- item {i}\n" for i in range(n)) + "title: end\n",
        "".join(f"key{i}: {i}\n" for i in range(20_000)),
        "".join(f"key{i % 7}: {i}\n" for i in range(20_000)),
        "a: " + " " * n + "x\nb: |\n" + "  line\n" * n + "c: 1\n",
        "a: 1" + ":2" * n + "x\nb: 2\n",
        "text:" + "\n  more" * n + "\nlast: yes\n",
        "flow: [" + "a, " * n + "b]\n",
        "title: plain\n"])
    assert time.time() - t < 120
    assert got[0]["tags"] == ", ".join(f"item {i}" for i in range(n)) and got[0]["title"] == "end"
    assert got[1] == {f"key{i}": str(i) for i in range(20_000)}
    assert got[2] == {f"key{i}": str(max(range(i, 20_000, 7))) for i in range(7)}
    assert got[3]["a"] == "x" and got[3]["b"] == "line\n" * n and got[3]["c"] == "1"
    assert got[4]["b"] == "2" and got[5]["last"] == "True"
    assert got[5]["text"] == " ".join(["more"] * n)
    assert got[6]["flow"] == "a, " * n + "b"
    assert got[7] == {"title": "plain"}


def test_repeated_keys_keep_their_first_place(spark):
    df = spark.createDataFrame([("b: 1\na: 2\nc: 3\na: 4\nb: 5\n",)], "fm string")
    (r,) = frontmatter_map(df).select(F.map_keys("metadata"), F.map_values("metadata")).collect()
    assert tuple(r) == (["b", "a", "c"], ["5", "4", "3"])


def test_numbers_of_any_size(spark):
    import random

    rng = random.Random(9)
    block, want = "", {}
    for i, digits in enumerate([1, 7, 8, 31, 33, 38, 39, 64, 200, 900]):
        n = rng.getrandbits(4 * digits) | 1 << (4 * digits - 1)
        minutes = rng.randrange(60)
        block += f"h{i}: 0x{n:x}\no{i}: -0{n:o}\nb{i}: 0b{n:b}\ns{i}: {n}:{minutes}:05\n"
        want |= {f"h{i}": str(n), f"o{i}": str(-n), f"b{i}": str(n),
                 f"s{i}": str((n * 60 + minutes) * 60 + 5)}
    assert _maps(spark, [block, "z: 0x0\n"]) == [want, {"z": "0"}]
