"""WARC archive: exact round trip, content addressing, revisits."""

import base64
import hashlib
import uuid

import pytest

from quire.llm import warc
from quire.llm.queries import SQL, op1_warc
from quire.session import checkpoint_dir

SCHEMA = "page_id long, url string, payload binary, record_type string, address string"
ROWS = [(5, "http://a/1", b"<html>x</html>", "", ""), (2, "http://a/2", b"<html>x</html>", "", ""),
        (9, "http://a/\r\n3", b"", None, None), (3, None, None, "", ""),
        (7, "http://a/7", b"big " * 100_000, "", ""), (8, "é", bytes(range(256)), "", ""),
        (2, "http://a/2", b"<html>x</html>", "", ""), (None, "u", b"<html>x</html>", "", "")]


def folder(spark):
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def archive(spark, rows, **how):
    path = folder(spark)
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), path, "page_id", **how)
    return path, warc.read_archive(spark, path).collect()


def test_round_trip(spark):
    path, got = archive(spark, ROWS)
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # each payload once
    assert len(got) == len(ROWS)
    bodies = {5: ROWS[0][2], 2: ROWS[0][2], None: ROWS[0][2], 9: b"", 3: b"", 7: ROWS[4][2],
              8: ROWS[5][2]}
    for r in got:
        body = bodies[r.record_id]
        assert bytes(r.payload) == body and r.payload_bytes == len(body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload_digest == digest
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert f"WARC-Payload-Digest: sha1:{digest}".encode() in head.split(b"\r\n")
        assert rest == (body if r.record_type == "response" else b"") + b"\r\n\r\n"
        length = [x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")]
        assert int(length[0].split()[1]) == len(rest) - 4
    kinds = sorted((str(r.record_id), r.record_type, str(r.refers_to)) for r in got)
    assert kinds == sorted([("2", "response", "None"), ("2", "revisit", "2"), ("5", "revisit", "2"),
                            ("None", "revisit", "2"), ("3", "response", "None"),
                            ("9", "revisit", "3"), ("7", "response", "None"),
                            ("8", "response", "None")])


def test_every_header_line(spark):
    """Fields, order and values of all header lines; unique record URNs."""
    _, got = archive(spark, [*ROWS, (-3, "http://a/n", b"neg", "", "")])
    urns = {}
    for r in got:
        lines = r.header.split("\r\n")
        assert lines[0] == "WARC/1.1" and lines[-2:] == ["", ""]
        fields = dict(x.split(": ", 1) for x in lines[1:-2])
        assert len(fields) == len(lines) - 3 and all(fields.values())
        names = ["WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI",
                 "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Profile", "Content-Type",
                 "Content-Length"]
        own = [n for n in names if n in fields]
        assert own == list(fields)
        revisit = r.record_type == "revisit"
        assert fields["WARC-Type"] == r.record_type
        assert ("WARC-Refers-To" in fields) == ("WARC-Profile" in fields) == revisit
        for name in {"WARC-Record-ID", "WARC-Refers-To"} & set(fields):
            uuid.UUID(fields[name].removeprefix("<urn:uuid:").removesuffix(">"))
        urns[fields["WARC-Record-ID"]] = r
    assert len(urns) == len(ROWS) + 1  # also where ids repeat
    for r in got:
        if r.record_type == "revisit":
            first = urns[r.header.split("WARC-Refers-To: ")[1].split("\r\n")[0]]
            assert first.record_type == "response" and first.record_id == r.refers_to
            assert first.payload_digest == r.payload_digest
    assert sorted(str(r.record_id) for r in got) == sorted(str(x[0]) for x in [*ROWS, (-3,)])


def test_small_payloads_are_all_responses(spark):
    _, got = archive(spark, ROWS, min_bytes=15)
    assert {r.record_type for r in got} == {"response"}


def test_empty_table(spark):
    assert archive(spark, [])[1] == []


def test_damage_is_found(spark):
    path, _ = archive(spark, ROWS)
    hurt = folder(spark)
    spark.read.parquet(f"{path}/records").write.parquet(f"{hurt}/records")
    spark.read.parquet(f"{path}/payloads").selectExpr(
        "address", "concat(payload, X'00') AS payload").write.parquet(f"{hurt}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, hurt).collect()


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(SQL["op1_warc"])
    out = op1_warc(spark, sf)
    assert sorted(map(str, map(tuple, out.select(*want.columns).collect()))) \
        == sorted(map(str, want.fetchall()))
