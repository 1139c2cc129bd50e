"""Token files against the tokenizer itself, and the byte coding."""

import random
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import tokenids as T
from quire.session import checkpoint_dir

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_coding_round_trip():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << int(b), int(n), dtype=np.uint32) for b, n in
             zip(rng.integers(1, 32, 40), rng.integers(0, 30, 40))]
    parts.append(np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32))
    control, data = T.encode_ranks(parts)
    for c, d, x in zip(control, data, parts):
        assert len(c) == -(-len(x) // 4)
        assert (T.decode_ranks(c, d)[:len(x)] == x).all()
    every = T.decode_ranks(b"".join(control), b"".join(data))
    at = 0
    for c, x in zip(control, parts):  # streams of many documents together
        assert (every[at:at + len(x)] == x).all()
        at += 4 * len(c)
    small = np.arange(256, dtype=np.uint32)  # a byte each, two bits of control
    assert [len(s[0]) for s in T.encode_ranks([small])] == [64, 256]


def test_pieces_equal_whole_texts():
    rng = random.Random(3)
    bits = [" ", " ", " ", "\n", "\t", "  ", "a", "the", "Über", "12", "'s", "n't", "!", "...", "é",
            "\u00a0", "\u3000", "\x1c", "<|endoftext|>", "日本", "😀", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "  a", "a ", " a  b ", "a \n b", "a\n b", "a\n\n b"]
    plain = Tokenizer.from_file(PATH)
    got = T.CachedTokenizer(PATH).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u2").tolist() \
            == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_files(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing names."""
    rng = random.Random(5)
    rows = [(i * 3, "some words here. " * rng.randint(0, 40), 1) for i in range(300)]
    rng.shuffle(rows)
    rows += [(None, "null id", 1), (7, None, 1), (8, "", None), (8, "again", 1),
             (9, "long text " * 50_000, 1), (10, "same", 1), (10, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int").repartition(5)
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    T.write_tokens(docs, path, PATH, 2)
    got = T.read_tokens(spark, path).collect()
    plain = Tokenizer.from_file(PATH)
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    at = 0
    want = {}
    for i, text, _ in rows:
        want.setdefault(i, []).append(plain.encode(text or "", add_special_tokens=False).ids + [2])
    for r in got:
        assert r.start == at
        at += r.n_tokens
        own = np.frombuffer(r.ids, "<u4").tolist()
        want[r.doc_id].remove(own)
        assert r.n_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert not any(want.values())
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks)))


def test_empty_table(spark):
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 2)
    assert T.read_tokens(spark, path).count() == 0


def test_id_of_most_rows_is_split(spark):
    """Rows of one id lie in several files, still one after the other."""
    rows = [(5, f"copy {i} " * 20) for i in range(4000)] + [(i, "other") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write_tokens(docs, path, PATH, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    files = {r.file: r["count"] for r in
             spark.read.parquet(f"{path}/tokens").groupBy("file").count().collect()}
    assert len(files) > 4 and max(files.values()) < 2000
    got = sorted(T.read_tokens(spark, path, with_ids=False).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
