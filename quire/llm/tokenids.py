"""Token ids in frequency-ranked, byte-aligned variable-length coding.

Documents are tokenised once and their ids sorted by document. Ids are replaced by their rank
in the order of falling frequency over the whole corpus, so that frequent ids
take one byte. A document stores its ranks as two byte streams: control bytes
with four two-bit lengths each, and data bytes with one to four little-endian
bytes per rank, filled up to a whole control byte with ranks 0. Streams of
several documents can be decoded together. Decoding is table lookup: a control
byte gives the lengths and offsets of its four values, and a rank its id.

Files are Parquet: one row per document, in ascending order of document id
within a file and from file to file.
"""

from __future__ import annotations

import json
import re
import string
import sys
import zlib
from collections.abc import Iterator
from struct import pack
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MEMO_WORDS = 3 << 19    # words whose ids a Python worker remembers, about 200 bytes each
_LEARN_TOGETHER = 1000  # words encoded as one text
_BATCH_ROWS = 256       # documents tokenised together
# White space other than the space and the line feed.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
# Signs that end a piece: a run of them after a letter is a word of its own.
_MARKS = "".join(c for c in string.punctuation if c != "'")
# Characters that byte-level vocabularies show bytes as: visible ones as
# themselves, the others from 256 on, in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_SHOWN_SPACE = _SHOWN[0x20]


# --- tokenising -----------------------------------------------------------
class CachedTokenizer:
    """A byte-level BPE tokenizer that remembers the ids of words.

    Such a tokenizer splits a text into words before it merges bytes; a space
    goes with the word after it, and a single line break is a word of its own.
    A text whose only white space is single spaces and single line breaks, not
    next to each other, is therefore encoded piece by piece with the same
    result as in one go. All other texts, those with a special token, and all
    texts of other kinds of tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        splitter = spec["pre_tokenizer"] or {}
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_piece = (spec["normalizer"] is None and spec["model"]["type"] == "BPE"
                         and splitter.get("type") == "ByteLevel" and splitter.get("use_regex")
                         and not splitter.get("add_prefix_space") and len(newline) == 1)
        self.newline = newline[0] if newline else 0
        self.model = self.tokenizer.model
        self.after_space: dict[str, bytes] = {}  # a piece after a space, or "\n" and a piece
        self.first: dict[str, bytes] = {}        # a piece that nothing comes before
        self.tails: dict[str, bytes] = {}        # marks after a letter

    def width(self, *more: int) -> str:
        """Numpy type that holds every id."""
        return "<u2" if max(self.tokenizer.get_vocab_size(), *more) <= 0xFFFF else "<u4"

    def _encode(self, texts: list[str], dtype: str) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype).tobytes() for e in found]

    def _pieces(self, text: str) -> list[str] | None:
        odd = any(c in text for c in _ASCII_SPACE) if text.isascii() else _OTHER_SPACE.search(text)
        if (not self.by_piece or odd or "  " in text or "\n\n" in text or " \n" in text
                or "\n " in text or any(s in text for s in self.special)):
            return None
        return text.replace("\n", " \n").split(" ")

    def _learn(self, pieces: list[str], lead: str, dtype: str) -> list[bytes]:
        """Ids of many pieces, each after ``lead``: they are encoded as lines
        of one text, and the ids of the line breaks tell them apart."""
        out: list[bytes] = []
        size = np.dtype(dtype).itemsize
        for lo in range(0, len(pieces), _LEARN_TOGETHER):
            text = "".join([lead + p + "\n" for p in pieces[lo:lo + _LEARN_TOGETHER]])
            raw = self._encode([text], dtype)[0]
            ids = np.frombuffer(raw, dtype)
            ends = (np.flatnonzero(ids == self.newline) * size).tolist()
            starts = [0, *[e + size for e in ends]]
            out += [raw[a:b] for a, b in zip(starts, ends)]
        return out

    def _learn_pieces(self, memo: dict, pieces: list[str], spaced: bool, dtype: str) -> None:
        """Add the ids of pieces, after a space or bare, to ``memo``. A piece
        that is one word of Latin letters, perhaps with marks after it, goes
        to the model without being split again, its word just once."""
        shown, marked, others = {}, [], []
        for p in pieces:
            stem = p.rstrip(_MARKS)
            if not stem.isalpha():
                others.append(p)
                continue
            if stem not in memo and stem not in shown:
                if stem.isascii():
                    shown[stem] = stem
                elif max(stem) < "\u0250":
                    shown[stem] = stem.encode().decode("latin-1").translate(_SHOWN)
                else:
                    others.append(p)
                    continue
            if len(stem) != len(p):
                marked.append((p, stem))
        memo.update(zip(others, self._learn(others, " " if spaced else "", dtype)))
        lead, width = _SHOWN_SPACE if spaced else "", "H" if dtype == "<u2" else "I"
        split = self.model.tokenize
        for stem, word in shown.items():
            ids = [t.id for t in split(lead + word)]
            memo[stem] = pack(f"<{len(ids)}{width}", *ids)
        for p, stem in marked:
            tail = p[len(stem):]
            if tail not in self.tails:
                self.tails[tail] = self._encode([tail], dtype)[0]
            memo[p] = memo[stem] + self.tails[tail]

    def _fill(self, memo: dict, missing: set, dtype: str, spaced: bool) -> None:
        """Learn the ids of ``missing`` pieces, after a space or bare. Those
        that begin with a line break never have a space before it."""
        self._learn_pieces(memo, [p for p in missing if p and p[0] != "\n"], spaced, dtype)
        end = np.array([self.newline], dtype).tobytes()
        lines = [p for p in missing if p and p[0] == "\n"]
        bare = self.first
        self._learn_pieces(bare, [p[1:] for p in lines if len(p) > 1 and p[1:] not in bare],
                           False, dtype)
        memo.update([(p, end + bare[p[1:]] if len(p) > 1 else end) for p in lines])
        if "" in missing:
            memo[""] = self._encode([" "], dtype)[0] if spaced else b""

    def encode(self, texts: list[str], end_id: int = 0) -> list[bytes]:
        """Ids of each text as numbers of type ``width(end_id)``."""
        dtype, after, first = self.width(end_id), self.after_space, self.first
        for memo in (after, first, self.tails):
            if len(memo) > MEMO_WORDS:
                memo.clear()
        pieces = [self._pieces(t) for t in texts]
        whole = [i for i, p in enumerate(pieces) if p is None]
        encoded = dict(zip(whole, self._encode([texts[i] for i in whole], dtype)))
        heads = [p.pop(0) if p is not None else "" for p in pieces]
        self._fill(first, set(heads) - first.keys(), dtype, False)
        # All pieces of the texts in one row; those not met before are learnt.
        flat: list[str] = []
        for p in pieces:
            flat.extend(p or ())
        found = list(map(after.get, flat))
        if None in found:
            holes, at = [], -1
            try:
                while True:
                    at = found.index(None, at + 1)
                    holes.append(at)
            except ValueError:
                pass
            self._fill(after, {flat[j] for j in holes}, dtype, True)
            for j in holes:
                found[j] = after[flat[j]]
        out, at = [], 0
        for i, p in enumerate(pieces):
            if p is None:
                out.append(encoded[i])
            else:
                upto = at + len(p)
                out.append(first[heads[i]] + b"".join(found[at:upto]))
                at = upto
        return out


def _tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of this process. It is held outside of this module, of
    which every task brings its own copy: tasks of one Python worker share
    the words remembered."""
    held = sys.modules.setdefault("_quire_tokenizers", ModuleType("_quire_tokenizers")).__dict__
    if path not in held:
        held[path] = CachedTokenizer(path)
    return held[path]


def tokenise(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``(doc_id, row, ids, counts)`` for the rows of ``docs``: the ids of
    every text (null: empty) and the end id, as little-endian numbers of 16
    bits where the vocabulary allows it, else 32. ``row`` differs for all
    rows. Each task ends with a row of ``counts``: how often it met every id,
    as 64-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = _tokenizer(path), TaskContext.get().partitionId() << 40
        dtype = encoder.width(end_id)
        end = np.array([end_id], dtype).tobytes()
        count = np.zeros(max(encoder.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        names = ["doc_id", "row", "ids", "counts"]
        met = False
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH_ROWS):
                part = batch.slice(lo, _BATCH_ROWS)
                n = part.num_rows
                ids = [x + end for x in encoder.encode(
                    [t or "" for t in part.column(1).to_pylist()], end_id)]
                count += np.bincount(np.frombuffer(b"".join(ids), dtype), minlength=len(count))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(row, row + n)),
                     pa.array(ids, pa.binary()), pa.nulls(n, pa.binary())], names=names)
                row, met = row + n, True
        if met:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([count.astype("<i8").tobytes()], pa.binary())], names=names)
    return docs.select(F.col(id_col).cast("long"), F.col(text)) \
        .mapInArrow(run, "doc_id long, row long, ids binary, counts binary")


# --- coding ---------------------------------------------------------------
# Lengths of the four values of every control byte, and where they start.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_STARTS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_SIZES = _LENGTHS.sum(axis=1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(parts: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each array of numbers below 2 ** 32."""
    count = np.array([len(x) for x in parts])
    groups = -(-count // 4)
    first = 4 * (np.cumsum(groups) - groups)
    v = np.zeros(4 * int(groups.sum()), "<u4")
    for x, at in zip(parts, first):
        v[at:at + len(x)] = x
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = n.reshape(-1, 4) - 1
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]]
    c_end = np.cumsum(groups)
    d_end = np.concatenate([[0], np.cumsum(_SIZES[control])])[c_end]
    control, data = control.tobytes(), data.tobytes()
    return ([control[a:b] for a, b in zip([0, *c_end[:-1]], c_end)],
            [data[a:b] for a, b in zip([0, *d_end[:-1]], d_end)])


def decode_ranks(control: bytes, data: bytes) -> np.ndarray:
    """All numbers coded in the two streams, four for each control byte."""
    c = np.frombuffer(control, np.uint8)
    size = _SIZES[c]
    at = ((np.cumsum(size) - size)[:, None] + _STARTS[c]).ravel()
    # Four bytes are read at each start and those of the next value masked.
    raw = data + b"\0\0\0\0"
    words = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))[at]
    return words & _MASKS[_LENGTHS[c].ravel()]


# --- files ----------------------------------------------------------------
def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.column(0):
            found = np.frombuffer(row.as_buffer(), "<i8")
            count = found + count if len(count) else found
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["id", "n"])


def _encode_rows(shared, dtype: str):
    """Coded rows in the order met; ``at`` counts the ids before in the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, file, at = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH_ROWS):
                part = batch.slice(lo, _BATCH_ROWS)
                ids = [np.frombuffer(x.as_buffer(), dtype) for x in part.column(1)]
                size = np.array([len(x) for x in ids], np.int64)
                upto = at + np.cumsum(size)
                control, data = encode_ranks([rank[x] for x in ids])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), file, np.int32)), pa.array(upto - size),
                     part.column(0), pa.array(size),
                     pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    names=["file", "at", "doc_id", "n_tokens", "control", "data"])
                at = int(upto[-1])
    return run


FILE_SCHEMA = ("file int, at long, doc_id long, n_tokens long, control binary, data binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                 id_col: str = "doc_id", text: str = "text") -> None:
    """Write the tables ``ranks`` (rank, id) and ``tokens`` (a row per
    document) under ``path``, beside the plain ids they are made from.

    Null and empty texts hold the end id alone; null ids come first; rows that
    repeat an id follow each other; other columns are ignored; an empty table
    gives empty tables.
    """
    spark = docs.sparkSession
    # The plain ids are written once, as the texts are read: frequencies must
    # be known before any of them is coded, and tokenising is the dear part.
    tokenise(docs, tokenizer, end_id, id_col, text) \
        .write.option("compression", "lz4").parquet(f"{path}/ids")
    written = spark.read.parquet(f"{path}/ids")
    # Ids, not texts, are dealt by ranges of document ids; the row number
    # splits the rows of an id that repeats often.
    plain = written.filter("counts is null").select("doc_id", "row", "ids") \
        .repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row") \
        .select("doc_id", "ids")
    dtype = _tokenizer(tokenizer).width(end_id)
    counted = written.filter("counts is not null").select("counts") \
        .mapInArrow(_sum_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # At most one row for each id of the vocabulary.
    order = [r.id for r in counted.orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank long, id long") \
        .coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    plain.mapInArrow(_encode_rows(spark.sparkContext.broadcast(rank), dtype), FILE_SCHEMA) \
        .write.option("compression", "zstd").parquet(f"{path}/tokens")


def _decode_rows(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of_rank = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH_ROWS):
                part = batch.slice(lo, _BATCH_ROWS)
                control, data = (part.column(i).to_pylist() for i in (4, 5))
                ids = ids_of_rank[decode_ranks(b"".join(control), b"".join(data))]
                first = 4 * (np.cumsum([len(c) for c in control])
                             - np.array([len(c) for c in control]))
                raw = [ids[a:a + n].tobytes()
                       for a, n in zip(first, part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                     *([pa.array(raw, pa.binary())] if with_ids else [])],
                    names=["file", "at", "doc_id", "n_tokens", "ids_crc32",
                           *(["ids"] if with_ids else [])])
    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents decoded from the files: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32`` and, if asked for,
    ``ids`` (little-endian numbers of 32 bits)."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # the vocabulary
    table = np.array([r.id for r in ranks] or [0], "<u4")
    stored = spark.read.parquet(f"{path}/tokens")
    schema = "file int, at long, doc_id long, n_tokens long, ids_crc32 long" \
        + ", ids binary" * with_ids
    decoded = stored.mapInArrow(
        _decode_rows(spark.sparkContext.broadcast(table), with_ids), schema)
    # Ids before each file: one row per file of the sorted table.
    files = stored.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", F.coalesce(F.sum("n").over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"))
    return decoded.join(before, "file").select(
        "doc_id", (F.col("_before") + F.col("at")).cast("long").alias("start"), "n_tokens",
        "ids_crc32", *(["ids"] if with_ids else []))
