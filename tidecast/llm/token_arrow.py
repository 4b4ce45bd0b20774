"""Token ids as Arrow files of equal-length sequences.

Documents are dealt out by ranges of doc_id and sorted, so that shard k holds ids before those of
shard k + 1. A task encodes its texts, appends the end id to each, cuts the stream into sequences
of ``SEQUENCE`` ids and writes two files in Arrow's IPC file format:

* ``*.tokens.arrow``: ``ids`` fixed_size_list<uint16>[SEQUENCE] (uint32 for vocabularies beyond
  65,536) and ``mask`` fixed_size_list<bool>[SEQUENCE], one bit for each id (false for the filling
  of the last sequence). Row r of the file lies at a known place, so a mapped file gives any
  sequence without a copy.
* ``*.index.arrow``: ``doc_id``, ``offset`` (ids before it in the shard), ``n_tokens``.

Each attempt writes files of its own names; the manifest, one row per shard, names those that
count, so a repeated or lost task leaves no trace but unused files. Files go to the shared folder
by their URI, with pyarrow's file systems.

A piece of text that begins at a blank after a character that is no white space is encoded the
same alone as in its text (the tokenizer splits there, and looks at nothing before). Pieces are
therefore encoded once per worker and remembered, which gives the tokenizer's ids at a third of
its time. Texts that hold a special token, or white space before a blank, go to it undivided.

A null text is an empty one: it has the end id alone. Null ids come first. Rows that share an id
are ordered by a hash of their text. Extra columns are ignored. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import re
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.llm.words import whole
from tidecast.session import fresh_path, materialise

SEQUENCE, END_ID, ROWS, REMEMBERED = 2048, 0, 256, 1_300_000
MANIFEST = "shard int, tokens string, index string, n_docs long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def worker_state() -> dict:
    """A dictionary that outlives the task in a Python worker."""
    return sys.modules.setdefault("tidecast_worker_state", types.ModuleType("tidecast_worker_state")).__dict__


class Encoder:
    """Ids of texts as little-endian bytes, two for each id where the vocabulary allows, else four."""

    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    MARKS = r"[.,;:!?]*"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known: dict[str, bytes] = {}
        self.undivided = re.compile(r"\s ")
        word = f"([{self.LETTERS}]+)({self.MARKS})"
        self.simple = re.compile(f"{word}(?:\n{word})?")
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        letters = [chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7)]
        # the tokenizer's own names of the blank, the line end and the letters beyond ASCII
        self.names = {ord(c): split(c)[0][0] for c in letters}
        self.blank, self.line = split(" ")[0][0], self.pack(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.after_line: dict[str, bytes] = {}
        self.after_word: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, letters: str, known: dict[str, bytes], before: str) -> bytes:
        """A run of letters, after a blank or not, which the tokenizer never divides before its merges."""
        ids = known.get(letters)
        if ids is None:
            name = before + (letters if letters.isascii() else letters.translate(self.names))
            ids = known[letters] = self.pack([t.id for t in self.tokenizer.model.tokenize(name)])
        return ids

    def piece(self, text: str) -> bytes:
        """A piece that follows a blank, the blank included."""
        m = self.simple.fullmatch(text)
        if m is None:
            return self.whole(" " + text)
        first, marks, second, more = m.groups()
        ids = self.word(first, self.known, self.blank)
        if marks:
            ids += self.marks(marks)
        if second:
            ids += self.line + self.word(second, self.after_line, "")
            if more:
                ids += self.marks(more)
        return ids

    def marks(self, text: str) -> bytes:
        if text not in self.after_word:
            self.after_word[text] = self.whole(text)
        return self.after_word[text]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or self.undivided.search(text):
            return self.whole(text)
        for kept in (self.known, self.after_line, self.after_word):
            if len(kept) > REMEMBERED:
                kept.clear()
        first, *rest = text.split(" ")
        known = self.known
        for p in set(rest).difference(known):
            known[p] = self.piece(p)
        return self.whole(first) + b"".join(map(known.__getitem__, rest))


def encoder(path: str) -> Encoder:
    state = worker_state()
    if path not in state:
        state[path] = Encoder(path)
    return state[path]


def _open(uri: str):
    """File system and path of a URI or a local path."""
    return pa.fs.FileSystem.from_uri(uri)


def schema(length: int, code: str) -> pa.Schema:
    kind = pa.uint16() if code == "H" else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class Shard:
    """Writes one shard's two files."""

    def __init__(self, folder: str, shard: int, length: int, code: str):
        self.shard, self.length, self.kind = shard, length, np.dtype("<u2" if code == "H" else "<u4")
        self.schema = schema(length, code)
        self.names = [f"{folder}/{shard:06d}-{uuid.uuid4().hex}.{k}.arrow" for k in ("tokens", "index")]
        fs, place = _open(folder)
        fs.create_dir(place, recursive=True)
        self.files = [fs.open_output_stream(_open(n)[1]) for n in self.names]
        self.out = [pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, INDEX), strict=True)]
        self.buffer, self.held, self.n_docs, self.n_tokens = [], 0, 0, 0

    def add(self, ids: list, docs: list[bytes]) -> None:
        sizes = np.array([len(d) // self.kind.itemsize for d in docs], dtype=np.int64)
        offset = self.n_tokens + np.cumsum(sizes) - sizes
        self.out[1].write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(offset), pa.array(sizes)], schema=INDEX))
        self.n_docs += len(docs)
        self.n_tokens += int(sizes.sum())
        self.buffer += docs
        self.held += int(sizes.sum())
        if self.held >= ROWS * self.length:
            self.flush()

    def flush(self, last: bool = False) -> None:
        data = np.frombuffer(b"".join(self.buffer), dtype=self.kind)
        n = len(data) // self.length
        rows, rest = data[: n * self.length], data[n * self.length :]
        self.buffer, self.held = [rest.tobytes()], len(rest)
        mask = np.ones(len(rows), bool)
        if last and len(rest):
            fill = np.zeros(self.length - len(rest), self.kind)
            rows, mask = np.concatenate([rows, rest, fill]), np.concatenate([mask, np.ones(len(rest), bool), fill > 0])
        for k in range(0, len(rows), ROWS * self.length):
            part = slice(k, k + ROWS * self.length)
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (rows, mask)]
            self.out[0].write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> dict:
        self.flush(last=True)
        for x in (*self.out, *self.files):
            x.close()
        return {"shard": self.shard, "tokens": self.names[0], "index": self.names[1], "n_docs": self.n_docs, "n_tokens": self.n_tokens}


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Writes the shards and returns the manifest, which is itself written before it is used."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    cols = cols.withColumn("h", F.xxhash64("text"))
    cols = cols.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                coder = encoder(tokenizer)
                out = out or Shard(folder, TaskContext.get().partitionId(), length, coder.code)
                end = coder.pack([END_ID])
                for k in range(0, b.num_rows, 500):
                    part = b.slice(k, 500)
                    out.add(part[0].to_pylist(), [coder.encode(t) + end for t in part[1].to_pylist()])
        if out:
            yield pa.RecordBatch.from_pylist([out.close()], schema=pa.schema([("shard", pa.int32()), ("tokens", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return materialise(cols.mapInArrow(work, MANIFEST), "manifest")


class TokenFile:
    """Random access to the sequences of a tokens file; mapped, not copied, where it is local."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))

    def __getitem__(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (without a copy) and mask of sequence ``r``."""
        for k in range(self.reader.num_record_batches):
            b = self.reader.get_batch(k)
            if r < b.num_rows:
                n = b.column(0).type.list_size
                ids, mask = (c.flatten().slice(r * n, n) for c in b.columns)
                return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)
            r -= b.num_rows
        raise IndexError(r)

    def stream(self) -> Iterator[np.ndarray]:
        """The ids under the mask, batch by batch."""
        for k in range(self.reader.num_record_batches):
            b = self.reader.get_batch(k)
            ids, mask = b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).flatten()
            yield ids if mask.true_count == len(mask) else ids[mask.to_numpy(zero_copy_only=False)]


def documents_of(tokens: str, index: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, offset, n_tokens, crc32 of its ids) of a shard, read from its files."""
    fs, path = _open(index)
    with fs.open_input_file(path) as f:
        docs = pa.ipc.open_file(f).read_all()
    stream, have, at = TokenFile(tokens).stream(), np.empty(0, "<u2"), 0
    for d, offset, n in zip(*(docs[c].to_pylist() for c in docs.column_names), strict=True):
        crc, left = 0, n
        while left:
            if at == len(have):
                have, at = next(stream), 0
            part = have[at : at + left]
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
            at, left = at + len(part), left - len(part)
        yield d, offset, n, crc


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the manifest."""
    # one row per shard: shards, not documents, are summed in one task
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "tokens", "index", before.alias("before"))
    n = max(1, manifest.count())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for row in b.to_pylist():
                rows: list = []
                for d, offset, k, crc in documents_of(row["tokens"], row["index"]):
                    rows.append((d, row["before"] + offset, k, crc))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return shards.repartition(n).mapInArrow(work, RESULT)


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """op8: each document's place, length and checksum in the token files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read(write(docs.select("doc_id", "text"), tokenizer))
