"""Token-ID output: documents as one array of ids, cut into shard files with Elias-Fano document boundaries.

Documents are dealt out by ranges of their id, so the files in (part, seq) order hold them in ascending order.
A task tokenizes its range and closes a file whenever `shard_tokens` ids are full: memory is bounded by one
file, and no key is collected anywhere. A file is written under another name and then moved, its name depends
on the place in the order alone, and the rows of a range are fully ordered; so a task that runs again after a
lost executor writes the same bytes to the same names. The index table (one row per file) gets the number of
ids before each file from two small prefix sums.

File: header, Elias-Fano ends of the documents, Elias-Fano document ids (less the smallest), ids little-endian
in 2 or 4 bytes. A reader finds document k with two selects and reads its ids alone.

Cases: a null text counts as the empty text (one end id); null document ids come first; rows that repeat an id
are all kept, ordered by the hash of their text; an empty table gives an index without rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .eliasfano import EliasFano

MAGIC = b"PLTOKEN1"
_HEAD = struct.Struct("<8sBQQqQQ")  # magic, bytes an id, documents, documents without id, smallest id, tokens, place of the ids
_INDEX = "part int, seq int, file string, n_docs long, n_tokens long"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of texts by the tokenizer, piece by piece.

    A blank between two other characters always opens a new pre-token of a byte-level BPE, so a text may be cut
    there and each distinct piece encoded once: all new pieces of some texts go through the tokenizer as one text,
    whose ids are cut where a token opens with a blank. Pieces are kept for the texts that follow, `room` at most.
    Texts that hold the string of an added token are encoded whole.
    """

    def __init__(self, vocabulary: str, room: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True  # how byte-level vocabularies write a blank
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.room, self.known = room, {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")

    def _learn(self, new: list[str]) -> None:
        self.known.update((p, self._ids(" " + p).tobytes()) for p in new if " " in p)
        new = [p for p in new if " " not in p]
        if not new:
            return
        ids = self._ids(" " + " ".join(new))
        at = (np.flatnonzero(self.opens[ids]) * self.width).tolist()
        data = ids.tobytes()
        if len(at) != len(new):
            raise ValueError("the vocabulary does not open a token at each blank")
        self.known.update(zip(new, [data[i:j] for i, j in zip(at, [*at[1:], len(data)], strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.room:
            known.clear()
        cuts: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            if any(a in text for a in self.added):
                cuts.append(None)
                continue
            pieces = text.split(" ")
            mine = set(pieces[1:]).difference(known)
            if not pieces[0] or pieces[0][-1].isspace() or any(not p or p[0].isspace() or p[-1].isspace() for p in mine):
                pieces = _BETWEEN.split(text)
                mine = set(pieces[1:]).difference(known)
            new |= mine
            cuts.append(pieces)
        if new:
            self._learn(list(new))
        out = []
        for text, pieces in zip(texts, cuts, strict=True):
            if pieces is None:
                out.append(self._ids(text).tobytes())
            else:
                head = self._ids(pieces[0]).tobytes() if pieces[0] else b""
                out.append(head + b"".join(map(known.__getitem__, pieces[1:])))
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """The encoder of this Python worker, kept for its next tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _file_bytes(width: int, doc_ids: list[int], n_null: int, ends: list[int], ids: list[bytes]) -> bytes:
    smallest = doc_ids[0] if doc_ids else 0
    bounds = EliasFano.encode(ends).to_bytes()
    names = EliasFano.encode([d - smallest for d in doc_ids]).to_bytes()
    at = _HEAD.size + len(bounds) + len(names)
    return b"".join([_HEAD.pack(MAGIC, width, len(ends), n_null, smallest, ends[-1], at), bounds, names, *ids])


def _put(folder: str, name: str, data: bytes) -> None:
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    passing = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(passing) as f:
        f.write(data)
    store.move(passing, f"{root}/{name}")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = 1 << 21) -> DataFrame:
    """Write the shard files and the index below `folder`; gives the index (part, seq, file, n_docs, n_tokens, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, _encoder(vocabulary)
        end = int(end_id).to_bytes(encoder.width, "little")
        doc_ids, n_null, ends, ids, total = [], 0, [], [], 0

        def encoded(b):
            for k in range(0, b.num_rows, 64):
                some = b.slice(k, 64)
                yield from zip(some.column(0).to_pylist(), (x + end for x in encoder.encode(some.column(1).to_pylist())), strict=True)

        def close():
            name = f"{part:06d}-{seq:05d}.ids"
            _put(f"{folder}/files", name, _file_bytes(encoder.width, doc_ids, n_null, ends, ids))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": pa.array([name]),
                "n_docs": pa.array([len(ends)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

        for b in batches:
            for doc, data in encoded(b):
                ids.append(data)
                total += len(data) // encoder.width
                ends.append(total)
                if doc is None:
                    n_null += 1
                else:
                    doc_ids.append(doc)
                if total >= shard_tokens:
                    yield close()
                    seq += 1
                    doc_ids, n_null, ends, ids, total = [], 0, [], [], 0
        if ends:
            yield close()

    d = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("d", "t", F.xxhash64("t").alias("h")).repartitionByRange("d", "h").sortWithinPartitions("d", "h").select("d", "t")
    d.mapInArrow(run, _INDEX).write.mode("overwrite").parquet(f"{folder}/written")
    spark = docs.sparkSession
    files = spark.read.schema(_INDEX).parquet(f"{folder}/written")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    in_part = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    index = files.withColumn("in_part", in_part).join(parts, "part").select(
        "part", "seq", "file", "n_docs", "n_tokens", (F.col("before") + F.col("in_part")).alias("start"))
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


class Shard:
    """One file; `span(k)` selects the bounds of document k."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, self.n_null, self.smallest, self.n_tokens, self.at = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        self.ends, at = EliasFano.from_bytes(data, _HEAD.size)
        self.names, _ = EliasFano.from_bytes(data, at)

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def doc_id(self, k: int) -> int | None:
        return None if k < self.n_null else self.smallest + self.names.select(k - self.n_null)

    def ids(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.data, f"<u{self.width}", b - a, self.at + a * self.width)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(document id, first place, place behind the last) of all documents, by a select cursor over either code."""
        names = chain.from_iterable(step.tolist() for step in self.names.steps())
        a = 0
        for k, b in enumerate(chain.from_iterable(step.tolist() for step in self.ends.steps())):
            yield (None if k < self.n_null else self.smallest + next(names)), a, b
            a = b


def _get(folder: str, name: str) -> bytes:
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def _read(spark: SparkSession, folder: str, schema: str, make) -> DataFrame:
    files = spark.read.parquet(f"{folder}/index").select("file", "start", "n_docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shard = Shard(_get(f"{folder}/files", r["file"]))
                yield from make(r["start"], shard)

    # a row stands for a whole file, so the number of tasks is fixed: by their bytes the rows would all go to one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, F.col("file")).mapInArrow(run, schema)


def read_tokens(spark: SparkSession, folder: str, batch_docs: int = 256) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files."""

    def make(start, shard):
        rows = shard.documents()
        while some := list(islice(rows, batch_docs)):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d for d, _, _ in some], pa.int64()), "start": pa.array([start + a for _, a, _ in some], pa.int64()),
                "n_tokens": pa.array([b - a for _, a, b in some], pa.int64()),
                "ids": pa.array([shard.ids(a, b).astype(np.int32) for _, a, b in some], pa.list_(pa.int32()))})

    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids array<int>", make)


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: crc32 of the ids as little-endian unsigned 32-bit integers."""

    def make(start, shard):
        wide = memoryview(shard.ids(0, shard.n_tokens).astype("<u4")).cast("B")  # one shard's ids, widened once
        rows = [(d, start + a, b - a, zlib.crc32(wide[4 * a:4 * b])) for d, a, b in shard.documents()]
        yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))})

    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", make)
