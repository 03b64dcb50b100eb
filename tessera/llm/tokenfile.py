"""Token ids of a corpus in binary files, and back.

Ids are replaced by their rank by frequency over the whole corpus, and ranks are
written in as few whole bytes as they need. The numbers of bytes stand apart from
them, as control bits: one bit an id where ranks need two bytes at most, else two.

A corpus is a folder of files in ascending document order, a table of the files
(``manifest``) and the ranks (``ranks``). A file is a sequence of blocks of whole
documents, so that it is written and read with the memory of one block:

    u32 documents, u32 control bytes, u32 data bytes
    i64 id of each document, u8 whether the id is null, u32 number of ids of each
    control bytes, each document's from a new byte on
    data bytes

All numbers are little-endian. A file counts once the manifest names it: what a lost
or repeated task leaves behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import new_path, stored, tokenizer_file
from tessera.llm.textids import text_ids

TOKENIZER = "byte_bpe_50k.json"
END = 2
FILE_IDS = 8_000_000
BLOCK_IDS = 250_000


class Coding:
    """Ranks below ``size`` in bytes of their own number, with control bits apart."""

    def __init__(self, size: int) -> None:
        self.bits = 1 if size <= 1 << 16 else 2
        self.slots = 8 // self.bits  # ids a control byte
        self.most = 2 if self.bits == 1 else 4  # bytes an id
        shifts = np.arange(self.slots, dtype=np.uint8) * self.bits
        #: for each control byte, the bytes of each of its ids
        self.lengths = ((np.arange(256)[:, None] >> shifts) & ((1 << self.bits) - 1)).astype(np.uint8) + 1

    def encode(self, ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Control bytes and data bytes of documents with ``counts`` ids, which stand one after another."""
        more = np.zeros(len(ranks), np.uint8)
        for k in range(1, self.most):
            more += ranks >= 1 << 8 * k
        rows = -(-counts // self.slots)
        ends = np.cumsum(counts)
        moved = (np.cumsum(rows) - rows) * self.slots - (ends - counts)  # each document starts a byte
        extra = np.zeros(int(rows.sum()) * self.slots, np.uint8)
        extra[np.arange(len(ranks)) + np.repeat(moved, counts)] = more
        shifts = np.arange(self.slots, dtype=np.uint8) * self.bits
        control = np.bitwise_or.reduce(extra.reshape(-1, self.slots) << shifts, axis=1).astype(np.uint8).tobytes()
        octets = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :self.most]
        data = octets[np.arange(self.most) <= more[:, None]].tobytes()
        sizes = np.r_[0, np.cumsum(more, dtype=np.int64)]
        sizes = counts + sizes[ends] - sizes[ends - counts]
        return _cut(control, rows), _cut(data, sizes)

    def decode(self, control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ranks of documents with ``counts`` ids, whose control bytes stand one after another."""
        lengths = self.lengths[control]
        rows = -(-counts // self.slots)
        last = (np.cumsum(rows) - 1)[counts > 0]
        used = (counts - (rows - 1) * self.slots)[counts > 0]
        kept = np.ones(lengths.shape, bool)
        kept[last] = np.arange(self.slots) < used[:, None]
        lengths = lengths[kept].astype(np.int64)
        at = np.cumsum(lengths) - lengths
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        ranks = padded[at].astype(np.uint32)
        for k in range(1, self.most):
            ranks |= np.where(lengths > k, padded[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
        return ranks


def _cut(joined: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [joined[b - n:b] for b, n in zip(ends, sizes.tolist())]


def _files(folder: str):
    """The file system of ``folder`` and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if "://" not in folder else fs.FileSystem.from_uri(folder)


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def encode_ids(docs: DataFrame, path: str | None = None, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, counts)``; the ids are little-endian, of two bytes if the vocabulary
    allows it. Besides a row for each document with null ``counts``, there is one for each
    task with null ``ids``: how often it saw each id, as little-endian 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_ids(path or tokenizer_file(TOKENIZER))
        width = _width(coder.size)
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        seen, kind = np.zeros(coder.size, "<i8"), None
        for batch in batches:
            kind = batch.column(0).type
            ids = [coder.encode(t or "") + tail for t in batch.column(1).to_pylist()]
            counts = np.array([len(i) // 4 for i in ids], np.int64)
            joined = np.frombuffer(b"".join(ids), "<u4")
            seen += np.bincount(joined, minlength=coder.size)
            short = joined.astype(width)
            cut = pa.array(_cut(short.tobytes(), counts * short.itemsize), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), cut, pa.nulls(len(ids), pa.binary())], names=names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=names)

    names = [id_col, "ids", "counts"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.BinaryType()) for n in names[1:])])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _add(size: int):
    """Each task's counts to rows of its sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                counts += np.frombuffer(part, "<i8")
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["token", "n"])

    return run


def _code(size: int, width: str, rank_of: np.ndarray, bounds: np.ndarray, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = Coding(size)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            counts = np.array([len(i) // np.dtype(width).itemsize for i in ids], np.int64)
            control, data = coding.encode(rank_of[np.frombuffer(b"".join(ids), width)], counts)
            known = batch.column(0).fill_null(np.iinfo("i8").min).to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.searchsorted(bounds, known, "right").astype("i4")), batch.column(0), pa.array(counts),
                pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                names=["bucket", id_col, "n", "control", "data"])

    return run


class _Writer:
    """One file, block by block."""

    def __init__(self, folder: str, bucket: int) -> None:
        files, at = _files(folder)
        files.create_dir(at, recursive=True)
        self.bucket, self.name = bucket, f"ids-{bucket:08d}-{uuid.uuid4().hex}.bin"
        self.out = files.open_output_stream(f"{at}/{self.name}")
        self.documents = self.ids = 0
        self.rows: list[tuple] = []
        self.waiting = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.documents += 1
        self.ids += row[1]
        self.waiting += row[1]
        if self.waiting >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            ids, counts, control, data = zip(*self.rows)
            control, data = b"".join(control), b"".join(data)
            self.out.write(np.array([len(ids), len(control), len(data)], "<u4").tobytes())
            self.out.write(np.array([i or 0 for i in ids], "<i8").tobytes())
            self.out.write(np.array([i is None for i in ids], "u1").tobytes())
            self.out.write(np.array(counts, "<u4").tobytes())
            self.out.write(control)
            self.out.write(data)
        self.rows, self.waiting = [], 0

    def close(self) -> tuple[int, str, int, int]:
        self.flush()
        self.out.close()
        return self.bucket, self.name, self.documents, self.ids


def _write(folder: str):
    names = ["bucket", "name", "documents", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None or writer.bucket != bucket:
                    if writer is not None:
                        done.append(writer.close())
                    writer = _Writer(folder, bucket)
                writer.add(tuple(row))
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], pa.schema(
            [("bucket", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    return run


def write_corpus(docs: DataFrame, folder: str, path: str | None = None, end: int | None = END, file_ids: int = FILE_IDS,
                 id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all texts (null: empty) as ids, each followed by ``end``, in ascending
    order of the whole-number ``id_col`` (nulls first; rows of one id in the order of
    their coded bytes). Files hold about ``file_ids`` ids. Returns ``folder``."""
    spark = docs.sparkSession
    size = text_ids(path or tokenizer_file(TOKENIZER)).size
    width = _width(size)
    encoded = stored(encode_ids(docs, path, end, id_col, text_col), "ids", compression="zstd")
    counts = encoded.where("ids is null").select("counts").mapInArrow(_add(size), "token long, n long")
    encoded = encoded.where("ids is not null").select(id_col, "ids")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # one row a token of the vocabulary at most
    token, n = counts["token"].to_numpy(), counts["n"].to_numpy()
    token_of = np.concatenate([token[np.lexsort((token, -n))], np.setdiff1d(np.arange(size), token)]).astype("u4")
    rank_of = np.empty(size, "u4")
    rank_of[token_of] = np.arange(size, dtype="u4")
    parts = max(1, -(-int(n.sum()) // file_ids))
    bounds = encoded.approxQuantile(id_col, [k / parts for k in range(1, parts)], 1 / (20 * parts)) if parts > 1 else []
    bounds = np.unique(np.array(bounds, "f8").astype("i8"))
    coded = encoded.mapInArrow(_code(size, width, rank_of, bounds, id_col), f"bucket int, {id_col} long, n long, control binary, data binary")
    dealt = coded.repartition(parts, "bucket").sortWithinPartitions("bucket", id_col, "control", "data")
    manifest = dealt.mapInArrow(_write(f"{folder}/files"), "bucket int, name string, documents long, ids long")
    manifest.write.parquet(f"{folder}/manifest")
    order = spark.createDataFrame([(i, int(t)) for i, t in enumerate(token_of)], "rank int, token int")
    order.coalesce(1).write.parquet(f"{folder}/ranks")
    return folder


def _read(folder: str, token_of: np.ndarray, id_col: str):
    coding = Coding(len(token_of))

    def blocks(name: str) -> Iterator[tuple]:
        files, at = _files(f"{folder}/files")
        with files.open_input_stream(f"{at}/{name}") as source:
            while head := source.read(12):
                documents, control, data = np.frombuffer(head, "<u4").tolist()
                ids = np.frombuffer(source.read(8 * documents), "<i8")
                null = np.frombuffer(source.read(documents), "u1").astype(bool)
                counts = np.frombuffer(source.read(4 * documents), "<u4").astype("i8")
                control = np.frombuffer(source.read(control), "u1")
                yield ids, null, counts, token_of[coding.decode(control, np.frombuffer(source.read(data), "u1"), counts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for ids, null, counts, tokens in blocks(name):
                    ends = np.cumsum(counts)
                    raw = tokens.astype("<u4").tobytes()
                    values = [raw[4 * (e - c):4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(start + ends - counts), pa.array(counts),
                                                      pa.array(values, pa.binary())], names=[id_col, "start", "n_tokens", "ids"])
                    start += int(ends[-1])

    return run


def read_corpus(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, start, n_tokens, ids)`` of every document of a written corpus:
    ``start`` counts the ids of all documents before it, ``ids`` are little-endian
    unsigned 32-bit integers. One task a file; an empty corpus gives no row."""
    token_of = np.array([r["token"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "u4")
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(_read(folder, token_of, id_col), f"{id_col} long, start long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, path: str | None = None, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``read_corpus`` gives for ``docs`` written to a new folder of the shared one."""
    return read_corpus(docs.sparkSession, write_corpus(docs, new_path(docs.sparkSession, "corpus"), path, end, id_col=id_col, text_col=text_col), id_col)
