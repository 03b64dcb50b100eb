"""Best-fit packing of documents into sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so the sorted lists of documents and
of gaps are kept run-length encoded: at most ``capacity`` document sizes with their
counts, and runs of sequences that have the same gap. A round takes all documents
of one size, the largest first, and sweeps the gaps upward from their successor
(the smallest that is large enough). Several documents want the same gap; their
ranks decide which of them gets which place of which sequence. The gaps are updated
and the next round starts. What the rounds give is a list of rank ranges, whose
length depends on the capacity and not on the number of documents; each document
looks up its own rank. Row work (tokens, ranks, placing) is distributed, and a size
that many documents share is ranked in salted parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ranked, stored, tokenizer_file
from tessera.llm.textids import text_ids

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
SEPARATOR = 0


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, separator: int | None = SEPARATOR,
           id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32[, ids])``: each document's ids,
    followed by ``separator``, cut at multiples of ``capacity``. A null or empty text
    has the separator alone. ``ids`` are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(path or tokenizer_file(TOKENIZER)).encode
        tail = b"" if separator is None else int(separator).to_bytes(4, "little")
        for batch in batches:
            row, piece, length, crc, kept = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            number = np.array(piece, "i8")
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number.astype("i4")), pa.array(number * capacity),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(kept, pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
              *(T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32"))]
    fields += [T.StructField("ids", T.BinaryType())] * keep_ids
    names = [f.name for f in fields]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts`` documents of each size: ``(size, first rank, documents a
    sequence, first sequence, offset)``, ordered by size and first rank. From its first
    rank on, documents fill the sequences in turn, so many in each, up to the next entry."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    sizes: list[int] = []  # the gaps there are, ascending
    places, opened = [], 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} is not in 1..{capacity}")

        def fill(gap: int, first: int, n: int) -> None:
            """Documents into ``n`` sequences from ``first`` on; the gaps that remain are given back."""
            nonlocal rank, left
            each = gap // size
            whole, rest = min(n, left // each), 0
            if whole < n:
                rest = left - whole * each
            places.append((size, rank, each, first, capacity - gap))
            taken = whole * each + rest
            rank, left = rank + taken, left - taken
            give(gap - each * size, first, whole)
            if rest:
                give(gap - rest * size, first + whole, 1)
            give(gap, first + whole + (rest > 0), n - whole - (rest > 0))

        at = bisect_left(sizes, size)
        wanted = sizes[at:]
        for gap in wanted:
            if not left:
                break
            runs = gaps.pop(gap)
            sizes.remove(gap)
            for k, (first, n) in enumerate(runs):
                if not left:
                    for other, m in runs[k:]:
                        give(gap, other, m)
                    break
                fill(gap, first, n)
        if left:
            n = -(-left // (capacity // size))
            fill(capacity, opened, n)
            opened += n
    return sorted(places)


def pack(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``cut`` (as ``pieces`` gives it) with ``sequence_id`` and ``offset``. Rows that
    are alike in all columns take their places in either order."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = np.array(best_fit(histogram, capacity), "i8").reshape(-1, 5)
    placed = ranked(cut, "length", [id_col, "piece", "ids_crc32"], sizes=histogram).select(*cut.columns, "rank")
    names = [*placed.columns[:-1], "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            low, high = starts[size], starts[size + 1]
            while (high - low > 1).any():  # last entry whose first rank is not above
                middle = (low + high) // 2
                above = plan[np.minimum(middle, len(plan) - 1), 1] > rank
                open_ = high - low > 1
                high = np.where(open_ & above, middle, high)
                low = np.where(open_ & ~above, middle, low)
            _, first_rank, each, first, offset = plan[low].T
            turn, place = np.divmod(rank - first_rank, each)
            columns = [batch.column(n) for n in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first + turn), pa.array(offset + place * size)], names=names)

    schema = T.StructType([*placed.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, separator: int | None = SEPARATOR,
                   id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: one row a piece,
    ``(id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset)``.

    Only documents longer than ``capacity`` are cut. Repeated rows are packed each;
    null ids are carried; other columns are not read; an empty table gives no row."""
    cut = stored(pieces(docs, capacity, path, separator, id_col, text_col, keep_ids), "pieces")
    return pack(cut, capacity, id_col)
