"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its s-mers is
that of its first or its last one. Whether it is one depends on its own characters
alone, so an edit changes anchors only where it touches them. A fingerprint holds
all anchors in the lowest ``1 / SHARE`` of hash values, so it grows with its text, and
at least the ``size`` of least hash, each with the place of its first occurrence, in
text order; two fingerprints are compared over the hash values that both hold in full,
and the shared anchors that count are those of the longest chain whose places rise in
both, whatever shifts lie between them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, S = 16, 8
SIZE = 64
SHARE = 8
LIMIT = (1 << 48) // SHARE  # hashes below are always held
ODD = np.uint64(0x9E3779B97F4A7C15)  # odd constant of multiplicative hashing
BLOCK = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of ``n`` (a power of two) codes."""
    h, width, factor = codes, 1, ODD
    while width < n:
        h = h[:-width] * factor + h[width:]
        factor, width = factor * factor, 2 * width
    return h


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all closed syncmers. ``k`` and ``s`` are powers of two.
    A text shorter than ``k`` has one anchor, all of itself; an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) < k:
        value = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.array([value], np.uint64), np.zeros(1, np.int64)
    hashes, places = [], []
    with np.errstate(over="ignore"):
        for at in range(0, len(codes) - k + 1, BLOCK):
            part = codes[at:at + BLOCK + k - 1]
            small = _grams(part, s)
            inner = _mixed(small)
            least, width, span = inner, 1, k - s + 1
            while width < span:  # least of every run of span s-mers
                step = min(width, span - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            n = len(part) - k + 1
            edge = np.flatnonzero((inner[:n] == least) | (inner[k - s:k - s + n] == least))
            whole, factor, width = small, ODD, 1
            while width < s:
                factor, width = factor * factor, 2 * width
            while width < k:
                whole = whole[:-width] * factor + whole[width:]
                factor, width = factor * factor, 2 * width
            hashes.append(_mixed(whole[edge] + ODD))
            places.append(edge + at)
    return np.concatenate(hashes), np.concatenate(places)


def sketch(text: str, size: int = SIZE, k: int = K, s: int = S) -> list[tuple[int, int]]:
    """``(place, hash)`` of the anchors whose 48-bit hash is under ``LIMIT``, at least the
    ``size`` of least hash, in text order."""
    hashes, places = anchors(text, k, s)
    hashes = hashes >> np.uint64(16)
    if len(hashes) > 4 * size:  # the least come first; repeats are few or all alike
        part = hashes <= max(np.partition(hashes, 4 * size)[4 * size], np.uint64(LIMIT))
        if len(np.unique(hashes[part])) >= size:
            hashes, places = hashes[part], places[part]
    kept, first = np.unique(hashes, return_index=True)
    n = max(size, int(np.searchsorted(kept, np.uint64(LIMIT))))
    return sorted(zip(places[first[:n]].tolist(), kept[:n].tolist()))


def written(marks: list[tuple[int, int]]) -> str:
    """``place:hash`` in hexadecimal, comma-joined."""
    return ",".join(f"{p:x}:{h:012x}" for p, h in marks)


def _held(marks: list[tuple[int, int]], size: int) -> int:
    """The hash up to which a fingerprint holds all anchors of its text."""
    return 1 << 48 if len(marks) < size else max(LIMIT - 1, max((h for _, h in marks), default=0))


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]], size: int = SIZE) -> float:
    """Share of the anchors of both, as far as both hold them, that both have in the same
    order, 0 to 1. Two empty fingerprints: 1."""
    if a == b:
        return 1.0
    bound = min(_held(a, size), _held(b, size))
    left, right = [(p, h) for p, h in a if h <= bound], {h: p for p, h in b if h <= bound}
    places = [right[h] for _, h in left if h in right]
    ends: list[int] = []  # the least last place of a chain of each length
    for place in places:
        at = bisect_left(ends, place)
        ends[at:at + 1] = [place]
    either = len(left) + len(right) - len(places)
    return len(ends) / either if either else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``(id_col, fingerprint)`` for each row; null text: empty, whose fingerprint is
    the empty string. Row-local; repeated rows and null ids pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [written(sketch(t or "", size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=[id_col, "fingerprint"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


ROW = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _chain(id_col: str, size: int):
    """Rows come by bucket, a bucket's own in order and then the one that follows them."""
    out_rows = 2_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, id, text, marks)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, *columns = zip(*rows)
            made = pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, columns)], names=[id_col, *ROW])
            rows.clear()
            return made

        for batch in batches:
            id_type = batch.column(2).type
            for bucket, tail, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held[0] != bucket:
                    if tail:
                        continue  # follows rows that are not there
                    held = bucket, doc, text, sketch(text, size)
                    continue
                if held[1] is FINISHED:
                    continue  # one row follows; its like are not needed
                marks = sketch(text, size)
                _, before, mine, own = held
                other = edited(mine, text)
                changed = sketch(other, size)
                rows.append((before, len(mine), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), written(own),
                             written(changed), likeness(own, changed, size), likeness(own, marks, size)))
                held = (bucket, FINISHED, "", []) if tail else (bucket, doc, text, marks)
                if len(rows) >= out_rows:
                    yield flush()
        if rows:
            yield flush()

    return run


FINISHED = object()


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are not above ``value``, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    held = F.lit(bounds)

    def step(a: Column, _: Column) -> Column:
        half = F.shiftright(a["low"] + a["high"], 1)
        right = F.get(held, half) <= value
        moved = F.struct(F.when(right, half + 1).otherwise(a["low"]).alias("low"), F.when(right, a["high"]).otherwise(half).alias("high"))
        return F.when(a["low"] < a["high"], moved).otherwise(a)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.when(value.isNull(), 0).otherwise(F.aggregate(steps, start, step, lambda a: a["low"]))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, bucket_rows: int = 2_000) -> DataFrame:
    """``(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``: each text against itself after an edit, and against the next by
    ascending (``id_col``, text); the first follows the last.

    Texts are shuffled once, to ranges of ``id_col`` of about ``bucket_rows`` rows. The
    first row of each range goes to the range before it as well. Null text: empty.
    Null ids come first. A repeated row's next is its copy; a single row's, itself."""
    spark = docs.sparkSession
    text = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = docs.select(id_col).count()
    parts = max(1, -(-n // bucket_rows))
    bounds = docs.approxQuantile(id_col, [k / parts for k in range(1, parts)], 1 / (20 * parts)) if parts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    numbered = text.withColumn("_bucket", _bucket(F.col(id_col), bounds))
    firsts = numbered.groupBy("_bucket").agg(F.min(F.struct(F.col(id_col).isNotNull(), F.col(id_col)))[id_col].alias("_first"))
    there = firsts.orderBy("_bucket").collect()  # one row a range
    before = [(r["_first"], there[k - 1]["_bucket"]) for k, r in enumerate(there)]
    tails = spark.createDataFrame(before, T.StructType([T.StructField("_first", docs.schema[id_col].dataType), T.StructField("_before", T.IntegerType())]))
    marked = numbered.join(F.broadcast(tails), numbered[id_col].eqNullSafe(tails["_first"]), "left")
    own = F.struct(F.col("_bucket"), F.lit(False).alias("_tail"))
    also = F.struct(F.col("_before").alias("_bucket"), F.lit(True).alias("_tail"))
    sent = marked.select(F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("_to"), id_col, "_text")
    dealt = sent.select("_to._bucket", "_to._tail", id_col, "_text").repartition(max(1, parts // 2), "_bucket")
    ordered = dealt.sortWithinPartitions("_bucket", "_tail", id_col, "_text")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()),
                           *(T.StructField(c, T.StringType()) for c in ROW[1:4]), *(T.StructField(c, T.DoubleType()) for c in ROW[4:])])
    return ordered.mapInArrow(_chain(id_col, size), schema)
