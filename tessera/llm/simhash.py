"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that
differ in at most two bits have one segment that differs in at most one, so each
fingerprint is indexed under its 2 x 32 segment variants with one bit deleted
(set to zero): such a pair meets in the bucket of the differing bit. Equal keys
bring candidates together and the whole fingerprints are compared.

Copies are folded first: only distinct fingerprints are indexed. Buckets are read
as a sorted stream; one that holds more than ``bucket`` fingerprints emits no
pairs, and its members are linked exactly by radius-one points instead: two
fingerprints differ in at most two bits if and only if some 64-bit point is within
one bit of both, so the members of a point (65 at most) all belong together. That
is 65 rows for a member, however large the bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import new_path, stored
from tessera.llm.components import components

MAX_DISTANCE = 2
BLOCK = 1 << 15
BITS = 1 << 15  # rows of a bitmap


def simhash(text: bytes, shingle: int = 3) -> int:
    """Unsigned fingerprint of UTF-8 ``text``; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z alone, and the six ASCII blanks
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, fp)`` and the columns of ``keep`` for every row; ``fp`` is the fingerprint
    as a signed long. A null text counts as empty. Row-local; other columns do not
    leave the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash((t or "").encode(), shingle) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(np.array(fps, "u8").view("i8")), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "fp", *keep])

    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType()), *[docs.schema[c] for c in keep]])
    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64))


def _pairs(keys: np.ndarray, fps: np.ndarray, first: np.ndarray, size: int, distance: int) -> np.ndarray:
    """Verified pairs of all buckets of one size; ``first`` holds their first rows.
    A pair meets in several buckets and is taken from one: the lowest segment that
    differs in at most one bit, and there that bit (bit 0 if none differs)."""
    i, j = np.triu_indices(size, 1)
    left, right = fps[first[:, None] + i].ravel(), fps[first[:, None] + j].ravel()
    variant = np.repeat(keys[first] >> 32, len(i))
    x = (left ^ right).view(np.uint64)
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    in_low = _popcount(low) <= 1
    part = np.where(in_low, low, high)
    bit = np.where(part > 0, _popcount(np.maximum(part, np.uint64(1)) - np.uint64(1)), 0).astype(np.int64)
    ok = (_popcount(x) <= distance) & (variant == np.where(in_low, 0, 32) + bit)
    return np.stack([left[ok], right[ok]])


def _bucket_links(bucket: int, distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, large = np.zeros(0, "i8"), np.zeros(0, "i8"), None

        def emit(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal large
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            sizes = np.diff(np.r_[first, len(keys)])
            over = sizes > bucket
            if large is not None and len(first) and keys[0] == large:
                over[0] = True
            if over.any():
                large = keys[first[over][-1]]
                alone = fps[np.repeat(over, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(alone), pa.nulls(len(alone), pa.int64())], names=["a", "b"])
            for size in np.unique(sizes[~over]):
                if size > 1:
                    starts = first[(sizes == size) & ~over]
                    step = max(1, 2_000_000 // (size * size))
                    for k in range(0, len(starts), step):
                        a, b = _pairs(keys, fps, starts[k:k + step], size, distance)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if not len(keys):
                continue
            cut = np.searchsorted(keys, keys[-1])  # the last bucket may go on
            if len(keys) - cut > bucket or keys[-1] == large:
                cut = len(keys)
            yield from emit(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        yield from emit(keys, fps)

    return run


def near_links(fps: DataFrame, max_distance: int = MAX_DISTANCE, bucket: int = 64) -> DataFrame:
    """Links ``(a, b)`` that connect every two distinct fingerprints of ``fps``
    (column ``fp``, distinct) within ``max_distance`` (0 to 2) bits, directly or
    through others within it."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError("two segments with one deleted bit find up to 2 differing bits")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variant = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    key = "(cast(v as bigint) << 32) | ((fp >>> (32 * (v div 32))) & 4294967295 & ~(1L << (v % 32)))"
    keyed = variant.select(F.expr(key.replace("(v div 32)", "cast(v div 32 as int)")).alias("key"), "fp")
    ordered = keyed.repartition(parts, "key").sortWithinPartitions("key")
    found = stored(ordered.mapInArrow(_bucket_links(bucket, max_distance), "a long, b long"), "links")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if max_distance == 2:  # points within one bit
        shared = "transform(sequence(0, 64), i -> struct(0 as v, if(i = 64, fp, fp ^ (1L << i)) as x))"
    else:  # one bit deleted: the two members of a point differ in that bit alone
        shared = "transform(sequence(0, 63), i -> struct(i as v, fp & ~(1L << i) as x))"
    point = hot.select("fp", F.explode(F.expr(shared)).alias("point"))
    if max_distance == 0:
        point = point.where("false")
    least = point.groupBy("point").agg(F.min("fp").alias("least"))
    star = point.join(least, "point").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return found.where("b is not null").union(star.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_distance: int = MAX_DISTANCE, bucket: int = 64) -> DataFrame:
    """One row a document: ``(id_col, fp, component_id)``, where ``component_id`` is
    the smallest id reachable through links of at most ``max_distance`` bits.

    Null text: empty, and fingerprint zero like any text without words; zeros are
    linked like others. Repeated rows each keep their row. A null id is carried and
    never becomes a component's id unless all its members are null. Empty table: no row.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    roots = components(near_links(classes.select("fp"), max_distance, bucket))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    belongs = stored(rooted.join(least, "root").select("fp", "component_id"), "members")
    return fps.join(belongs, "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_distance: int = MAX_DISTANCE, in_place: bool = False, group_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id, and of rows that
    repeat this id one. Null ids come last. Other columns pass through.

    Texts are read twice and never shuffled: the decisions are taken on narrow rows that
    carry their place (file and row number), and come back to the scan as bitmaps of the
    rows that stay. ``in_place`` says that ``docs`` are Parquet files as read, perhaps
    with rows filtered by fixed conditions; any others are stored first.
    """
    place = _place(docs) if in_place else None
    if place is None:
        docs = stored(docs, "docs")
        place = _place(docs)
    file, row = place["file_path"], place["row_index"]
    placed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), file.alias("_file"), row.alias("_row"))
    fps = stored(fingerprints(placed, "_id", "_text", shingle, ("_file", "_row")), "fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_file", "_row")).alias("first")
    classes = stored(fps.groupBy("fp").agg(first), "classes")
    roots = components(near_links(classes.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(docs, file, row, rooted.select("first._file", "first._row"), group_bytes)


def _place(docs: DataFrame) -> Column | None:
    """The file and row number of the rows of ``docs``, if a Parquet scan gives them."""
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["file_path"], place["row_index"])
    except AnalysisException:  # made from no files, or from files without row numbers
        return None
    return place


def keep_rows(docs: DataFrame, file: Column, row: Column, kept: DataFrame, group_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` whose place ``(_file, _row)`` is in ``kept``, without a shuffle
    of ``docs``. ``kept`` becomes one bitmap for each 32768 rows of a file, a bit a row.
    Bitmaps are broadcast in groups of files of about ``group_bytes`` (some 500 million
    rows a group); if there are several groups, they are read and written one after another."""
    bits = F.bitmap_construct_agg(F.col("_row") % BITS)
    bits = F.substring(bits, F.lit(1), (F.max(F.col("_row") % BITS) / 8).cast("int") + 1)
    maps = kept.groupBy("_file", F.expr(f"_row div {BITS}").alias("_bucket")).agg(bits.alias("_bits"))
    maps = stored(maps, "bitmaps")
    size = maps.agg(F.sum(F.length("_bits") + F.length("_file") + 16)).first()[0] or 0
    groups = -(-size // group_bytes) or 1

    def part(g: int) -> DataFrame:
        mine, some = (docs, maps) if groups == 1 else (docs.where(F.pmod(F.xxhash64(file), F.lit(groups)) == g),
                                                       maps.where(F.pmod(F.xxhash64("_file"), F.lit(groups)) == g))
        at = F.pmod(row, F.lit(BITS))
        byte = F.conv(F.hex(F.substring(some["_bits"], (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        same = (file == some["_file"]) & ((row - at) / BITS == some["_bucket"])
        found = mine.join(F.broadcast(some), same)
        return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*[mine[c] for c in docs.columns])

    if groups == 1:
        return part(0)
    path = new_path(docs.sparkSession, "kept-rows")
    for g in range(groups):
        part(g).write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)
