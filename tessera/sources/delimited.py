"""Lenient all-text scans of delimited exports (S1-S3, C4 over files).

Lines are read, split into cells and numbered by Spark's own functions; no Python runs on
them. The cells are stored once in the shared folder, so that header detection, catalog
and rows all read one and the same numbering and no line is parsed twice. A small file is
read as one value, cut into lines in memory, and its lines are numbered from 0. Larger files
are split: there a line's number is the byte offset of its split plus its place in the
split: unique and increasing within a file, and dense from 0 in the file's first split.
Files are listed and read some at a time, as the driver holds what it has listed.

A row keeps exactly the cells its line has, empty ones at the end included, and a line may
be of any length. Nothing is type-sniffed: all columns are text.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.names import header_names as header_names_of
from tessera.functions.names import header_names_py as header_names
from tessera.operators.sizing import materialize, materialize_all
from tessera.operators.unify import unify_grid

# Accepted extensions and their delimiters.
DELIMITERS = {".csv": ",", ".txt": ",", ".tsv": "\t"}
# Fixed value: bytes that could be read while a file is opened.
OPEN_COST = 1 << 16
# The bytes of a small file at most, and how many files the driver lists at a time.
SMALL = 1 << 20
LISTED = 100_000


class UnsupportedSource(ValueError):
    pass


def delimiter_for(path: str) -> str:
    low = path.lower()
    for ext, delim in DELIMITERS.items():
        if low.endswith(ext):
            return delim
    raise UnsupportedSource(f"Unsupported file type: {path}")


def _paths(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _one_delimiter(paths: list[str], delim: str | None) -> str:
    if delim is not None:
        return delim
    kinds = {delimiter_for(p) for p in paths}
    if len(kinds) != 1:
        raise UnsupportedSource("mixed delimiters in one read; group the paths first")
    return kinds.pop()


def cells_of(line, delim: str) -> Column:
    """The cells of one record. A cell that begins with a quote goes on to the quote that
    closes it (two quotes stand for one) or to the end of the record; what follows the
    closing quote belongs to the cell. All repeats are possessive: no recursion, whatever
    the length."""
    line = F.col(line) if isinstance(line, str) else line
    d = re.escape(delim)
    body = '[^"]*+(?:""[^"]*+)*+'
    cell = rf'(?s){d}("{body}(?:"[^{d}]*+|$)|[^{d}]*+)'
    found = F.regexp_extract_all(F.concat(F.lit(delim), line), F.lit(cell), F.lit(1))

    def text(raw: Column) -> Column:
        parts = rf'(?s)^"({body})"?(.*)$'
        inner = F.replace(F.regexp_extract(raw, parts, 1), F.lit('""'), F.lit('"'))
        return F.when(raw.startswith('"'), F.concat(inner, F.regexp_extract(raw, parts, 2))).otherwise(raw)

    return F.when(F.contains(line, F.lit('"')), F.transform(found, text)).otherwise(F.split(line, d, -1))


def _reader(spark: SparkSession, **conf: int) -> SparkSession:
    """A session for reads of very many small files: a task takes as many of them as its
    bytes allow (Spark counts 4 MB for each file opened), and they are listed by a few
    tasks a core, not by 10,000 tasks."""
    reader = spark.newSession()
    cores = spark.sparkContext.defaultParallelism
    for name, value in {"spark.sql.files.openCostInBytes": OPEN_COST, "spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * cores,
                        "spark.sql.sources.parallelPartitionDiscovery.threshold": 1, **conf}.items():
        reader.conf.set(name, str(value))
    return reader


def _groups(spark: SparkSession, paths: list[str]) -> Iterator[list[str]]:
    """The paths in groups of ``LISTED`` files, a folder's files together. Folders are
    counted one by one; nothing is cut where a path's matches are not a few folders."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    group: list[str] = []
    held = 0
    for path in paths:
        at = hadoop.Path(path)
        fs = at.getFileSystem(conf)
        found = list(matches) if (matches := fs.globStatus(at)) is not None and len(matches) <= 10_000 else []
        names = [m.getPath().toString() for m in found]
        if not found or not all(m.isDirectory() for m in found) or re.search(r"[*?{}\[\]\\]", "".join(names)):
            group, held = [*group, path], held + (len(matches) if matches is not None else 0)
            continue
        for name in names:
            count = fs.getContentSummary(hadoop.Path(name)).getFileCount()
            if group and held + count > LISTED:
                yield group
                group, held = [], 0
            group, held = [*group, name], held + count
    yield group


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source_file, name, size, content)`` of whole files; filters on name and size open none."""
    return _reader(spark).read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), "content")


def _is_small(size: str = "size", name: str = "name") -> Column:
    """Read as it is: other extensions may be those of compressed files, which the line reader opens."""
    return (F.col(size) <= SMALL) & F.lower(F.col(name)).rlike(rf"({'|'.join(map(re.escape, DELIMITERS))})$")


def _lines(spark: SparkSession, paths: list[str], large: bool = False, **options: str) -> DataFrame:
    """Lines (``large``: only of files that are not small): the session is ``_reader``'s, and splits are
    the same in each read, whatever executors come or go."""
    read = _reader(spark, **{"spark.sql.files.minPartitionNum": spark.sparkContext.defaultParallelism}).read.options(**options).text(paths)
    kept = read.where(~_is_small("_metadata.file_size", "_metadata.file_name")) if large else read
    return kept.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _small_rows(files: DataFrame, delim: str) -> DataFrame:
    """The grid of small files: lines as the line reader cuts them, numbered where they are cut."""
    text = _first_mark_off(F.col("content").cast("string"))
    lines = F.filter(F.split(text, "\r\n|\n|\r", -1), lambda x: x != "")
    numbered = files.where(_is_small()).select("source_file", F.posexplode(F.transform(lines, _first_mark_off)).alias("row_no", "value"))
    return numbered.select("source_file", F.col("row_no").cast("long").alias("row_no"), cells_of("value", delim).alias("cells"))


def _stored(frames: Iterator[DataFrame], spark: SparkSession) -> DataFrame:
    """The frames of all groups of files as one table; mostly there is one group."""
    first = next(frames)
    second = next(frames, None)
    return materialize(first, spark) if second is None else materialize_all(chain([first, second], frames), spark)


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with ``at``: a split is one task's, whole and in order, so these numbers
    increase by one within it. They mean nothing before they are stored."""
    return lines.withColumn("at", F.monotonically_increasing_id())


def _numbered(stored: DataFrame) -> DataFrame:
    """``row_no`` of stored lines: one row a split is joined, measured before broadcast."""
    first = stored.groupBy("source_file", "start").agg(F.min("at").alias("_first"))
    return stored.join(first, ["source_file", "start"]).select("source_file", (F.col("start") + F.col("at") - F.col("_first")).alias("row_no"), "cells")


def _first_mark_off(text: Column) -> Column:
    return F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def _no_mark(value: str) -> Column:
    """A file's first line without a byte order mark."""
    return F.when(F.col("start") == 0, _first_mark_off(F.col(value))).otherwise(F.col(value))


def read_grid(spark: SparkSession, paths, delim: str | None = None, multiline: bool = False) -> DataFrame:
    """``grid(source_file, row_no, cells)`` of many files of any shape, in one read.

    ``cells`` are those of the line, empty ones ``''``; blank lines are skipped.
    ``row_no`` increases within a file and counts its first split densely from 0, so
    ``clean_sheets(..., dense_rows=True)`` finds header candidates with a filter.
    With ``multiline`` quoted cells may hold line breaks (lines end with ``\\n`` or
    ``\\r\\n``); see ``_records``.
    """
    ps = _paths(paths)
    d = _one_delimiter(ps, delim)
    if multiline:
        return _records(spark, _lines(spark, ps, lineSep="\n"), d)
    split = []

    def small() -> Iterator[DataFrame]:
        for group in _groups(spark, ps):
            files = _files(spark, group)
            if not files.where(~_is_small()).select("size").isEmpty():
                split.append(group)
            yield _small_rows(files, d)

    grid = _stored(small(), spark)
    if not split:
        return grid
    lines = (_placed(_lines(spark, g, large=True).where("value <> ''").withColumn("value", _no_mark("value"))) for g in split)
    stored = _stored((x.select("source_file", "start", "at", cells_of("value", d).alias("cells")) for x in lines), spark)
    return grid.unionByName(_numbered(stored))


def _records(spark: SparkSession, lines: DataFrame, delim: str) -> DataFrame:
    """Records of files whose quoted cells may hold line breaks, whatever their splits.

    A line begins a record if the quotes before it in the file are even in number. The
    parity at the beginning of a split comes from the quotes of the splits before it, a row
    a split, for which the files are read once. Then the lines of a split are brought
    together and made into records there, which are stored: lines are shuffled once and no
    line is stored. Only the pieces of a record that goes on over splits (at most two a
    split) are put together after that. A quote that is never closed makes the rest of its
    file one record.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = _placed(lines.withColumn("value", _no_mark("value"))).withColumn("odd", (quotes % 2).cast("int"))
    split, blank = ["source_file", "start"], F.col("value").isin("", "\r")
    earlier = Window.partitionBy("source_file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(odd.groupBy(*split).agg(F.sum("odd").alias("odds")), spark)
    entered = counts.select(*split, F.coalesce(F.sum("odds").over(earlier), F.lit(0)).alias("entered"))
    within = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = odd.join(entered, split).withColumn("begins", (F.col("entered") + F.sum("odd").over(within) - F.col("odd")) % 2 == 0)
    numbered = counted.where(~(F.col("begins") & blank)).withColumn("record", F.sum(F.col("begins").cast("int")).over(within))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n")
    pieces = materialize(numbered.groupBy(*split, "record").agg(text.alias("text")), spark)  # record 0: of an earlier split
    ends = materialize(pieces.groupBy(*split).agg(F.max("record").alias("last"), (F.min("record") == 0).alias("goes_on")), spark)
    following = F.lead("goes_on", 1, False).over(Window.partitionBy("source_file").orderBy("start"))
    places = ends.select(*split, "last", following.alias("followed"), F.coalesce(F.sum("last").over(earlier), F.lit(0)).alias("before"))
    parts = pieces.join(places, split).withColumn("row_no", (F.col("before") + F.col("record") - 1).cast("long"))
    cut = (F.col("record") == 0) | ((F.col("record") == F.col("last")) & F.col("followed"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n")
    mended = parts.where(cut).groupBy("source_file", "row_no").agg(joined.alias("text"))
    records = parts.where(~cut).select("source_file", "row_no", "text").unionByName(mended)
    return records.select("source_file", "row_no", cells_of(F.rtrim("text", F.lit("\r")), delim).alias("cells"))


def heads(grid: DataFrame) -> DataFrame:
    """``(source_file, cells, width)``: the first record and the widest row of each file."""
    return grid.groupBy("source_file").agg(F.min_by("cells", "row_no").alias("cells"), F.max(F.size("cells")).alias("width"))


def first_rows(spark: SparkSession, paths, delim: str | None = None) -> DataFrame:
    """``(source_file, cells)``: every file's first record."""
    return heads(read_grid(spark, paths, delim)).select("source_file", "cells")


def _columns(names: list[str]) -> list[Column]:
    return [F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]


def _padded(header: list, width: int) -> list:
    return list(header) + [None] * (max(width, 1) - len(header))


def read_delimited(spark: SparkSession, paths, delim: str | None = None, multiline: bool = False) -> DataFrame:
    """All-text read of files that share one header.

    Short rows are NULL-padded; empty and quoted-empty cells are NULL; surrounding
    blanks are kept; blank lines are skipped. Rows wider than the header get
    ``column{idx}`` names. A ``source_file`` column is added. Files with different
    headers are refused (``read_sources`` reads them).
    """
    grid = read_grid(spark, paths, delim, multiline)
    found = heads(grid).groupBy("cells").agg(F.max("width").alias("width")).limit(2).collect()
    if len(found) > 1:
        raise UnsupportedSource("files with different headers in one read; use read_sources")
    names = header_names(_padded(found[0]["cells"], found[0]["width"]) if found else [None])
    return grid.where(F.col("row_no") > 0).select(*_columns(names), "source_file")


def _grids(spark: SparkSession, paths) -> DataFrame:
    """One grid of files with any of the known delimiters."""
    by_delim: "OrderedDict[str, list[str]]" = OrderedDict()
    for p in _paths(paths):
        by_delim.setdefault(delimiter_for(p), []).append(p)
    grids = [read_grid(spark, files, d) for d, files in by_delim.items()]
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out


def read_sources(spark: SparkSession, paths) -> list[tuple[tuple, list[str], DataFrame]]:
    """Some files of different shapes -> one all-text DataFrame per distinct header
    (files sharing a header are read together, provenance kept), in order of their
    first file. A plan a shape, and the list of files: for thousands of either use
    ``route_sources``, which has neither.
    """
    grid = _grids(spark, paths)
    found = materialize(heads(grid))
    shapes: "OrderedDict[tuple, list]" = OrderedDict()
    for r in found.orderBy("source_file").collect():
        shapes.setdefault((delimiter_for(r["source_file"]), tuple(r["cells"])), []).append(r)
    out = []
    for (_, header), members in shapes.items():
        names = [r["source_file"] for r in members]
        rows = grid.where((F.col("row_no") > 0) & F.col("source_file").isin(names))
        columns = header_names(_padded(header, max(r["width"] for r in members)))
        out.append((header, names, rows.select(*_columns(columns), "source_file")))
    return out


def route_sources(spark: SparkSession, paths, path: str) -> None:
    """Files of any number of shapes, sorted by shape in one pass: rows are written to
    ``path`` partitioned by ``shape`` (a hash of the header), next to a table of shapes
    (``shape, names, files``) and one of files (``source_file, shape``). No list of files or
    shapes reaches the driver and no plan is made for one; a shape with most of the rows
    is written by as many tasks as it needs."""
    grid = _grids(spark, paths)
    shape = F.substring(F.sha2(F.to_json("cells"), 256), 1, 16).alias("shape")
    files = materialize(heads(grid).select("source_file", shape, "cells", "width"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size("cells"), F.lit(0))))
    shapes = files.groupBy("shape").agg(F.max("width").alias("width"), F.first("cells").alias("cells"), F.count("*").alias("files"))
    shapes.select("shape", header_names_of(padded).alias("names"), "files").write.parquet(f"{path}/shapes")
    files.select("source_file", "shape").write.parquet(f"{path}/files")
    rows = grid.where(F.col("row_no") > 0).join(files.select("source_file", "shape"), "source_file")
    rows.hint("rebalance", "shape").write.partitionBy("shape").parquet(f"{path}/rows")


def read_shape(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """The rows of one routed shape as columns; other shapes' files are not opened."""
    names = spark.read.parquet(f"{path}/shapes").where(F.col("shape") == shape).first()["names"]
    rows = spark.read.schema("source_file string, row_no long, cells array<string>, shape string").parquet(f"{path}/rows")
    return rows.where(F.col("shape") == shape).select(*_columns(names), "source_file")


def unify_routed(spark: SparkSession, path: str, mapping: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``unify`` over all routed shapes at once: ``mapping(source_col, to, ord)``."""
    shapes = spark.read.parquet(f"{path}/shapes").select("shape", F.col("names").alias("header"))
    headers = spark.read.parquet(f"{path}/files").join(shapes, "shape").select("source_file", "header")
    rows = spark.read.schema("source_file string, row_no long, cells array<string>, shape string").parquet(f"{path}/rows")
    empty_is_null = F.transform("cells", lambda c: F.nullif(c, F.lit("")))
    return unify_grid(rows.drop("shape").withColumn("cells", empty_is_null), headers, mapping, fields)


def file_content_hashes(spark: SparkSession, paths) -> DataFrame:
    """``(source_file, content_hash)``: SHA-256 prefix of each file's bytes, of files of any
    size (up to 2 GB without a line break in them). Spark lists no file of no bytes.

    Small files are hashed as one value each. A larger one is one task's, which streams its
    lines into one hash object; lines are taken as bytes, and the file's size tells whether a
    last line break and a byte order mark, which the line reader drops, belong to it. Nothing
    is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, length, rows = None, None, 0, []

        def close() -> None:
            if at is not None:
                missing = at[1] - length  # 1: a last line break, 3: a byte order mark, 4: both
                digest = state[missing >= 3]
                if missing in (1, 4):
                    digest.update(b"\n")
                rows.append((at[0], digest.hexdigest()[:16]))

        for batch in batches:
            for file, size, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, size) != at:
                    close()
                    at, state, length = (file, size), [hashlib.sha256(line), hashlib.sha256(b"\xef\xbb\xbf" + line)], len(line)
                else:
                    for h in state:
                        h.update(b"\n")
                        h.update(line)
                    length += 1 + len(line)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                                         names=["source_file", "content_hash"])

    def hashes() -> Iterator[DataFrame]:
        for group in _groups(spark, _paths(paths)):
            files = _files(spark, group)
            yield files.where(F.col("size") <= SMALL).select("source_file", F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))
            large = files.where(F.col("size") > SMALL).agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)))
            n, largest, total = large.first()
            if n:  # a part is no smaller than the largest file: files are not split
                parts = max(1, min(4 * spark.sparkContext.defaultParallelism, (total + n * OPEN_COST) // largest))
                whole = _reader(spark, **{"spark.sql.files.maxPartitionBytes": max(largest, 1 << 27), "spark.sql.files.minPartitionNum": parts})
                lines = whole.read.option("lineSep", "\n").text(group).where(F.col("_metadata.file_size") > SMALL)
                yield lines.select("_metadata.file_path", "_metadata.file_size", F.col("value").cast("binary")).mapInArrow(run, "source_file string, content_hash string")

    return _stored(hashes(), spark)
