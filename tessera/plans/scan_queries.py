"""Registered queries for the lenient scans (S1-S3): the framed tables are
written as real CSV exports into a fresh folder under the cluster's shared
``spark.checkpoint.dir`` and read back with the scan operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.grid import clean_sheets
from tessera.operators.unify import unify
from tessera.plans import frames as fr
from tessera.plans.grid_queries import G_CHAIN
from tessera.operators.mapping import CANON_META, propose_by_synonyms
from tessera.plans.catalog_queries import SYN
from tessera.plans.oracle import CUST, SHEETS, SUPP, fp_cte, with_ctes
from tessera.plans.registry import register
from tessera.session import shared_folder
from tessera.sources.delimited import file_content_hashes, read_delimited, read_grid, read_sources, route_sources, unify_routed


def export_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera-exports/{name}-{uuid.uuid4().hex}"


def write_csv_export(df: DataFrame, path: str) -> str:
    """All-text CSV with a header line per file; blanks around values kept."""
    (df.write.mode("overwrite").option("header", "true")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .csv(path))
    return f"{path}/*.csv"


def _csv_cell(c):
    quoted = F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    return F.when(c.rlike('[",\\n\\r]'), quoted).otherwise(c)


# Characters that Spark escapes in the folder name of a partition, and its name for no value.
_UNSAFE = r"""["#%'*/:=?\\\x7f{\[\]^\x01-\x1f]"""
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _file_name(c):
    """A sheet's name as Spark writes it in a partition's folder name."""
    escaped = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(_UNSAFE), F.concat(F.lit("%"), F.hex(x))).otherwise(x)), "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(_NO_NAME)).when(c.rlike(_UNSAFE), escaped).otherwise(c)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder of a path in a mounted file system, where a file is opened as any other."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _write_files(folder: str):
    """A task's sheets into a folder of its own. A file gets its name when it is whole, so
    that a second attempt of the task does no harm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        into = f"{folder}/{task.partitionId():06d}.txt"
        part, name, out, files = f"{into}/_{task.taskAttemptId()}", None, None, 0

        def close() -> None:
            out.close()
            os.replace(part, f"{into}/fname={name}.txt")

        for batch in batches:
            for fname, rows in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=itemgetter(0)):
                if fname != name:
                    if out:
                        close()
                    os.makedirs(into, exist_ok=True)
                    name, out, files = fname, open(part, "wb"), files + 1
                out.write(b"".join(line for _, line in rows))
        if out:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


def write_grid_export(grid: DataFrame, path: str) -> str:
    """One text file per sheet (rows in order), its name after ``fname=`` in the path; paths
    sort as the names do. As many tasks as are asked for: the time is that of opening files,
    not of their bytes. In a mounted file system tasks write files as they are, many to a
    folder: Hadoop starts processes that set the rights of each file it makes there, and
    keeps a second file of checksums. Elsewhere Spark writes them, a folder a sheet."""
    spark = grid.sparkSession
    tasks, folder = 4 * spark.sparkContext.defaultParallelism, _local_folder(spark, path)
    lines = grid.select("source_file", "row_no", F.concat_ws(",", F.transform("cells", _csv_cell)).alias("value"))
    if folder is None:
        (lines.withColumnRenamed("source_file", "fname").repartition(tasks, "fname").sortWithinPartitions("fname", "row_no")
         .select("fname", "value").write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy("fname").text(path))
    else:
        named = lines.select(_file_name(F.col("source_file")).alias("fname"), "row_no", F.concat("value", F.lit("\n")).cast("binary").alias("value"))
        placed = named.repartitionByRange(tasks, "fname").sortWithinPartitions("fname", "row_no").select("fname", "value")
        placed.mapInArrow(_write_files(folder), "files long").agg(F.sum("files")).collect()
        return f"{path}/*.txt"
    return f"{path}/*/*.txt"


def _sheet_name(column: str):
    return F.url_decode(F.regexp_extract(column, r"fname=([^/]+?)(?:/[^/]*|\.txt)$", 1))


_CUST_COLS = '"Cust Name", "Date Purchased", "Amount USD", "Country", "Phone", "Segment"'


@register("s1_read_delimited", with_ctes(CUST, body=f"SELECT {_CUST_COLS} FROM cust"))
def s1_read_delimited(spark, sf):
    cust = fr.customer_export(spark, sf).drop("source_file")
    path = write_csv_export(cust.repartition(4), export_dir(spark, "customers"))
    return read_delimited(spark, path).drop("source_file")


@register("s3_read_sources", with_ctes(CUST, SUPP, body="""
SELECT "Country" AS country, "Cust Name" AS customer_name, "Date Purchased" AS order_date, "Phone" AS phone,
       "Amount USD" AS revenue FROM cust
UNION ALL
SELECT "国家", "客户名称", "订单日期", "电话", "金额" FROM supp"""))
def s3_read_sources(spark, sf):
    """Two exports of different shapes in one folder: grouped by header, read
    one scan per shape, unified."""
    d = export_dir(spark, "sales")
    write_csv_export(fr.customer_export(spark, sf).drop("source_file").repartition(3), f"{d}/customers")
    write_csv_export(fr.supplier_export(spark, sf).drop("source_file").repartition(2), f"{d}/suppliers")
    shapes = read_sources(spark, [f"{d}/customers/*.csv", f"{d}/suppliers/*.csv"])
    parts = [(str(i), df) for i, (_, _, df) in enumerate(shapes)]
    return unify(parts, fr.SALES_MAPPING).drop("source_file")


@register("s2_read_grid", with_ctes(*G_CHAIN, body="""
SELECT source_file, array_to_string(cells, '|') AS cells FROM gb4"""))
def s2_read_grid(spark, sf):
    """Raw freight sheets written as CSV text files, read back as grids (one
    job for all files), named by their sheet, cleaned."""
    path = write_grid_export(fr.freight_grid(spark, sf), export_dir(spark, "freight"))
    grid = read_grid(spark, path)
    named = grid.withColumn("source_file", _sheet_name("source_file"))
    rows, _ = clean_sheets(named, dense_rows=True)
    return rows.select("source_file", F.array_join("cells", "|").alias("cells"))


@register("s6_write_result", with_ctes(*SHEETS, body="""
SELECT source_id, CAST(pos AS VARCHAR) AS pos, name, type,
       CASE WHEN samples = '' THEN '[]' ELSE CAST(to_json(string_split(samples, '|')) AS VARCHAR) END AS samples
FROM sheet_catalog"""))
def s6_write_result(spark, sf):
    """A result with nested cells (the sheet catalog's sample lists) written as
    a CSV table: nested cells become JSON text, NULL an empty cell; read back."""
    from tessera.plans.catalog_queries import sheet_catalog
    from tessera.sources.sinks import write_result

    path = export_dir(spark, "catalog")
    write_result(sheet_catalog(spark, sf).drop("source_order"), path, "csv")
    return spark.read.option("header", "true").option("multiLine", "true").csv(path)


@register("u2_unify_lake", with_ctes(*SHEETS, SYN, ("rp", """
SELECT c.source_id, c.pos, s.canonical AS field FROM sheet_catalog c JOIN syn s ON s.norm = """
    + "trim(regexp_replace(lower(c.name), '[^0-9a-z一-鿿]+', '_', 'g'), '_')"), ("pick", """
SELECT source_id, field, min(pos) AS pos FROM rp GROUP BY source_id, field"""), ("cells", """
SELECT v.source_id, v.row_no, p.field,
       CASE WHEN p.field = 'order_date' THEN v.value || 'T00:00:00' ELSE v.value END AS value
FROM sheet_cells v JOIN pick p USING (source_id, pos)"""), body=", ".join(
    [f"SELECT max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in sorted(CANON_META)]).replace(", SELECT", ",")
    + ", source_id AS source_file FROM cells GROUP BY source_id, row_no"))
def u2_unify_lake(spark, sf):
    """Every customer sheet written as its own CSV file (header row, then its
    orders), then the whole lake path on the files: grids, cleaning, catalog,
    fingerprints, dictionary proposal confirmed as mapping memory, one-pass
    union onto the canonical fields."""
    from tessera.plans.lake import unify_lake

    headers = fr.sheet_headers(spark, sf).select("source_file", F.lit(-1).cast("long").alias("row_no"),
                                                 F.col("header").alias("cells"))
    grid = headers.unionByName(fr.sheet_grid(spark, sf))
    path = write_grid_export(grid, export_dir(spark, "sheets"))
    table, _ = unify_lake(spark, path)
    return table.withColumn("source_file", _sheet_name("source_file"))


def _sheet_files(spark, sf, header=None) -> str:
    """Every customer sheet as a file of its own: its header, then its orders."""
    named = fr.sheet_headers(spark, sf).withColumn("header", header if header is not None else F.col("header"))
    heads = named.select("source_file", F.lit(-1).cast("long").alias("row_no"), F.col("header").alias("cells"))
    return write_grid_export(heads.unionByName(fr.sheet_grid(spark, sf)), export_dir(spark, "sheets"))


@register("s1_multiline_cells", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, nullif(text, '') AS text FROM documents""")
def s1_multiline_cells(spark, sf):
    """All documents as CSV files whose quoted cells hold line breaks, read back by several
    tasks a file."""
    docs = fr.table(spark, sf, "documents").select(F.col("doc_id").cast("string"), "lang", "text")
    path = export_dir(spark, "texts")
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_delimited(spark, f"{path}/*.csv", multiline=True).drop("source_file")


@register("s3_route_sources", with_ctes(*SHEETS, SYN, ("rp", """
SELECT c.source_id, c.pos, s.canonical AS field FROM sheet_catalog c JOIN syn s ON s.norm = """
    + "trim(regexp_replace(lower(c.name), '[^0-9a-z一-鿿]+', '_', 'g'), '_')"), ("pick", """
SELECT source_id, field, min(pos) AS pos FROM rp GROUP BY source_id, field"""), ("cells", """
SELECT v.source_id, v.row_no, p.field, v.value FROM sheet_cells v JOIN pick p USING (source_id, pos)"""), body="SELECT "
    + ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in sorted(CANON_META))
    + ", source_id AS source_file FROM cells GROUP BY source_id, row_no"))
def s3_route_sources(spark, sf):
    """Every customer sheet as a file: sorted by shape in one pass, then all shapes unified."""
    path = export_dir(spark, "routed")
    route_sources(spark, _sheet_files(spark, sf), path)
    names = spark.read.parquet(f"{path}/shapes").select(F.explode("names").alias("name"))
    hits = propose_by_synonyms(names).where(F.col("to").isNotNull())
    table = unify_routed(spark, path, hits.select("source_col", "to", F.lit(0).alias("ord")), sorted(CANON_META))
    return table.withColumn("source_file", _sheet_name("source_file"))


@register("c4_file_hashes", with_ctes(*SHEETS, ("line", """
SELECT source_id, -1 AS row_no, string_agg(name, ',' ORDER BY pos) AS line FROM sheet_cols GROUP BY source_id
UNION ALL
SELECT source_id, row_no, string_agg(value, ',' ORDER BY pos) FROM sheet_cells GROUP BY source_id, row_no"""), body="""
SELECT source_id AS source_file, substr(sha256(string_agg(line, chr(10) ORDER BY row_no) || chr(10)), 1, 16) AS content_hash FROM line GROUP BY source_id"""))
def c4_file_hashes(spark, sf):
    """The bytes of every sheet's file, hashed where the file is opened."""
    return file_content_hashes(spark, _sheet_files(spark, sf)).withColumn("source_file", _sheet_name("source_file"))


_ODD_HEADERS = ("odd", """
SELECT source_id, pos, name FROM (
  SELECT c.source_id, c.pos, CASE WHEN c.source_order % 4 = 1 AND c.pos = 5 THEN '' WHEN c.source_order % 4 = 2 AND c.pos = 1 THEN upper(f.name) ELSE c.name END AS name
  FROM sheet_catalog c JOIN (SELECT source_id, name FROM sheet_catalog WHERE pos = 0) f USING (source_id)
  UNION ALL
  SELECT source_id, n + e.extra, e.name FROM (SELECT source_id, source_order, max(pos) AS n FROM sheet_catalog GROUP BY ALL),
    (VALUES (1, 'Cust Name'), (2, ' ')) e(extra, name) WHERE source_order % 4 = 3)""")


@register("u2_lake_headers", with_ctes(*SHEETS, _ODD_HEADERS, ("based", """
SELECT source_id, pos, CASE WHEN trim(name) = '' THEN 'column' || pos ELSE name END AS base FROM odd"""), ("named", """
SELECT source_id, pos, 'VARCHAR' AS type,
  base || CASE WHEN row_number() OVER w > 1 THEN '_' || (row_number() OVER w - 1) ELSE '' END AS name
FROM based WINDOW w AS (PARTITION BY source_id, lower(base) ORDER BY pos)"""), fp_cte("fp", "named"), body="""
SELECT n.source_id, CAST(n.pos AS INTEGER) AS pos, n.name, f.fingerprint FROM named n JOIN fp f USING (source_id)"""))
def u2_lake_headers(spark, sf):
    """Sheets with blank, repeated and over-wide headers: the lake catalog names and
    fingerprints their columns as the delimited scan does."""
    from tessera.plans.lake import lake_catalog, lake_sources

    k, h = F.col("source_order"), F.col("header")
    odd = (F.when(k % 4 == 1, F.transform(h, lambda c, i: F.when(i == 5, F.lit("")).otherwise(c)))
           .when(k % 4 == 2, F.transform(h, lambda c, i: F.when(i == 1, F.upper(F.get(h, F.lit(0)))).otherwise(c)))
           .when(k % 4 == 3, F.concat(h, F.array(F.lit("Cust Name"), F.lit(" ")))).otherwise(h))
    _, _, catalog = lake_catalog(spark, _sheet_files(spark, sf, odd))
    named = catalog.withColumn("source_id", _sheet_name("source_id"))
    return named.join(lake_sources(named).select("source_id", "fingerprint"), "source_id").select("source_id", "pos", "name", "fingerprint")
