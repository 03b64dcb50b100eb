"""Lake-scale entry points: many exports of many shapes, one job per question.

``lake_catalog`` reads every file as a cell grid, cleans the sheets (header
row, totals, blanks, dates) and builds the schema catalog; ``unify_lake``
aligns every file through the mapping memory (dictionary proposals confirmed
when no memory is given) and projects all files onto the canonical fields in
one pass. No step plans per file and nothing per file passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import header_names
from tessera.operators import catalog as cat
from tessera.operators import mapping as mp
from tessera.operators.grid import clean_sheets
from tessera.operators.sizing import materialize
from tessera.operators.unify import unify_grid
from tessera.sources.delimited import read_grid


def lake_catalog(spark: SparkSession, paths):
    """``(rows, headers, catalog)`` for all files: cleaned data rows (empty cells NULL), one
    header per file (its names as ``read_delimited`` gives them: blank cells by place,
    repeats numbered), and the catalog (files are ordered by path for "later wins")."""
    grid = read_grid(spark, paths)
    rows, headers = clean_sheets(grid, dense_rows=True)
    rows = rows.withColumn("cells", F.transform("cells", lambda c: F.nullif(c, F.lit(""))))
    headers = materialize(headers.withColumn("header", header_names("header")))
    catalog = materialize(
        cat.introspect_grid(rows, headers).withColumn("source_order", F.col("source_id")))
    return rows, headers, catalog


def lake_sources(catalog: DataFrame) -> DataFrame:
    return cat.fingerprints(catalog).withColumn("source_order", F.col("source_id"))


def unify_lake(spark: SparkSession, paths, memory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Unified canonical table of every file, plus the mapping memory used.

    With ``memory=None`` the dictionary proposal (hits only; other columns
    unmapped) is confirmed for every fingerprint first.
    """
    rows, headers, c = lake_catalog(spark, paths)
    sources = lake_sources(c)
    if memory is None:
        hits = mp.propose_by_synonyms(c).where(F.col("to").isNotNull())
        memory = materialize(mp.confirm_mapping(mp.backfill_unmapped(hits, c), c, sources))
    flat = mp.flat_mapping(sources, memory)
    return unify_grid(rows, headers, flat), memory
