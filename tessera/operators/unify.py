"""Unification: every source projected onto the canonical fields, unioned.

``unify`` builds one projection per *shape* (a DataFrame may hold many files
sharing a header, with ``source_file`` per row). ``unify_grid`` handles any
number of shapes in one pass over a cell grid: a position map per file is
joined in and each field is read with ``get(cells, pos)``; no per-file plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(mapping) -> list[tuple[str, str]]:
    items = mapping.items() if isinstance(mapping, dict) else mapping
    return [(s, t) for s, t in items if t]


def canonical_fields(mapping) -> list[str]:
    """Distinct targets in code-point order."""
    return sorted({t for _, t in _pairs(mapping)})


def project_source(df: DataFrame, mapping, name: str | None = None) -> DataFrame:
    """One source onto the canonical fields: per field the first mapping entry
    whose column exists here wins; absent fields are NULL text; then
    ``source_file``."""
    pairs = _pairs(mapping)
    present = set(df.columns)
    chosen = {field: src for src, field in reversed(pairs) if src in present}  # the first entry is written last
    cols = [(F.col(f"`{chosen[field]}`") if field in chosen else F.lit(None)).cast("string").alias(field)
            for field in canonical_fields(pairs)]
    if "source_file" in present:
        cols.append(F.col("source_file").cast("string").alias("source_file"))
    else:
        cols.append(F.lit(name).cast("string").alias("source_file"))
    return df.select(*cols)


def unify(sources, mapping) -> DataFrame:
    """``sources``: list of ``(name, DataFrame)`` (or a dict). Union all of the
    canonical projections; column pruning reaches every scan."""
    items = sources.items() if isinstance(sources, dict) else sources
    parts = [project_source(df, mapping, name) for name, df in items]
    if not parts:
        raise ValueError("no sources")
    return reduce(lambda a, b: a.unionByName(b), parts)


def position_map(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(source_file, field, pos)``: for each file and canonical field, the
    0-based cell position of the first mapping entry present in the header.

    ``headers(source_file, header array<string>)``;
    ``mapping(source_col, to, ord)`` where ``ord`` is the mapping-entry order.
    """
    cols = headers.select("source_file", F.posexplode("header").alias("pos", "source_col"))
    hits = cols.join(mapping.where(F.col("to").isNotNull()), "source_col")
    return (
        hits.groupBy("source_file", F.col("to").alias("field"))
        .agg(F.min_by("pos", F.struct("ord", "pos")).alias("pos"))
    )


def unify_grid(grid: DataFrame, headers: DataFrame, mapping: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Same result as ``unify`` for any number of shapes, one pass over
    ``grid(source_file, row_no, cells)`` (data rows, header already removed).

    The per-file map ``field -> pos`` is joined by ``source_file``. ``fields`` names
    the output columns; without it they are the mapping's targets, one column each.
    """
    if fields is None:
        fields = [r[0] for r in mapping.where(F.col("to").isNotNull()).select("to").distinct().collect()]
    fields = sorted(set(fields))
    pm = position_map(headers, mapping)
    per_file = pm.groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("field", "pos"))).alias("_pos"))
    joined = grid.join(per_file, "source_file", "left")
    cols = [F.get(F.col("cells"), F.col("_pos")[f]).cast("string").alias(f) for f in fields]
    return joined.select(*cols, F.col("source_file"))


def sheet_frame(grid: DataFrame, headers: DataFrame, columns: list[str]) -> DataFrame:
    """Wide all-text DataFrame over many grid files: one column per name in
    ``columns``, read in every file at the position of its header cell with
    the same normalized name (NULL when the file lacks it), plus
    ``source_file``. One pass, no per-file plan."""
    from tessera.functions.text import norm_name_py, normalize_name

    cols = headers.select("source_file", F.posexplode("header").alias("pos", "name"))
    by_norm = cols.withColumn("norm", normalize_name("name")).groupBy("source_file", "norm").agg(
        F.min("pos").alias("pos"))
    per_file = by_norm.groupBy("source_file").agg(
        F.map_from_entries(F.collect_list(F.struct("norm", "pos"))).alias("_pos"))
    joined = grid.join(per_file, "source_file")
    out = [F.get(F.col("cells"), F.col("_pos")[norm_name_py(c)]).alias(c) for c in columns]
    return joined.select(*out, "source_file")


def replay_union(frames: list[DataFrame]) -> DataFrame:
    """Union of per-source step results, by name (missing columns -> NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def by_source(df: DataFrame, *aggs) -> DataFrame:
    """``source_file`` as the grouping dimension ("by file")."""
    return df.groupBy("source_file").agg(*aggs)
