"""Schema catalog over *tables of columns*.

A catalog row describes one column of one source:
``(source_id, pos, name, type, samples array<string>)``. Everything here is a
join or an aggregate over such rows, so one job answers the question for every
file of a lake. Per-source work is bounded by a source's width (its columns),
never by its row count: sample rows are cut to the first ``n`` per source with
a ranked window whose limit Spark applies inside every map task before the
shuffle (``WindowGroupLimit``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import normalize_name
from tessera.operators.sizing import running_sums

SAMPLE_N = 5
VARCHAR = "VARCHAR"


def _first_n(df: DataFrame, part: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _samples(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Ordered sample list per key group (groups already cut to ``n`` rows)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(value), F.lit("")).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias("samples"))


def introspect_grid(grid: DataFrame, headers: DataFrame, n: int = SAMPLE_N) -> DataFrame:
    """Catalog of grid sources.

    ``grid(source_file, row_no, cells)`` holds data rows only;
    ``headers(source_file, header array<string>)``. Columns come from the
    header (also for files without data rows); samples are the first ``n`` data
    rows' cells, NULL or missing -> ``''``. Each file's first rows become one
    small ordered array (at most ``n`` rows), so samples are read per column
    from it with no further join.
    """
    head = _first_n(grid, ["source_file"], ["row_no"], n)
    rows = head.groupBy("source_file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda r: r["cells"]).alias("_rows"))
    cols = headers.join(rows, "source_file", "left").select(
        F.col("source_file").alias("source_id"), F.posexplode("header").alias("pos", "name"), "_rows")
    samples = F.transform(F.coalesce("_rows", F.array().cast("array<array<string>>")),
                          lambda r: F.coalesce(F.get(r, F.col("pos")), F.lit("")))
    return cols.select("source_id", "pos", "name", F.lit(VARCHAR).alias("type"), samples.alias("samples"))


def introspect_long(cells: DataFrame, n: int = SAMPLE_N) -> DataFrame:
    """Catalog of sources given as long cells ``(source_id, row_no, name, value)``.

    ``pos`` is the column's order of first appearance in its source; samples
    are the column's first ``n`` values by ``row_no``. One ranked pass: the
    first sample row is also the first appearance, so positions come from the
    (small) aggregated table.
    """
    head = _first_n(cells, ["source_id", "name"], ["row_no"], n)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("row_no").alias("o"),
                                                 F.coalesce(F.col("value"), F.lit("")).alias("v"))))
    per_col = head.groupBy("source_id", "name").agg(
        F.min("row_no").alias("_first"), F.transform(pairs, lambda x: x["v"]).alias("samples"))
    w = Window.partitionBy("source_id").orderBy("_first", "name")
    return per_col.select(
        "source_id", (F.row_number().over(w) - 1).cast("int").alias("pos"), "name",
        F.lit(VARCHAR).alias("type"), "samples",
    )


def introspect(df: DataFrame, source_col: str = "source_file", order_col: str | None = None,
               n: int = SAMPLE_N) -> DataFrame:
    """Catalog of a wide all-text DataFrame holding one or many sources of one
    shape: first ``n`` rows per source (by ``order_col``), one catalog row per
    column."""
    cols = [c for c in df.columns if c != source_col and c != order_col]
    order = order_col or "_ord"
    base = df if order_col else df.withColumn("_ord", F.monotonically_increasing_id())
    head = _first_n(base, [source_col], [order], n)
    long = head.select(
        F.col(source_col).alias("source_id"), F.col(order).alias("row_no"),
        F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value"))
                               for c in cols])).alias("pos", "cell"),
    )
    samp = _samples(long.select("source_id", "pos", "row_no", F.col("cell.value").alias("value")),
                    ["source_id", "pos"], "row_no", "value")
    names = F.array(*[F.lit(c) for c in cols])
    return samp.select("source_id", F.col("pos").cast("int").alias("pos"), F.element_at(names, F.col("pos") + 1).alias("name"),
                       F.lit(VARCHAR).alias("type"), "samples")


def fingerprints(catalog: DataFrame) -> DataFrame:
    """``(source_id, fingerprint)``: ``h:`` + first 12 hex of SHA-256 over the
    sorted ``norm:type`` pairs joined by ``|`` (duplicates kept)."""
    pair = F.concat(normalize_name("name"), F.lit(":"), F.coalesce(F.col("type"), F.lit("unknown")))
    return catalog.groupBy("source_id").agg(
        F.concat(F.lit("h:"), F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(pair)), "|"), 256), 1, 12))
        .alias("fingerprint")
    )


def known_shapes(sources: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per source: does any mapping (confirmed or not) exist for its fingerprint."""
    fps = mappings.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    return sources.join(fps, "fingerprint", "left").select(
        "source_id", "fingerprint", F.coalesce("_known", F.lit(False)).alias("known")
    )


def batch_known(known: DataFrame) -> DataFrame:
    """One row: batch is known when it is non-empty and every source is known."""
    return known.agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.count_if("known").alias("n_known"),
        (F.coalesce(F.every("known"), F.lit(False)) & (F.count(F.lit(1)) > 0)).alias("known_fingerprint"),
    )


def next_version(df: DataFrame, by: list[str] | None = None, version: str = "version") -> DataFrame:
    """``max(version) + 1`` (1 when empty), per ``by`` group or overall."""
    nv = (F.coalesce(F.max(version), F.lit(0)) + 1).cast("int").alias("next_version")
    return df.groupBy(*(by or [])).agg(nv)


def latest_version(df: DataFrame, by: list[str] | None = None, version: str = "version",
                   tiebreak: str | None = "id") -> DataFrame:
    """The newest row per group (``max_by`` over version, then id): a partial
    aggregate, no sort of the group."""
    cols = [c for c in df.columns if c not in (by or [])]
    order = F.struct(F.col(version), F.col(tiebreak)) if tiebreak else F.col(version)
    latest = F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r")
    return df.groupBy(*(by or [])).agg(latest).select(*(by or []), *[F.col("_r")[c].alias(c) for c in cols])


def append_versions(existing: DataFrame, new: DataFrame, by: str = "name", order: str = "id",
                    version: str = "version") -> DataFrame:
    """Version a batch of new rows (skills, canonical schemas) per ``by``:
    the existing maximum + 1, then + 2 ... in ``order`` within the batch.
    The existing table is reduced to one row per key first (partial aggregate); a name
    with any share of the new rows is numbered in as many tasks as its rows need."""
    top = existing.groupBy(by).agg(F.max(version).alias("_max"))
    placed = running_sums(new, by, [order], {"_place": F.lit(1)})
    numbered = placed.join(top, by, "left").withColumn(version, (F.coalesce("_max", F.lit(0)) + F.col("_place")).cast("int"))
    return numbered.drop("_max", "_place")


def list_newest_first(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.col(id_col).desc())


def column_origins(catalog: DataFrame) -> DataFrame:
    """Column name -> files carrying it, long form ``(name, source_id, n_files)``.

    A name carried by millions of files stays a set of rows, never one list.
    """
    pairs = catalog.select("name", "source_id").distinct()
    counts = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))
    return pairs.join(counts, "name")


def match_skills(sources: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills whose fingerprint equals a source's fingerprint (equi-join)."""
    return sources.join(skills, "fingerprint")


def match_classes(sources: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``match_skills`` without its pairs: a row for each fingerprint that both sides have,
    ``(fingerprint, n_sources, n_skills)``, and the members of these classes, ``(fingerprint,
    side, member)`` with ``side`` 'source' or 'skill'. As many rows as there are sources and
    skills at most, however many share one fingerprint; ``expand_matches`` gives the pairs."""
    members = sources.select("fingerprint", F.lit("source").alias("side"), F.col("source_id").cast("string").alias("member")).unionByName(
        skills.select("fingerprint", F.lit("skill").alias("side"), F.col("skill_id").cast("string").alias("member")))
    counts = members.groupBy("fingerprint").agg(F.count_if(F.col("side") == "source").alias("n_sources"), F.count_if(F.col("side") == "skill").alias("n_skills"))
    classes = counts.where((F.col("n_sources") > 0) & (F.col("n_skills") > 0))
    return classes, members.join(classes.select("fingerprint"), "fingerprint", "left_semi")


def expand_matches(members: DataFrame) -> DataFrame:
    """``(fingerprint, source_id, skill_id)``: all pairs of the classes' members."""
    side = lambda s, name: members.where(F.col("side") == s).select("fingerprint", F.col("member").alias(name))
    return side("source", "source_id").join(side("skill", "skill_id"), "fingerprint")
