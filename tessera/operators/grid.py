"""Sheet-grid cleaning over ``grid(source_file, row_no, cells array<string>)``.

Everything is a native higher-order array expression on one row, except header
detection, which needs a file's first rows: those are cut to the first 21 per
file with a ranked window (Spark applies the limit inside every map task, so a
huge file contributes 21 rows to the shuffle, not all of its rows). The
per-file header table (one row per file) is then joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.casts import as_col
from tessera.functions.text import WS, bound, is_date_column, iso_date_text, maybe_iso_date, strip_ws, stripped_is_numeric, year_hint

HEAD_CANDIDATES = 10
WIDTH_ROWS = 20
# Subtotal markers (Chinese: contained; English: whole cell,
# case-insensitive).
TOTAL_MARKERS_ZH = ("汇总", "合计", "小计", "总计")
TOTAL_MARKERS_EN = ("total", "subtotal", "grand total", "sum")
BLANK_ROW_SCORE = -10.0


# --- G1 --------------------------------------------------------------------------

def cell_text(c, dtype: T.DataType) -> Column:
    """Typed cell -> text as a sheet export renders it: NULL -> '';
    date/timestamp -> ISO with 'T'; boolean -> TRUE/FALSE; integer-valued
    double -> no '.0'; text -> ISO when date-shaped, else unchanged."""
    x = as_col(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(x, "SSSSSS")
        out = F.when(micros == "000000", F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
            F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    elif isinstance(dtype, T.DateType):
        out = F.date_format(x, "yyyy-MM-dd")
    elif isinstance(dtype, T.BooleanType):
        out = F.when(x, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = x.cast("double")
        integral = (d == F.floor(d)) & (F.abs(d) < F.lit(9.2e18))
        out = F.when(integral, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    elif isinstance(dtype, T.StringType):
        out = iso_date_text(x)
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit(""))


def render_cells(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All (or the given) columns of a typed DataFrame as one rendered row."""
    cols = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.array(*[cell_text(F.col(f"`{c}`"), types[c]) for c in cols])


# --- row predicates and shapes (G2, G5, G6, G11) -----------------------------------

def _nonempty(cells: Column) -> Column:
    return F.filter(cells, lambda c: strip_ws(F.coalesce(c, F.lit(""))) != "")


def is_total_row(cells) -> Column:
    """1-3 non-empty cells and one of them contains a Chinese total marker or
    equals (case-insensitive) an English one.

    A plain-text pre-check on the joined row skips the array work for the
    (vast majority of) rows that carry no marker at all.
    """
    c = as_col(cells)
    ne = F.transform(_nonempty(c), lambda x: strip_ws(x))
    zh = "|".join(TOTAL_MARKERS_ZH)
    marked = F.exists(ne, lambda x: x.rlike(zh) | F.lower(x).isin(*TOTAL_MARKERS_EN))
    n = F.size(ne)
    maybe = F.concat_ws("\u0001", c).rlike("(?i)" + zh + "|total|sum")
    return F.when(maybe, (n >= 1) & (n <= 3) & marked).otherwise(F.lit(False))


def rectangularize(cells, width) -> Column:
    """Pad with '' or cut to ``width`` cells."""
    w = as_col(width) if not isinstance(width, int) else F.lit(width)
    return F.slice(F.concat(as_col(cells), F.array_repeat(F.lit(""), w)), 1, w)


def is_blank_row(cells) -> Column:
    """No cell holds anything but whitespace (checked on the joined row text)."""
    return F.regexp_replace(F.concat_ws("", as_col(cells)), f"{WS}+", "") == ""


# --- G3, G4 ------------------------------------------------------------------------

def row_facts(cells) -> Column:
    """What the score asks of one row, each cell looked at once: how many non-empty cells
    there are, and of these the short, the numeric and the distinct ones. Null: null."""
    c = as_col(cells)

    def facts(ne: Column) -> Column:
        return F.struct(F.size(ne).alias("n"), F.size(F.filter(ne, lambda x: F.length(x) <= 30)).alias("short"),
                        F.size(F.filter(ne, stripped_is_numeric)).alias("numeric"), F.size(F.array_distinct(ne)).alias("distinct"))

    stripped = F.transform(c, lambda x: strip_ws(F.coalesce(x, F.lit(""))))
    return F.when(c.isNotNull(), bound(F.filter(stripped, lambda x: x != ""), facts))


def header_score(facts, next_numeric, ncols) -> Column:
    """Header likelihood of one row from its ``row_facts`` (blank row: -10) and the number
    of numeric cells in the next one (null: there is none)."""
    f = as_col(facts)
    n = f["n"].cast("double")
    score = (
        2.0 * n / as_col(ncols)
        - F.when(n == 1, 2.0).otherwise(0.0)
        + 1.5 * f["short"] / n
        - 2.0 * f["numeric"] / n
        + f["distinct"] / n
        + F.when(as_col(next_numeric) >= 2, 1.0).otherwise(0.0)
    )
    return F.when(n == 0, F.lit(BLANK_ROW_SCORE)).otherwise(score)


def head_rows(grid: DataFrame, n: int = WIDTH_ROWS + 1, dense: bool = False) -> DataFrame:
    """First ``n`` rows of every file with their 0-based index ``idx``.

    ``dense=True``: ``row_no`` counts each file's rows from 0 (``read_grid``
    guarantees this for a file's first split), so the head is a plain filter
    applied before any shuffle. Otherwise a ranked window whose limit Spark
    applies inside every map task.
    """
    if dense:
        return grid.where(F.col("row_no") < n).withColumn("idx", F.col("row_no"))
    w = Window.partitionBy("source_file").orderBy("row_no")
    # the filter must be on the rank itself for Spark to insert WindowGroupLimit
    return (grid.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
            .withColumn("idx", (F.col("_rn") - 1).cast("int")).drop("_rn"))


def render(cells) -> Column:
    """G7 at cell rendering: every date-shaped text cell rewritten to ISO."""
    return F.transform(as_col(cells), lambda c: iso_date_text(c))


def score_head(grid: DataFrame, rendered: bool = True, dense: bool = False) -> DataFrame:
    """``(source_file, idx, row_no, cells, score)`` for the header candidates.

    Only the first 21 rows of each file are kept (and rendered, when the grid
    is raw). Width (widest of the first 20 rows) and the next row come from
    windows on the same ``source_file`` partitioning: one shuffle.
    """
    head = head_rows(grid, dense=dense)
    if not rendered:
        head = head.withColumn("cells", render("cells"))
    by_file = Window.partitionBy("source_file")
    ordered = by_file.orderBy("idx")
    scored = head.withColumn("_facts", row_facts("cells")).select(
        "source_file", "idx", "row_no", "cells", "_facts",
        F.lead("_facts.numeric").over(ordered).alias("_next"),
        F.greatest(F.max(F.when(F.col("idx") < WIDTH_ROWS, F.size("cells"))).over(by_file), F.lit(1)).alias("ncols"),
    ).where(F.col("idx") < HEAD_CANDIDATES)
    return scored.select("source_file", "idx", "row_no", "cells",
                         F.round(header_score("_facts", "_next", "ncols"), 9).alias("score"))


def detect_header_row(grid: DataFrame, rendered: bool = True, dense: bool = False) -> DataFrame:
    """``(source_file, header_idx, header_row_no, header)``: best score among
    the first 10 rows, earliest row on ties. Files without rows get none.
    ``rendered=False``: the grid is raw and its head rows are rendered here."""
    s = score_head(grid, rendered, dense)
    best = s.groupBy("source_file").agg(
        F.max_by(F.struct("idx", "row_no", "cells"), F.struct("score", (-F.col("idx")).alias("neg"))).alias("b"))
    return best.select("source_file", F.col("b.idx").alias("header_idx"), F.col("b.row_no").alias("header_row_no"),
                       F.col("b.cells").alias("header"))


# --- G8-G10 ------------------------------------------------------------------------

def file_name(source_file) -> Column:
    return F.element_at(F.split(as_col(source_file), "/"), -1)


def date_flags(header) -> Column:
    return F.transform(as_col(header), lambda h: is_date_column(h))


def promote_yearless_dates(cells, header, year, flags=None) -> Column:
    """``M.D``/``M-D``/``M/D`` -> ISO with the file's year, only in date columns
    and only when the file name carries a year (other files skip the array pass)."""
    fl = as_col(flags) if flags is not None else date_flags(header)
    y = as_col(year)

    def cell(c, i):
        hit = F.coalesce(F.element_at(fl, i + 1), F.lit(False)) & (strip_ws(c) != "")
        return F.when(hit, F.coalesce(maybe_iso_date(c, y), c)).otherwise(c)

    return F.when(y.isNotNull() & F.array_contains(fl, True), F.transform(as_col(cells), cell)).otherwise(as_col(cells))


# --- G12 ------------------------------------------------------------------------------

def clean_sheets(grid: DataFrame, iso_dates: bool = True, dense_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """Header row detected per file; the rows after it pass the total filter
    (raw width), are padded/cut to the header width, blank rows dropped and
    year-less dates promoted. Returns ``(rows, headers)``:
    ``rows(source_file, row_no, cells)`` and ``headers(source_file, header)``.

    ``iso_dates`` applies the date-text rewrite to every cell (it is part of
    rendering a cell, header included). Rendering is row-local and does not
    change which cells are empty or which rows are totals, so header detection
    renders only each file's first 21 rows, and the body renders each kept row
    once. ``dense_rows``: see ``head_rows`` (true for ``read_grid`` output).
    """
    heads = detect_header_row(grid, rendered=not iso_dates, dense=dense_rows).select(
        "source_file", "header_row_no", "header",
        year_hint(file_name("source_file")).alias("_year"), date_flags("header").alias("_flags"))
    rows = grid.join(heads, "source_file")
    body = (
        rows.where(F.col("row_no") > F.col("header_row_no"))
        .where(~is_total_row("cells"))
        .withColumn("cells", rectangularize("cells", F.size("header")))
        .where(~is_blank_row("cells"))
    )
    if iso_dates:
        body = body.withColumn("cells", render("cells"))
    body = body.withColumn("cells", promote_yearless_dates("cells", "header", "_year", "_flags"))
    return body.select("source_file", "row_no", "cells"), heads.select("source_file", "header")
