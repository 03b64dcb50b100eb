"""Registered queries for sheet-grid cleaning (G1-G12), the grid union
and the replay union (U3), with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import is_date_column, is_numeric_text, iso_date_text, year_hint
from tessera.operators import catalog as cat
from tessera.operators import grid as gd
from tessera.operators import ops
from tessera.operators.sizing import materialize
from tessera.operators.unify import replay_union, unify_grid
from tessera.plans import frames as fr
from tessera.plans.oracle import CUST, SHEETS, SUPP, q, with_ctes
from tessera.plans.registry import register
from tessera.plans.catalog_queries import SYN, sheet_catalog, sheet_memory, sheet_sources
from tessera.operators import mapping as mp

# --- SQL expression helpers (DuckDB) ----------------------------------------------


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def isnum(x: str) -> str:
    t = f"replace({strip(x)}, ',', '')"
    return f"({t} <> '' AND TRY_CAST({t} AS DOUBLE) IS NOT NULL)"


_SEP = r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*$"
_ZH = r"^\s*(\d{4})年(\d{1,2})月(\d{1,2})日\s*$"
_NOYEAR = r"^\s*(\d{1,2})[./-](\d{1,2})\s*$"


def _grp(x: str, pat: str, i: int) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, '{pat}', {i}), '') AS INTEGER)"


def _iso_valid(y, m, d, hh="0", mi="0", ss="0") -> str:
    txt = f"printf('%04d-%02d-%02d %02d:%02d:%02d', {y}, {m}, {d}, {hh}, {mi}, {ss})"
    return (f"CASE WHEN {y} >= 1 AND {hh} < 24 AND {mi} < 60 AND {ss} < 60 "
            f"THEN strftime(TRY_CAST({txt} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') END")


def iso(x: str, yr: str | None = None) -> str:
    g = lambda i: _grp(x, _SEP, i)
    sep = _iso_valid(g(1), g(2), g(3), f"COALESCE({g(4)}, 0)", f"COALESCE({g(5)}, 0)", f"COALESCE({g(6)}, 0)")
    z = lambda i: _grp(x, _ZH, i)
    zh = _iso_valid(z(1), z(2), z(3))
    arms = f"WHEN regexp_matches({x}, '{_SEP}') THEN {sep} WHEN regexp_matches({x}, '{_ZH}') THEN {zh}"
    if yr is not None:
        m, d = _grp(x, _NOYEAR, 1), _grp(x, _NOYEAR, 2)
        arms += (f" WHEN {yr} IS NOT NULL AND regexp_matches({x}, '{_NOYEAR}') THEN "
                 f"CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN {_iso_valid(yr, m, d)} END")
    return f"(CASE {arms} END)"


def _fname_sql(k: str) -> str:
    return (f"'freight_' || CAST({k} AS VARCHAR) || CASE WHEN {k} % 2 = 0 THEN '_2023年' ELSE '' END || '.csv'")


_DT = ("CASE o_orderkey % 4 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') "
       "WHEN 1 THEN strftime(CAST(o_orderdate AS DATE), '%Y/%-m/%-d') "
       "WHEN 2 THEN strftime(CAST(o_orderdate AS DATE), '%Y年%-m月%-d日') "
       "ELSE strftime(CAST(o_orderdate AS DATE), '%-m.%-d') END")
_PRICE = "CAST(o_totalprice AS VARCHAR)"
_FULL = f"CAST(o_orderkey AS VARCHAR), {_DT}, {_PRICE}, o_orderstatus, o_orderpriority"
_SHORT = f"CAST(o_orderkey AS VARCHAR), {_DT}, {_PRICE}"
_OJ = "FROM orders JOIN customer ON o_custkey = c_custkey"

G_FRAME = ("gf", f"""
SELECT {_fname_sql('c_custkey')} AS source_file, CAST(0 AS BIGINT) AS row_no,
       [{q(fr.FREIGHT_TITLE)} || c_name] AS cells FROM customer WHERE c_custkey % 4 <> 3
UNION ALL
SELECT {_fname_sql('c_custkey')}, CAST(1 AS BIGINT), [{q(fr.FREIGHT_HEADER[0])}, {q(fr.FREIGHT_HEADER[1])},
       CASE WHEN c_custkey % 3 = 0 THEN {q(fr.FREIGHT_AMOUNT_ALT)} ELSE {q(fr.FREIGHT_HEADER[2])} END,
       {q(fr.FREIGHT_HEADER[3])}, {q(fr.FREIGHT_HEADER[4])}] FROM customer
UNION ALL
SELECT {_fname_sql('c_custkey')}, 10 + 3 * o_orderkey,
       CASE WHEN o_orderkey % 11 = 0 THEN [{_SHORT}] WHEN o_orderkey % 13 = 0 THEN [{_FULL}, 'x', 'y']
            ELSE [{_FULL}] END {_OJ}
UNION ALL
SELECT {_fname_sql('c_custkey')}, 10 + 3 * o_orderkey + 1,
       CASE WHEN o_orderkey % 10 = 5 THEN ['Total', '', '', '', {_PRICE}] ELSE ['小计', {_PRICE}] END
       {_OJ} WHERE o_orderkey % 5 = 0
UNION ALL
SELECT {_fname_sql('c_custkey')}, 10 + 3 * o_orderkey + 2, ['', '', '', '', ''] {_OJ} WHERE o_orderkey % 7 = 0""")

G_LONG = ("gl", "SELECT source_file, row_no, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS pos FROM gf")
G_RENDER = ("gr", f"""
SELECT source_file, row_no, list(COALESCE({iso('cell')}, cell) ORDER BY pos) AS cells FROM gl GROUP BY source_file, row_no""")
G_HEAD = ("gh", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY row_no) - 1 AS idx FROM gr) WHERE idx < 21""")
G_NC = ("gnc", "SELECT source_file, greatest(max(len(cells)), 1) AS ncols FROM gh WHERE idx < 20 GROUP BY source_file")
G_CAND = ("gcand", f"""
SELECT source_file, idx, row_no, cells, lead(cells) OVER (PARTITION BY source_file ORDER BY idx) AS nxt,
       list_filter(cells, lambda x: {strip('x')} <> '') AS ne FROM gh""")
_SCORE = f"""CASE WHEN len(ne) = 0 THEN -10.0 ELSE
  2.0 * CAST(len(ne) AS DOUBLE) / ncols
  - CASE WHEN len(ne) = 1 THEN 2.0 ELSE 0.0 END
  + 1.5 * CAST(len(list_filter(ne, lambda x: length({strip('x')}) <= 30)) AS DOUBLE) / len(ne)
  - 2.0 * CAST(len(list_filter(ne, lambda x: {isnum('x')})) AS DOUBLE) / len(ne)
  + CAST(len(list_distinct(list_transform(ne, lambda x: {strip('x')}))) AS DOUBLE) / len(ne)
  + CASE WHEN nxt IS NOT NULL AND len(list_filter(nxt, lambda x: {strip('x')} <> '' AND {isnum('x')})) >= 2
         THEN 1.0 ELSE 0.0 END END"""
G_SCORED = ("gsc", f"""
SELECT c.source_file, c.idx, c.row_no, c.cells, round({_SCORE}, 9) AS score
FROM gcand c JOIN gnc USING (source_file) WHERE c.idx < 10""")
G_HEADS = ("gheads", r"""
SELECT source_file, b['idx'] AS header_idx, b['row_no'] AS header_row_no, b['cells'] AS header,
       TRY_CAST(NULLIF(regexp_extract(source_file, '(\d{4})年', 1), '') AS INTEGER) AS yr
FROM (SELECT source_file, arg_max({'idx': idx, 'row_no': row_no, 'cells': cells}, (score, -idx)) AS b
      FROM gsc GROUP BY source_file)""")
_NE2 = f"list_transform(list_filter(cells, lambda x: {strip('x')} <> ''), lambda x: {strip('x')})"
G_BODY0 = ("gb0", f"""
SELECT r.source_file, r.row_no, r.cells, h.header, h.yr,
  (len({_NE2}) BETWEEN 1 AND 3 AND len(list_filter({_NE2}, lambda x: regexp_matches(x, '汇总|合计|小计|总计')
     OR lower(x) IN ('total', 'subtotal', 'grand total', 'sum'))) > 0) AS is_total
FROM gr r JOIN gheads h USING (source_file) WHERE r.row_no > h.header_row_no""")
G_BODY2 = ("gb2", """
SELECT source_file, row_no, list_resize(cells, len(header), '') AS cells, header, yr FROM gb0 WHERE NOT is_total""")
G_BODY3 = ("gb3", f"""
SELECT *, len(list_filter(cells, lambda x: {strip('x')} <> '')) = 0 AS is_blank FROM gb2""")
G_BODY4L = ("gb4l", """
SELECT source_file, row_no, unnest(cells) AS cell, generate_subscripts(cells, 1) AS p, header, yr
FROM gb3 WHERE NOT is_blank""")
G_BODY4 = ("gb4", f"""
SELECT source_file, row_no, list(CASE WHEN yr IS NOT NULL AND regexp_matches(header[p], '(?i)date|日期|time|时间')
       AND {strip('cell')} <> '' THEN COALESCE({iso('cell', 'yr')}, cell) ELSE cell END ORDER BY p) AS cells
FROM gb4l GROUP BY source_file, row_no""")

G_CHAIN = (G_FRAME, G_LONG, G_RENDER, G_HEAD, G_NC, G_CAND, G_SCORED, G_HEADS, G_BODY0, G_BODY2, G_BODY3,
           G_BODY4L, G_BODY4)


def _grid(spark, sf):
    return fr.freight_grid(spark, sf)


def _rendered(spark, sf):
    return _grid(spark, sf).withColumn("cells", F.transform("cells", lambda c: iso_date_text(c)))


def _body(spark, sf, stored=False):
    """``stored``: rendered once, for a query that filters by the cells and returns them."""
    g = _rendered(spark, sf)
    if stored:
        g = materialize(g)
    heads = gd.detect_header_row(g).withColumn("yr", year_hint(gd.file_name("source_file")))
    return g.join(heads, "source_file").where(F.col("row_no") > F.col("header_row_no"))


# --- G1 ----------------------------------------------------------------------------

_LI_TS = ("CASE WHEN microsecond(l_shipdate) % 1000000 = 0 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') "
          "ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') END")


def _dbl(x):
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


@register("g1_cell_text", f"""
SELECT l_orderkey, l_linenumber, {_LI_TS} AS shipdate, {_dbl('l_quantity')} AS quantity,
  {_dbl('l_extendedprice')} AS price, {_dbl('l_discount')} AS discount, {_dbl('l_tax')} AS tax,
  COALESCE({iso('l_returnflag')}, l_returnflag) AS returnflag,
  CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'FALSE' END AS returned
FROM lineitem""")
def g1_cell_text(spark, sf):
    li = fr.table(spark, sf, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    types = {f.name: f.dataType for f in li.schema.fields}
    out = {"shipdate": "l_shipdate", "quantity": "l_quantity", "price": "l_extendedprice",
           "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "returned": "returned"}
    return li.select("l_orderkey", "l_linenumber",
                     *[gd.cell_text(F.col(src), types[src]).alias(name) for name, src in out.items()])


# --- G2, G7 (cell level) ----------------------------------------------------------------

@register("g2_is_numeric_text", with_ctes(G_FRAME, G_LONG, body=f"""
SELECT source_file, row_no, CAST(pos AS INTEGER) AS pos, {isnum('cell')} AS is_numeric FROM gl"""))
def g2_is_numeric_text(spark, sf):
    g = _grid(spark, sf).select("source_file", "row_no", F.posexplode("cells").alias("pos", "cell"))
    return g.select("source_file", "row_no", "pos", is_numeric_text("cell").alias("is_numeric"))


@register("g7_iso_date_text", with_ctes(G_FRAME, G_LONG, body=f"""
SELECT source_file, row_no, CAST(pos AS INTEGER) AS pos, COALESCE({iso('cell')}, cell) AS cell FROM gl"""))
def g7_iso_date_text(spark, sf):
    g = _grid(spark, sf).select("source_file", "row_no", F.posexplode("cells").alias("pos", "cell"))
    return g.select("source_file", "row_no", "pos", iso_date_text("cell").alias("cell"))


# --- G3, G4, G8, G9 -----------------------------------------------------------------

@register("g3_header_score", with_ctes(*G_CHAIN[:7], body="SELECT source_file, idx, score FROM gsc"))
def g3_header_score(spark, sf):
    return gd.score_head(_rendered(spark, sf)).select("source_file", F.col("idx").cast("long").alias("idx"), "score")


@register("g4_detect_header_row", with_ctes(*G_CHAIN[:8], body="""
SELECT source_file, header_idx, header_row_no, array_to_string(header, '|') AS header FROM gheads"""))
def g4_detect_header_row(spark, sf):
    h = gd.detect_header_row(_rendered(spark, sf))
    return h.select("source_file", F.col("header_idx").cast("long").alias("header_idx"), "header_row_no",
                    F.array_join("header", "|").alias("header"))


@register("g8_year_hint", with_ctes(G_FRAME, body=r"""
SELECT DISTINCT source_file, TRY_CAST(NULLIF(regexp_extract(source_file, '(\d{4})年', 1), '') AS INTEGER) AS year
FROM gf"""))
def g8_year_hint(spark, sf):
    return _grid(spark, sf).select("source_file", year_hint(gd.file_name("source_file")).alias("year")).distinct()


@register("g9_is_date_column", with_ctes(*G_CHAIN[:8], body="""
SELECT source_file, pos, name, COALESCE(regexp_matches(name, '(?i)date|日期|time|时间'), FALSE) AS is_date
FROM (SELECT source_file, CAST(generate_subscripts(header, 1) - 1 AS INTEGER) AS pos, unnest(header) AS name
      FROM gheads)"""))
def g9_is_date_column(spark, sf):
    h = gd.detect_header_row(_rendered(spark, sf)).select("source_file", F.posexplode("header").alias("pos", "name"))
    return h.select("source_file", "pos", "name", is_date_column("name").alias("is_date"))


# --- G5, G6, G10, G11, G12 ------------------------------------------------------------

@register("g5_drop_total_rows", with_ctes(*G_CHAIN[:9], body="SELECT source_file, row_no, is_total FROM gb0"))
def g5_drop_total_rows(spark, sf):
    return _body(spark, sf).select("source_file", "row_no", gd.is_total_row("cells").alias("is_total"))


@register("g6_rectangularize", with_ctes(*G_CHAIN[:10], body="""
SELECT source_file, row_no, array_to_string(cells, '|') AS cells, len(cells) AS width FROM gb2"""))
def g6_rectangularize(spark, sf):
    b = _body(spark, sf, stored=True).where(~gd.is_total_row("cells"))
    r = gd.rectangularize("cells", F.size("header"))
    return b.select("source_file", "row_no", F.array_join(r, "|").alias("cells"), F.size(r).cast("long").alias("width"))


@register("g11_drop_blank_rows", with_ctes(*G_CHAIN[:11], body="SELECT source_file, row_no, is_blank FROM gb3"))
def g11_drop_blank_rows(spark, sf):
    b = _body(spark, sf, stored=True).where(~gd.is_total_row("cells"))
    return b.select("source_file", "row_no", gd.is_blank_row(gd.rectangularize("cells", F.size("header"))).alias("is_blank"))


@register("g10_promote_yearless_dates", with_ctes(*G_CHAIN, body="""
SELECT source_file, row_no, cells[2] AS date_cell FROM gb4"""))
def g10_promote_yearless_dates(spark, sf):
    b = _body(spark, sf, stored=True).where(~gd.is_total_row("cells"))
    r = b.withColumn("cells", gd.rectangularize("cells", F.size("header"))).where(~gd.is_blank_row("cells"))
    p = gd.promote_yearless_dates("cells", "header", "yr")
    return r.select("source_file", "row_no", F.element_at(p, 2).alias("date_cell"))


@register("g12_clean_sheets", with_ctes(*G_CHAIN, body="""
SELECT source_file, row_no, array_to_string(cells, '|') AS cells FROM gb4"""))
def g12_clean_sheets(spark, sf):
    rows, _ = gd.clean_sheets(_grid(spark, sf))
    return rows.select("source_file", "row_no", F.array_join("cells", "|").alias("cells"))


# --- U2, U3 ------------------------------------------------------------------------------

_U2_FIELDS = sorted(mp.CANON_META)


@register("u2_unify_grid", with_ctes(*SHEETS, SYN, ("rp", """
SELECT c.source_id, c.pos, s.canonical AS field FROM sheet_catalog c JOIN syn s ON s.norm = """
    + "trim(regexp_replace(lower(c.name), '[^0-9a-z一-鿿]+', '_', 'g'), '_')"), ("pick", """
SELECT source_id, field, min(pos) AS pos FROM rp GROUP BY source_id, field"""), ("cells", """
SELECT v.source_id, v.row_no, p.field, v.value FROM sheet_cells v JOIN pick p USING (source_id, pos)"""), body=", ".join(
    [f"SELECT max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in _U2_FIELDS]).replace(", SELECT", ",")
    + ", source_id AS source_file FROM cells GROUP BY source_id, row_no"))
def u2_unify_grid(spark, sf):
    """Every customer sheet (each with its own header spellings) onto the
    canonical fields in one pass, using the confirmed mapping memory."""
    c = sheet_catalog(spark, sf)
    flat = mp.flat_mapping(sheet_sources(spark, sf, c), sheet_memory(spark, sf, c))
    headers = fr.sheet_headers(spark, sf).select("source_file", "header")
    return unify_grid(fr.sheet_grid(spark, sf), headers, flat, _U2_FIELDS)


@register("u2_entry_order", """
WITH kept AS (SELECT max(c_custkey) AS k FROM customer)
SELECT CASE WHEN (SELECT k FROM kept) % 2 = 0 THEN CAST(o.o_totalprice AS VARCHAR) ELSE CAST(o.o_orderkey AS VARCHAR) END AS revenue,
       'two_' || CAST(c.c_custkey AS VARCHAR) || '.csv' AS source_file
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def u2_entry_order(spark, sf):
    """Two columns of every sheet map to one field, in turn in either order: both
    headers have one fingerprint, whose mapping is the last sheet's, so in all sheets
    the column that the last sheet names first is read."""
    c = fr.table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.lit("two_"), k.cast("string"), F.lit(".csv"))
    header = F.when(k % 2 == 0, F.array(F.lit("Revenue"), F.lit("Amount"))).otherwise(F.array(F.lit("Amount"), F.lit("Revenue")))
    headers = c.select(name.alias("source_file"), header.alias("header"), k.alias("source_order"))
    catalog = headers.select(F.col("source_file").alias("source_id"), "source_order", F.posexplode("header").alias("pos", "name")).withColumn("type", F.lit("VARCHAR"))
    sources = cat.fingerprints(catalog).join(headers.select(F.col("source_file").alias("source_id"), "source_order"), "source_id")
    memory = mp.confirm_mapping(mp.propose_by_synonyms(catalog), catalog, sources)
    price, key = F.col("o_totalprice").cast("string"), F.col("o_orderkey").cast("string")
    joined = fr.table(spark, sf, "orders").join(c, F.col("o_custkey") == k)
    cells = F.when(k % 2 == 0, F.array(price, key)).otherwise(F.array(key, price))
    grid = joined.select(name.alias("source_file"), F.col("o_orderkey").alias("row_no"), cells.alias("cells"))
    return unify_grid(grid, headers, mp.flat_mapping(sources, memory, check=False), ["revenue"])


_CUST_STEPS = [
    {"op": "map_column", "from": "Cust Name", "to": "customer_name"},
    {"op": "map_column", "from": "Date Purchased", "to": "order_date"},
    {"op": "map_column", "from": "Amount USD", "to": "revenue"},
    {"op": "map_column", "from": "Country", "to": "country"},
    {"op": "parse_date", "column": "order_date", "to": "order_date", "format": "auto"},
    {"op": "cast", "column": "revenue", "type": "DECIMAL"},
]
_SUPP_STEPS = [
    {"op": "map_column", "from": "客户名称", "to": "customer_name"},
    {"op": "map_column", "from": "订单日期", "to": "order_date"},
    {"op": "map_column", "from": "金额", "to": "revenue"},
    {"op": "map_column", "from": "国家", "to": "country"},
    {"op": "parse_date", "column": "order_date", "to": "order_date", "format": "auto"},
    {"op": "cast", "column": "revenue", "type": "DECIMAL"},
]


@register("u3_replay_union", with_ctes(CUST, SUPP, body="""
SELECT "Cust Name" AS customer_name, TRY_CAST("Date Purchased" AS DATE) AS order_date,
       TRY_CAST("Amount USD" AS DECIMAL(18,3)) AS revenue, "Country" AS country, "Phone", "Segment",
       CAST(NULL AS VARCHAR) AS "电话", source_file FROM cust
UNION ALL
SELECT "客户名称", TRY_CAST("订单日期" AS DATE), TRY_CAST("金额" AS DECIMAL(18,3)), "国家", NULL, NULL, "电话", source_file
FROM supp"""))
def u3_replay_union(spark, sf):
    a = ops.apply_steps(fr.customer_export(spark, sf), _CUST_STEPS, scope="source_file")
    b = ops.apply_steps(fr.supplier_export(spark, sf), _SUPP_STEPS, scope="source_file")
    return replay_union([a, b])
