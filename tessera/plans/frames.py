"""Frames: the driver's tables seen as messy exports, catalogs and sheets.

The reference works on spreadsheets; the test data is a star schema. These
builders re-frame whole tables (no row subsets) as the inputs the operators
expect, with dirty cells chosen by key so every trap is exercised:

* ``sales_sources`` — ``customer`` and ``supplier`` as two files with English
  and Chinese headers, ``orders`` as five monthly-style exports (one per
  priority, one shape). All cells are text.
* ``sheet_grid`` / ``sheet_headers`` — one sheet per customer whose rows are
  the customer's orders and whose header spellings vary by key (EN/ZH,
  synonyms and non-synonyms): a catalog with many shapes.
* ``event_cells`` / ``priority_cells`` — data-scale catalogs: a source is a
  (user, day) of ``events`` whose columns are its event types; or an
  ``o_custkey`` whose columns are its order priorities.
* ``titled_grid`` — raw sheet grids (title row, header, data, subtotal and
  blank rows, text dates in several shapes) for the cleaning operators.

Every builder has an exact SQL twin in ``tessera.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, as its files give it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _pick(idx: Column, values: list[str]) -> Column:
    """``values[idx]`` (0-based) as a CASE chain (same text as the SQL twin)."""
    out = None
    for i, v in enumerate(values):
        out = F.when(idx == i, F.lit(v)) if out is None else out.when(idx == i, F.lit(v))
    return out


def _day(base: str, offset: Column) -> Column:
    return F.date_add(F.lit(base).cast("date"), offset.cast("int"))


# --- sales exports ---------------------------------------------------------------

CUSTOMER_FILE = "customers.csv"
SUPPLIER_FILE = "供应商2023年.csv"

# Mapping confirmed for the sales exports, in entry order.
SALES_MAPPING = [
    ("Cust Name", "customer_name"), ("Date Purchased", "order_date"), ("Amount USD", "revenue"),
    ("Country", "country"), ("Phone", "phone"),
    ("客户名称", "customer_name"), ("订单日期", "order_date"), ("金额", "revenue"),
    ("国家", "country"), ("电话", "phone"),
    ("Customer", "customer_name"), ("Order Date", "order_date"), ("Revenue USD", "revenue"),
]


def customer_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    d = _day("2023-01-01", k % 365)
    iso = F.date_format(d, "yyyy-MM-dd")
    date_text = (
        F.when(k % 6 == 0, iso)
        .when(k % 6 == 1, F.date_format(d, "yyyy/M/d"))
        .when(k % 6 == 2, F.concat(iso, F.lit(" 10:30:00")))
        .when(k % 6 == 3, F.lit("n/a"))
        .when(k % 6 == 4, F.lit(None).cast("string"))
        .otherwise(F.date_format(d, "yyyy年M月d日"))
    )
    acct = _s("c_acctbal")
    amount = (
        F.when(k % 8 == 0, F.concat(F.lit(" "), acct, F.lit(" ")))
        .when(k % 8 == 1, F.lit("1e3"))
        .when(k % 8 == 2, F.lit("n/a"))
        .when(k % 8 == 3, F.lit("1_000"))
        .otherwise(acct)
    )
    phone = F.concat(F.lit("+1 ("), F.lpad(_s(k % 1000), 3, "0"), F.lit(") 555-"), F.lpad(_s(k % 10000), 4, "0"))
    return c.select(
        F.col("c_name").alias("Cust Name"), date_text.alias("Date Purchased"), amount.alias("Amount USD"),
        _s("c_nationkey").alias("Country"), phone.alias("Phone"), F.col("c_mktsegment").alias("Segment"),
        F.lit(CUSTOMER_FILE).alias("source_file"),
    )


def supplier_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.col("s_name").alias("客户名称"),
        F.date_format(_day("2023-01-01", k % 300), "yyyy-MM-dd").alias("订单日期"),
        _s("s_acctbal").alias("金额"),
        _s("s_nationkey").alias("国家"),
        F.concat(F.lit("021-"), F.lpad(_s(k % 10000), 4, "0"), F.lit("-3000")).alias("电话"),
        F.lit(SUPPLIER_FILE).alias("source_file"),
    )


def order_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("Customer#"), F.lpad(_s("o_custkey"), 9, "0")).alias("Customer"),
        _s("o_orderdate").alias("Order Date"),
        _s("o_totalprice").alias("Revenue USD"),
        F.col("o_orderstatus").alias("Status"),
        F.concat(F.lit("orders_"), F.col("o_orderpriority"), F.lit(".csv")).alias("source_file"),
    )


def sales_sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [
        (CUSTOMER_FILE, customer_export(spark, sf_dir)),
        (SUPPLIER_FILE, supplier_export(spark, sf_dir)),
        ("orders", order_exports(spark, sf_dir)),
    ]


# --- per-customer sheets ----------------------------------------------------------

# Header spellings per concept (customer, date, amount, email, phone, country).
SHEET_SPELLINGS = [
    ["Cust Name", "客户名称", "Customer", "client", "Buyer Name", "客户"],
    ["Date Purchased", "订单日期", "Order Date", "date", "Purchase Day", "下单日期"],
    ["Amount USD", "金额", "Revenue USD", "Sales", "Total Amount", "收入"],
    ["Email", "邮箱", "E-Mail", "mail address", "Contact", "电子邮件"],
    ["Phone", "电话", "Tel", "Mobile No", "phone number", "手机"],
    ["Country", "国家", "Region", "Nation/Area", "market", "地区"],
]
SHEET_EXTRA = "Discount"
SHEET_EXTRA_SEGMENT = "BUILDING"


def sheet_file(k: Column) -> Column:
    return F.concat(F.lit("sheet_"), _s(k), F.lit(".csv"))


def _spelling_idx(k: Column, i: int) -> Column:
    return ((k % 7) + (k % 5) * i) % 6


def sheet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source_file, header array<string>, source_order)`` for every customer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    names = [_pick(_spelling_idx(k, i), sp) for i, sp in enumerate(SHEET_SPELLINGS)]
    extra = F.when(F.col("c_mktsegment") == SHEET_EXTRA_SEGMENT, F.array(F.lit(SHEET_EXTRA))).otherwise(
        F.array().cast("array<string>"))
    return c.select(sheet_file(k).alias("source_file"), F.concat(F.array(*names), extra).alias("header"),
                    k.alias("source_order"))


def sheet_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source_file, row_no, cells)``: the data rows of every customer sheet."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("c_custkey")
    email = F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com"))
    phone = F.concat(F.lit("+1 ("), F.lpad(_s(k % 1000), 3, "0"), F.lit(") 555-"),
                     F.lpad(_s(F.col("o_orderkey") % 10000), 4, "0"))
    base = F.array(F.col("c_name"), _s(F.col("o_orderdate").cast("date")), _s("o_totalprice"), email, phone,
                   _s("c_nationkey"))
    cells = F.when(F.col("c_mktsegment") == SHEET_EXTRA_SEGMENT, F.concat(base, F.array(F.col("o_orderstatus")))
                   ).otherwise(base)
    return j.select(sheet_file(k).alias("source_file"), F.col("o_orderkey").alias("row_no"), cells.alias("cells"))


# --- long catalogs ---------------------------------------------------------------

def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sid = F.concat(F.lit("u"), _s("user_id"), F.lit("_"), _s(F.col("ts").cast("date")))
    return e.select(sid.alias("source_id"), F.col("event_id").alias("row_no"), F.col("event_type").alias("name"),
                    _s("value").alias("value"))


def priority_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("c"), _s("o_custkey")).alias("source_id"), F.col("o_orderkey").alias("row_no"),
                    F.col("o_orderpriority").alias("name"), _s("o_totalprice").alias("value"))


# Required source columns of the two catalog skills.
EVENT_REQUIRED = ["click", "purchase", "view"]
PRIORITY_REQUIRED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


# --- raw freight sheets (grid cleaning) ------------------------------------------

FREIGHT_HEADER = ["Order No", "日期", "Amount", "Status", "Priority"]
FREIGHT_AMOUNT_ALT = "运费合计"
FREIGHT_TITLE = "Freight report "


def freight_file(k: Column) -> Column:
    return F.concat(F.lit("freight_"), _s(k), F.when(k % 2 == 0, F.lit("_2023年")).otherwise(F.lit("")), F.lit(".csv"))


def freight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sheet grids, one per customer: optional title row, header row, one
    row per order (dates as text in four shapes, some rows short or long),
    subtotal rows and blank rows in between. ``row_no`` orders rows in a file."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    title = c.where(k % 4 != 3).select(
        freight_file(k).alias("source_file"), F.lit(0).cast("long").alias("row_no"),
        F.array(F.concat(F.lit(FREIGHT_TITLE), F.col("c_name"))).alias("cells"))
    hdr = [F.lit(h) for h in FREIGHT_HEADER]
    hdr[2] = F.when(k % 3 == 0, F.lit(FREIGHT_AMOUNT_ALT)).otherwise(F.lit(FREIGHT_HEADER[2]))
    header = c.select(freight_file(k).alias("source_file"), F.lit(1).cast("long").alias("row_no"),
                      F.array(*hdr).alias("cells"))
    j = o.join(c, o.o_custkey == c.c_custkey)
    ok = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    date_text = (
        F.when(ok % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(ok % 4 == 1, F.date_format(d, "yyyy/M/d"))
        .when(ok % 4 == 2, F.date_format(d, "yyyy年M月d日"))
        .otherwise(F.date_format(d, "M.d"))
    )
    price = _s("o_totalprice")
    full = [_s(ok), date_text, price, F.col("o_orderstatus"), F.col("o_orderpriority")]
    cells = (
        F.when(ok % 11 == 0, F.array(*full[:3]))
        .when(ok % 13 == 0, F.array(*full, F.lit("x"), F.lit("y")))
        .otherwise(F.array(*full))
    )
    base = 10 + 3 * ok
    row = lambda off, cl: F.struct((base + off).alias("row_no"), cl.alias("cells"))
    sub = F.when(ok % 10 == 5, F.array(F.lit("Total"), F.lit(""), F.lit(""), F.lit(""), price)).otherwise(
        F.array(F.lit("小计"), price))
    rows = F.array(
        row(0, cells),
        F.when(ok % 5 == 0, row(1, sub)),
        F.when(ok % 7 == 0, row(2, F.array_repeat(F.lit(""), 5))),
    )
    # one pass over the order/customer join; each order yields 1-3 grid rows
    data = j.select(freight_file(k).alias("source_file"),
                    F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(
        "source_file", "r.row_no", "r.cells")
    return title.unionByName(header).unionByName(data)
