"""Registered queries: one per inventory ID, ``(spark, sf_dir) -> DataFrame``,
each with its DuckDB twin in ``ORACLE`` (absent only where SQL cannot say it).

Columns are aliased identically on both sides; arrays are rendered as
``|``-joined text so both engines hash the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.guard import FORBIDDEN_WORDS, HEADS, REASON_HEAD, REASON_MULTI, REASON_WRITE, guard_accepts, guard_reason
from tessera.functions.text import normalize_name, source_prefix
from tessera.operators import ops, query, unify
from tessera.operators.drift import snapshot
from tessera.plans import frames as fr
from tessera.plans.oracle import ORD, SALES, with_ctes, CUST

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def unified(spark: SparkSession, sf: str) -> DataFrame:
    return unify.unify(fr.sales_sources(spark, sf), fr.SALES_MAPPING)


MONTHS = query.month_labels("月_revenue")


# --- U1, U4 ----------------------------------------------------------------------

@register("u1_unify", with_ctes(*SALES, body="SELECT * FROM t"))
def u1_unify(spark, sf):
    return unified(spark, sf)


@register("u4_by_source", with_ctes(*SALES, body="""
SELECT source_file, count(*) AS n_rows, count(revenue) AS n_revenue FROM t GROUP BY source_file"""))
def u4_by_source(spark, sf):
    return unify.by_source(unified(spark, sf), F.count(F.lit(1)).alias("n_rows"), F.count("revenue").alias("n_revenue"))


# --- Q1-Q8 -----------------------------------------------------------------------

Q2_SQL = "SELECT country, count(*) AS n_rows, count(order_date) AS n_dated FROM t GROUP BY country;"
Q8_SQL = ("WITH base AS (SELECT country, revenue FROM (SELECT * FROM t WHERE customer_name IS NOT NULL)) "
          "FROM base SELECT country, count(*) AS n, count(revenue) AS n_revenue GROUP BY country")


@register("q2_run_query", with_ctes(*SALES, body=Q2_SQL.rstrip(";")))
def q2_run_query(spark, sf):
    return query.run_query(spark, unified(spark, sf), Q2_SQL)


Q2_ROWS_SQL = "SELECT customer_name, revenue, source_file FROM t WHERE revenue IS NOT NULL"


@register("q2_run_query_rows", with_ctes(*SALES, body=Q2_ROWS_SQL))
def q2_run_query_rows(spark, sf):
    """More rows than a screen shows: no cap unless one is given."""
    return query.run_query(spark, unified(spark, sf), Q2_ROWS_SQL)


@register("q8_cte_query", with_ctes(*SALES, body=f"SELECT * FROM ({Q8_SQL})"))
def q8_cte_query(spark, sf):
    return query.run_query(spark, unified(spark, sf), Q8_SQL)


Q8_PIVOT = ("PIVOT t ON country USING round(sum(try_cast(replace(revenue, '_', '') AS DOUBLE)), 2) AS total, count(*) AS n GROUP BY source_file")
Q8_UNPIVOT = "UNPIVOT t ON customer_name, order_date, revenue INTO NAME field VALUE cell"


@register("q8_pivot_statement", with_ctes(*SALES, body=Q8_PIVOT))
def q8_pivot_statement(spark, sf):
    return query.run_query(spark, unified(spark, sf), Q8_PIVOT)


@register("q8_unpivot_statement", with_ctes(*SALES, body=Q8_UNPIVOT))
def q8_unpivot_statement(spark, sf):
    return query.run_query(spark, unified(spark, sf), Q8_UNPIVOT)


@register("q3_total_by", with_ctes(*SALES, body="""
SELECT customer_name, ROUND(SUM(TRY_CAST(revenue AS DOUBLE)), 2) AS total
FROM t GROUP BY customer_name ORDER BY total DESC NULLS LAST, customer_name ASC NULLS LAST LIMIT 20"""))
def q3_total_by(spark, sf):
    return query.total_by(unified(spark, sf), "customer_name", "revenue", 20)


@register("q4_monthly_totals", with_ctes(*SALES, body="""
SELECT strftime(TRY_CAST(order_date AS DATE), '%Y-%m') AS month, ROUND(SUM(TRY_CAST(revenue AS DOUBLE)), 2) AS total
FROM t WHERE TRY_CAST(order_date AS DATE) IS NOT NULL GROUP BY 1 ORDER BY 1"""))
def q4_monthly_totals(spark, sf):
    return query.monthly_totals(unified(spark, sf), "order_date", "revenue")


_PIVOT_BASE = ("base", """
SELECT REGEXP_EXTRACT(source_file, '^[^0-9.]+', 0) AS data_source, customer_name,
       month(TRY_CAST(order_date AS DATE)) AS m, TRY_CAST(revenue AS DOUBLE) AS amt
FROM t WHERE TRY_CAST(order_date AS DATE) IS NOT NULL""")
_PIVOT = ("pv", "SELECT data_source, customer_name, " + ", ".join(
    f'COALESCE(ROUND(SUM(amt) FILTER (WHERE m = {m}), 2), 0) AS "{lbl}"' for m, lbl in enumerate(MONTHS, 1)
) + " FROM base GROUP BY data_source, customer_name")


@register("q5_pivot_wide", with_ctes(*SALES, _PIVOT_BASE, _PIVOT, body="SELECT * FROM pv"))
def q5_pivot_wide(spark, sf):
    return query.pivot_wide(unified(spark, sf), ["customer_name"], "order_date", "revenue", "月_revenue")


@register("q7_unpivot_long", with_ctes(*SALES, _PIVOT_BASE, _PIVOT, body=" UNION ALL ".join(
    f"SELECT data_source, customer_name, '{lbl}' AS label, \"{lbl}\" AS value FROM pv" for lbl in MONTHS)))
def q7_unpivot_long(spark, sf):
    wide = query.pivot_wide(unified(spark, sf), ["customer_name"], "order_date", "revenue", "月_revenue")
    return query.unpivot_long(wide, ["data_source", "customer_name"], MONTHS, "label", "value")


@register("q6_source_prefix", """
SELECT page_id, REGEXP_EXTRACT(url, '^[^0-9.]+', 0) AS prefix FROM pages""")
def q6_source_prefix(spark, sf):
    return fr.table(spark, sf, "pages").select("page_id", source_prefix("url").alias("prefix"))


# Q1 over a table of SQL texts built from order keys.
_K = "o_orderkey"
GUARD_TEXTS = [
    ("select * from t where id = ", True),
    ("drop table t", True),
    ("select {k}; select 2", False),
    ("WITH a AS (select {k}) select * from a;", False),
    ("FROM t", None),
    ("values ({k})", False),
    ("select * from t where x = 'drop it'", None),
    ("  PIVOT t ON x USING sum(y);;  ", None),
    ("select \"set\" from t", None),
    ("", None),
]


def _guard_text_spark(k):
    out = None
    for i, (tpl, suffix) in enumerate(GUARD_TEXTS):
        if "{k}" in tpl:
            a, b = tpl.split("{k}")
            v = F.concat(F.lit(a), k.cast("string"), F.lit(b))
        elif suffix:
            v = F.concat(F.lit(tpl), k.cast("string"))
        else:
            v = F.lit(tpl)
        cond = (k % len(GUARD_TEXTS)) == i
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def _guard_text_sql():
    arms = []
    for i, (tpl, suffix) in enumerate(GUARD_TEXTS):
        lit = "'" + tpl.replace("'", "''") + "'"
        if "{k}" in tpl:
            a, b = tpl.split("{k}")
            v = f"'{a.replace(chr(39), chr(39) * 2)}' || CAST({_K} AS VARCHAR) || '{b.replace(chr(39), chr(39) * 2)}'"
        elif suffix:
            v = f"{lit} || CAST({_K} AS VARCHAR)"
        else:
            v = lit
        arms.append(f"WHEN {i} THEN {v}")
    return f"CASE {_K} % {len(GUARD_TEXTS)} " + " ".join(arms) + " END"


_HEADS_SQL = "(?i)^(" + "|".join(HEADS) + ")\\b"
_WRITE_SQL = "(?i)\\b(" + "|".join(FORBIDDEN_WORDS) + ")\\b"
_GUARD_S = ("regexp_replace(regexp_replace(regexp_replace(sql, '^\\s+|\\s+$', '', 'g'), ';+$', ''), "
            "'^\\s+|\\s+$', '', 'g')")


@register("q1_guard_select", f"""
WITH texts AS (SELECT {_K}, {_guard_text_sql()} AS sql FROM orders),
norm AS (SELECT {_K}, sql, {_GUARD_S} AS s FROM texts)
SELECT {_K}, sql,
  CASE WHEN strpos(s, ';') > 0 THEN '{REASON_MULTI}'
       WHEN NOT regexp_matches(s, '{_HEADS_SQL}') THEN '{REASON_HEAD}'
       WHEN regexp_matches(s, '{_WRITE_SQL}') THEN '{REASON_WRITE}' END AS reason,
  NOT (strpos(s, ';') > 0 OR NOT regexp_matches(s, '{_HEADS_SQL}') OR regexp_matches(s, '{_WRITE_SQL}')) AS accepted
FROM norm""")
def q1_guard_select(spark, sf):
    o = fr.table(spark, sf, "orders")
    texts = o.select(_K, _guard_text_spark(F.col(_K)).alias("sql"))
    return texts.select(_K, "sql", guard_reason("sql").alias("reason"), guard_accepts("sql").alias("accepted"))


# --- S4, S5 -----------------------------------------------------------------------

_UNIFIED_COLS = ["country", "customer_name", "order_date", "phone", "revenue", "source_file"]


@register("s4_preview", with_ctes(*SALES, body="SELECT * FROM t ORDER BY " + ", ".join(
    f"{c} ASC NULLS FIRST" for c in ["source_file", "customer_name", "order_date", "revenue", "country", "phone"]
) + " LIMIT 50"))
def s4_preview(spark, sf):
    return query.preview(unified(spark, sf), 50,
                         ["source_file", "customer_name", "order_date", "revenue", "country", "phone"])


SNAPSHOT_STEPS = [
    {"op": "map_column", "from": "Customer", "to": "customer_name"},
    {"op": "map_column", "from": "Order Date", "to": "order_date"},
    {"op": "map_column", "from": "Revenue USD", "to": "revenue"},
    {"op": "parse_date", "column": "order_date", "to": "order_date", "format": "auto"},
    {"op": "cast", "column": "revenue", "type": "DECIMAL"},
]


@register("s5_snapshot", with_ctes(*SALES, body="""
SELECT CAST(customer_name AS VARCHAR) AS customer_name, CAST(revenue AS VARCHAR) AS revenue,
       CAST(order_date AS VARCHAR) AS order_date, CAST("Status" AS VARCHAR) AS "Status",
       CAST(source_file AS VARCHAR) AS source_file
FROM (SELECT * FROM (SELECT "Customer" AS customer_name, TRY_CAST("Revenue USD" AS DECIMAL(18,3)) AS revenue,
                            TRY_CAST("Order Date" AS DATE) AS order_date, "Status", source_file FROM ord)
      ORDER BY revenue DESC NULLS LAST, customer_name, source_file LIMIT 20)"""))
def s5_snapshot(spark, sf):
    return snapshot(SNAPSHOT_STEPS, [("orders", fr.order_exports(spark, sf))], 20,
                    [F.col("revenue").desc_nulls_last(), F.col("customer_name"), F.col("source_file")])


# --- O1-O9 -------------------------------------------------------------------------

def _cust(spark, sf):
    return fr.customer_export(spark, sf)


_CUST_REST = '"Date Purchased", "Country", "Phone", "Segment", source_file'


@register("o1_map_column", with_ctes(CUST, body="""
SELECT "Cust Name" AS customer_name, "Amount USD" AS revenue, "Date Purchased", "Country", "Phone", "Segment", source_file
FROM cust"""))
def o1_map_column(spark, sf):
    return ops.apply_steps(_cust(spark, sf), [
        {"op": "map_column", "from": "Cust Name", "to": "customer_name"},
        {"op": "map_column", "from": "Amount USD", "to": "revenue"},
    ])


def _cast_query(type_name: str, sql_type: str):
    @register(f"o2_cast_{type_name.lower()}", with_ctes(CUST, body=f"""
SELECT "Cust Name" AS customer_name, TRY_CAST("Amount USD" AS {sql_type}) AS revenue, source_file FROM cust"""))
    def _q(spark, sf):
        df = ops.apply_steps(_cust(spark, sf), [
            {"op": "map_column", "from": "Cust Name", "to": "customer_name"},
            {"op": "map_column", "from": "Amount USD", "to": "revenue"},
            {"op": "cast", "column": "revenue", "type": type_name},
        ])
        return df.select("customer_name", "revenue", "source_file")
    return _q


for _t, _sqlt in [("DECIMAL", "DECIMAL"), ("DOUBLE", "DOUBLE"), ("INTEGER", "INTEGER"), ("BIGINT", "BIGINT"),
                  ("VARCHAR", "VARCHAR")]:
    _cast_query(_t, _sqlt)


@register("o2_cast_date", with_ctes(CUST, body="""
SELECT "Cust Name" AS customer_name, TRY_CAST("Date Purchased" AS DATE) AS order_date, source_file FROM cust"""))
def o2_cast_date(spark, sf):
    df = ops.apply_steps(_cust(spark, sf), [
        {"op": "map_column", "from": "Cust Name", "to": "customer_name"},
        {"op": "map_column", "from": "Date Purchased", "to": "order_date"},
        {"op": "cast", "column": "order_date", "type": "DATE"},
    ])
    return df.select("customer_name", "order_date", "source_file")


@register("o3_parse_date_auto", with_ctes(CUST, body="""
SELECT "Cust Name" AS customer_name, TRY_CAST("Date Purchased" AS DATE) AS order_date FROM cust"""))
def o3_parse_date_auto(spark, sf):
    df = ops.apply_steps(_cust(spark, sf), [
        {"op": "map_column", "from": "Cust Name", "to": "customer_name"},
        {"op": "map_column", "from": "Date Purchased", "to": "order_date"},
        {"op": "parse_date", "column": "order_date", "to": "order_date", "format": "auto"},
    ])
    return df.select("customer_name", "order_date")


@register("o4_parse_date_format", with_ctes(CUST, body="""
SELECT "Cust Name" AS customer_name, CAST(try_strptime("Date Purchased", '%Y/%m/%d') AS DATE) AS order_date
FROM cust"""))
def o4_parse_date_format(spark, sf):
    df = ops.apply_steps(_cust(spark, sf), [
        {"op": "map_column", "from": "Cust Name", "to": "customer_name"},
        {"op": "map_column", "from": "Date Purchased", "to": "order_date"},
        {"op": "parse_date", "column": "order_date", "to": "order_date", "format": "%Y/%m/%d"},
    ])
    return df.select("customer_name", "order_date")


@register("o5_normalize_phone", """
SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS text FROM documents""")
def o5_normalize_phone(spark, sf):
    docs = fr.table(spark, sf, "documents").select("doc_id", "text")
    return ops.apply_steps(docs, [{"op": "normalize_phone", "column": "text"}])


@register("o5_normalize_phone_sales", with_ctes(CUST, body="""
SELECT "Cust Name" AS customer_name, regexp_replace("Phone", '[^0-9]', '', 'g') AS phone FROM cust"""))
def o5_normalize_phone_sales(spark, sf):
    df = ops.apply_steps(_cust(spark, sf), [
        {"op": "map_column", "from": "Cust Name", "to": "customer_name"},
        {"op": "map_column", "from": "Phone", "to": "phone"},
        {"op": "normalize_phone", "column": "phone", "region": "US"},
    ])
    return df.select("customer_name", "phone")


@register("o6_derive", with_ctes(CUST, body="""
SELECT "Cust Name" AS customer_name, "Country" AS country, "Date Purchased", "Amount USD", "Phone", "Segment",
       source_file, upper("Cust Name") || '-' || "Country" AS label
FROM cust"""))
def o6_derive(spark, sf):
    return ops.apply_steps(_cust(spark, sf), [
        {"op": "map_column", "from": "Cust Name", "to": "customer_name"},
        {"op": "map_column", "from": "Country", "to": "country"},
        {"op": "derive", "expr": "upper(customer_name) || '-' || country", "to": "label"},
    ])


@register("o7_filter", with_ctes(CUST, body="""
SELECT * FROM (SELECT "Cust Name" AS customer_name, TRY_CAST("Amount USD" AS DECIMAL(18,3)) AS revenue, source_file
               FROM cust) WHERE revenue > 1000"""))
def o7_filter(spark, sf):
    df = ops.apply_steps(_cust(spark, sf), [
        {"op": "filter", "predicate": "revenue > 1000"},
        {"op": "map_column", "from": "Cust Name", "to": "customer_name"},
        {"op": "map_column", "from": "Amount USD", "to": "revenue"},
        {"op": "cast", "column": "revenue", "type": "DECIMAL"},
    ])
    return df.select("customer_name", "revenue", "source_file")


@register("o8_dedupe", with_ctes(CUST, body="""
SELECT country, "Cust Name", "Date Purchased", "Amount USD", "Phone", "Segment", source_file FROM (
  SELECT *, row_number() OVER (PARTITION BY country, "Segment" ORDER BY "Cust Name" NULLS FIRST,
         "Date Purchased" NULLS FIRST, "Amount USD" NULLS FIRST, "Phone" NULLS FIRST, source_file NULLS FIRST) AS rn
  FROM (SELECT "Country" AS country, * EXCLUDE ("Country") FROM cust)) WHERE rn = 1"""))
def o8_dedupe(spark, sf):
    return ops.apply_steps(_cust(spark, sf), [
        {"op": "map_column", "from": "Country", "to": "country"},
        {"op": "dedupe", "keys": ["country", "Segment"]},
    ])


O9_STEPS = [
    {"op": "filter", "predicate": "revenue > 100000"},
    {"op": "map_column", "from": "Customer", "to": "customer_name"},
    {"op": "cast", "column": "revenue", "type": "DECIMAL"},
    {"op": "map_column", "from": "Revenue USD", "to": "revenue"},
    {"op": "parse_date", "column": "order_date", "to": "order_date", "format": "auto"},
    {"op": "map_column", "from": "Order Date", "to": "order_date"},
    {"op": "dedupe", "keys": ["customer_name"]},
    {"op": "derive", "expr": "CAST(year(order_date) AS BIGINT)", "to": "order_year"},
]


@register("o9_apply_steps", with_ctes(ORD, body="""
SELECT customer_name, revenue, order_date, "Status", source_file, order_year FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_name, source_file ORDER BY revenue NULLS FIRST,
         order_date NULLS FIRST, "Status" NULLS FIRST, order_year NULLS FIRST) AS rn
  FROM (SELECT *, CAST(year(order_date) AS BIGINT) AS order_year FROM (
          SELECT "Customer" AS customer_name, TRY_CAST("Revenue USD" AS DECIMAL(18,3)) AS revenue,
                 TRY_CAST("Order Date" AS DATE) AS order_date, "Status", source_file FROM ord))
  WHERE revenue > 100000) WHERE rn = 1"""))
def o9_apply_steps(spark, sf):
    return ops.apply_steps(fr.order_exports(spark, sf), O9_STEPS, scope="source_file")


# --- functions promised to query authors ------------------------------------------

@register("fn_date_functions", """
SELECT o_orderkey,
  strftime(o_orderdate, '%Y-%m') AS ym,
  CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m_start,
  CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS y_start,
  CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d_start,
  CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS w_start,
  CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q_start,
  CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
  CAST(day(o_orderdate) AS BIGINT) AS d, CAST(date_part('year', o_orderdate) AS BIGINT) AS y2,
  CONCAT(month(o_orderdate), '月') AS month_label,
  CAST(try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS TIMESTAMP) AS parsed
FROM orders""")
def fn_date_functions(spark, sf):
    from tessera.functions.datefmt import strftime, try_strptime

    o = fr.table(spark, sf, "orders")
    d = F.col("o_orderdate")
    trunc = {k: F.date_trunc(k, d).cast("timestamp_ntz") for k in ("month", "year", "day", "week", "quarter")}
    return o.select(
        "o_orderkey", strftime(d, "%Y-%m").alias("ym"),
        trunc["month"].alias("m_start"), trunc["year"].alias("y_start"), trunc["day"].alias("d_start"),
        trunc["week"].alias("w_start"), trunc["quarter"].alias("q_start"),
        F.year(d).cast("bigint").alias("y"), F.month(d).cast("bigint").alias("m"),
        F.dayofmonth(d).cast("bigint").alias("d"), F.date_part(F.lit("year"), d).cast("bigint").alias("y2"),
        F.concat(F.month(d).cast("string"), F.lit("月")).alias("month_label"),
        try_strptime(strftime(d, "%Y-%m-%d"), "%Y-%m-%d").cast("timestamp_ntz").alias("parsed"),
    )


@register("fn_try_cast_timestamp", """
SELECT o_orderkey, TRY_CAST(txt AS TIMESTAMP) AS ts FROM (
  SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:00'
    WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
    WHEN 2 THEN 'n/a' END AS txt FROM orders)""")
def fn_try_cast_timestamp(spark, sf):
    from tessera.functions.casts import safe_cast

    o = fr.table(spark, sf, "orders")
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    txt = (F.when(k == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:30:00")))
           .when(k == 1, F.date_format(d, "yyyy/MM/dd")).when(k == 2, F.lit("n/a")))
    return o.select("o_orderkey", safe_cast(txt, "TIMESTAMP").alias("ts"))


_DATE_LITERAL_SQL = ("SELECT o_orderkey, DATE '1995-06-01' AS since FROM t "
                     "WHERE CAST(o_orderdate AS DATE) >= DATE '1995-06-01'")


@register("fn_date_literal", f"WITH t AS (SELECT * FROM orders) {_DATE_LITERAL_SQL}")
def fn_date_literal(spark, sf):
    return query.run_query(spark, fr.table(spark, sf, "orders"), _DATE_LITERAL_SQL)


@register("fn_text_functions", with_ctes(CUST, body="""
SELECT "Cust Name" AS customer_name,
  CONCAT("Cust Name", '/', "Date Purchased") AS concat_skip_null,
  "Cust Name" || '/' || "Date Purchased" AS concat_op,
  REGEXP_EXTRACT("Phone", '[0-9]+', 0) AS first_digits,
  COALESCE(ROUND(TRY_CAST("Amount USD" AS DOUBLE), 2), 0) AS amount
FROM cust"""))
def fn_text_functions(spark, sf):
    from tessera.functions.casts import try_double

    c = _cust(spark, sf)
    return c.select(
        F.col("Cust Name").alias("customer_name"),
        F.concat_ws("", "Cust Name", F.lit("/"), "Date Purchased").alias("concat_skip_null"),
        F.concat("Cust Name", F.lit("/"), "Date Purchased").alias("concat_op"),
        F.regexp_extract("Phone", "[0-9]+", 0).alias("first_digits"),
        F.coalesce(F.round(try_double("Amount USD"), 2), F.lit(0.0)).alias("amount"),
    )


@register("c2_normalize_name", """
SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^0-9a-z一-鿿]+', '_', 'g'), '_') AS norm_type,
       trim(regexp_replace(lower(p_name), '[^0-9a-z一-鿿]+', '_', 'g'), '_') AS norm_name FROM part""")
def c2_normalize_name(spark, sf):
    p = fr.table(spark, sf, "part")
    return p.select("p_partkey", normalize_name("p_type").alias("norm_type"), normalize_name("p_name").alias("norm_name"))
