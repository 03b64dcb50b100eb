"""SQL twins of the frames, for the DuckDB oracle.

Each constant is a CTE body; ``with_ctes`` stitches the ones a query needs.
They re-state in ANSI/DuckDB SQL exactly what ``tessera.plans.frames`` builds
with the DataFrame API.
"""

from __future__ import annotations

from tessera.plans.frames import (
    CUSTOMER_FILE, EVENT_REQUIRED, PRIORITY_REQUIRED, SHEET_EXTRA, SHEET_EXTRA_SEGMENT, SHEET_SPELLINGS,
    SUPPLIER_FILE,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def pick_sql(idx: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"CASE {idx} {arms} END"


def with_ctes(*parts: tuple[str, str], body: str) -> str:
    ctes = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in parts)
    return f"WITH {ctes}\n{body}"


_DAY = "DATE '2023-01-01' + CAST({k} % {m} AS INTEGER)"

CUST = ("cust", f"""
SELECT c_name AS "Cust Name",
  CASE c_custkey % 6
    WHEN 0 THEN strftime({_DAY.format(k='c_custkey', m=365)}, '%Y-%m-%d')
    WHEN 1 THEN strftime({_DAY.format(k='c_custkey', m=365)}, '%Y/%-m/%-d')
    WHEN 2 THEN strftime({_DAY.format(k='c_custkey', m=365)}, '%Y-%m-%d') || ' 10:30:00'
    WHEN 3 THEN 'n/a'
    WHEN 4 THEN NULL
    ELSE strftime({_DAY.format(k='c_custkey', m=365)}, '%Y年%-m月%-d日') END AS "Date Purchased",
  CASE c_custkey % 8
    WHEN 0 THEN ' ' || CAST(c_acctbal AS VARCHAR) || ' '
    WHEN 1 THEN '1e3'
    WHEN 2 THEN 'n/a'
    WHEN 3 THEN '1_000'
    ELSE CAST(c_acctbal AS VARCHAR) END AS "Amount USD",
  CAST(c_nationkey AS VARCHAR) AS "Country",
  '+1 (' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ') 555-'
    || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS "Phone",
  c_mktsegment AS "Segment",
  {q(CUSTOMER_FILE)} AS source_file
FROM customer""")

SUPP = ("supp", f"""
SELECT s_name AS "客户名称",
  strftime({_DAY.format(k='s_suppkey', m=300)}, '%Y-%m-%d') AS "订单日期",
  CAST(s_acctbal AS VARCHAR) AS "金额",
  CAST(s_nationkey AS VARCHAR) AS "国家",
  '021-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || '-3000' AS "电话",
  {q(SUPPLIER_FILE)} AS source_file
FROM supplier""")

ORD = ("ord", """
SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS "Customer",
  CAST(o_orderdate AS VARCHAR) AS "Order Date",
  CAST(o_totalprice AS VARCHAR) AS "Revenue USD",
  o_orderstatus AS "Status",
  'orders_' || o_orderpriority || '.csv' AS source_file
FROM orders""")

UNIFIED = ("t", """
SELECT "Country" AS country, "Cust Name" AS customer_name, "Date Purchased" AS order_date,
       "Phone" AS phone, "Amount USD" AS revenue, source_file FROM cust
UNION ALL
SELECT "国家", "客户名称", "订单日期", "电话", "金额", source_file FROM supp
UNION ALL
SELECT CAST(NULL AS VARCHAR), "Customer", "Order Date", CAST(NULL AS VARCHAR), "Revenue USD", source_file FROM ord""")

SALES = (CUST, SUPP, ORD, UNIFIED)


# --- per-customer sheets -----------------------------------------------------

def _spell(i: int) -> str:
    return pick_sql(f"((c_custkey % 7) + (c_custkey % 5) * {i}) % 6", SHEET_SPELLINGS[i])


SHEET_HEADERS_LONG = ("sheet_cols", "\nUNION ALL\n".join(
    [f"SELECT 'sheet_' || CAST(c_custkey AS VARCHAR) || '.csv' AS source_id, {i} AS pos, {_spell(i)} AS name, "
     f"c_custkey AS source_order FROM customer" for i in range(len(SHEET_SPELLINGS))]
    + [f"SELECT 'sheet_' || CAST(c_custkey AS VARCHAR) || '.csv', {len(SHEET_SPELLINGS)}, {q(SHEET_EXTRA)}, "
       f"c_custkey FROM customer WHERE c_mktsegment = {q(SHEET_EXTRA_SEGMENT)}"]))

_SHEET_VALUES = [
    "c_name",
    "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)",
    "CAST(o_totalprice AS VARCHAR)",
    "lower(replace(c_name, '#', '.')) || '@example.com'",
    "'+1 (' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ') 555-' || "
    "lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')",
    "CAST(c_nationkey AS VARCHAR)",
]

SHEET_CELLS = ("sheet_cells", "\nUNION ALL\n".join(
    [f"SELECT 'sheet_' || CAST(c_custkey AS VARCHAR) || '.csv' AS source_id, o_orderkey AS row_no, {i} AS pos, "
     f"{v} AS value FROM orders JOIN customer ON o_custkey = c_custkey" for i, v in enumerate(_SHEET_VALUES)]
    + [f"SELECT 'sheet_' || CAST(c_custkey AS VARCHAR) || '.csv', o_orderkey, {len(_SHEET_VALUES)}, o_orderstatus "
       f"FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = {q(SHEET_EXTRA_SEGMENT)}"]))

# catalog rows: (source_id, pos, name, type, samples as '|'-joined text) — samples
# are the first five data rows' cells.
SHEET_CATALOG = ("sheet_catalog", """
SELECT c.source_id, c.pos, c.name, 'VARCHAR' AS type, c.source_order, COALESCE(s.samples, '') AS samples
FROM sheet_cols c LEFT JOIN (
  SELECT source_id, pos, string_agg(COALESCE(value, ''), '|' ORDER BY row_no) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id, pos ORDER BY row_no) AS rn FROM sheet_cells)
  WHERE rn <= 5 GROUP BY source_id, pos) s USING (source_id, pos)""")

NORM = "trim(regexp_replace(lower({x}), '[^0-9a-z一-鿿]+', '_', 'g'), '_')"


def norm(x: str) -> str:
    return NORM.format(x=x)


SHEET_FP = ("sheet_fp", f"""
SELECT source_id, any_value(source_order) AS source_order,
  'h:' || substr(sha256(string_agg({norm('name')} || ':' || type, '|' ORDER BY {norm('name')} || ':' || type)), 1, 12)
    AS fingerprint
FROM sheet_catalog GROUP BY source_id""")

SHEETS = (SHEET_HEADERS_LONG, SHEET_CELLS, SHEET_CATALOG, SHEET_FP)


# --- long catalogs ---------------------------------------------------------------

EVENT_CELLS = ("ev_cells", """
SELECT 'u' || CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS source_id,
       event_id AS row_no, event_type AS name, CAST(value AS VARCHAR) AS value
FROM events""")

PRIORITY_CELLS = ("pr_cells", """
SELECT 'c' || CAST(o_custkey AS VARCHAR) AS source_id, o_orderkey AS row_no,
       o_orderpriority AS name, CAST(o_totalprice AS VARCHAR) AS value
FROM orders""")


def long_catalog(name: str, cells: str) -> tuple[str, str]:
    return (name, f"""
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY first_row, name) - 1 AS INTEGER) AS pos,
       name, 'VARCHAR' AS type, samples
FROM (SELECT source_id, name, min(row_no) AS first_row,
             string_agg(CASE WHEN rn <= 5 THEN COALESCE(value, '') END, '|' ORDER BY row_no) AS samples
      FROM (SELECT *, row_number() OVER (PARTITION BY source_id, name ORDER BY row_no) AS rn FROM {cells})
      GROUP BY source_id, name)""")


EV_CATALOG = long_catalog("ev_catalog", "ev_cells")
PR_CATALOG = long_catalog("pr_catalog", "pr_cells")


def fp_cte(name: str, catalog: str) -> tuple[str, str]:
    return (name, f"""
SELECT source_id,
  'h:' || substr(sha256(string_agg({norm('name')} || ':' || type, '|' ORDER BY {norm('name')} || ':' || type)), 1, 12)
    AS fingerprint
FROM {catalog} GROUP BY source_id""")


def required_values(rows: list[str], skill_id: int) -> str:
    return " UNION ALL ".join(f"SELECT {skill_id} AS skill_id, {i} AS pos, {q(n)} AS name" for i, n in enumerate(rows))


REQUIRED = ("req", required_values(EVENT_REQUIRED, 1) + " UNION ALL " + required_values(PRIORITY_REQUIRED, 2))
