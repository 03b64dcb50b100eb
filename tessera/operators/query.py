"""Queries over the unified table (Q1-Q8).

The unified table is all text; every measure and date goes through the safe
casts. Long shapes (top-N, monthly series) and the wide month pivot are plain
DataFrame plans: partial aggregation before the shuffle, ``TakeOrderedAndProject``
for top-N, and a pivot with explicit month values (no distinct pass).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.casts import as_col, try_date, try_double
from tessera.functions.guard import SqlRejected, guard_accepts, guard_reason, validate_select
from tessera.functions.text import source_prefix


def run_query(spark: SparkSession, table: DataFrame, sql: str, cap: int | None = None, view: str = "t") -> DataFrame:
    """Expose ``table`` as view ``t``, run one guarded read-only query; with ``cap``,
    at most so many rows. A view of that name that the session has stays as it was.

    WITH, FROM-first and nested selects are native Spark SQL. The statement heads PIVOT
    and UNPIVOT are mapped to ``groupBy().pivot`` and ``unpivot``: see ``pivot_statement``
    and ``unpivot_statement``; other forms of them are refused with the form's reason.
    """
    safe = validate_select(sql)
    head = safe.split(None, 1)[0].lower()
    if head in ("pivot", "unpivot"):
        made = (pivot_statement if head == "pivot" else unpivot_statement)(table, safe, view)
        return made if cap is None else made.limit(cap)
    held = spark.table(view) if spark.catalog.tableExists(view) else None
    table.createOrReplaceTempView(view)
    try:
        result = spark.sql(safe)  # resolved here: the view is not needed afterwards
    finally:
        spark.catalog.dropTempView(view)
        if held is not None:
            held.createOrReplaceTempView(view)
    return result if cap is None else result.limit(cap)


_PIVOT = re.compile(r"(?is)^pivot\s+(?:from\s+)?(\w+)\s+on\s+(.+?)(?:\s+in\s*\((.*?)\))?(?:\s+using\s+(.+?))?(?:\s+group\s+by\s+(.+?))?$")
_UNPIVOT = re.compile(r"(?is)^unpivot\s+(?:from\s+)?(\w+)\s+on\s+(.+?)(?:\s+into\s+name\s+(\w+)\s+value\s+(\w+))?$")
_ALIAS = re.compile(r"(?is)^(.+?)\s+as\s+(\w+)$")
PIVOT_FORM = "PIVOT takes the form: PIVOT t ON expression [IN ('a', ...)] [USING aggregate [AS name], ...] [GROUP BY column, ...]"
UNPIVOT_FORM = "UNPIVOT takes the form: UNPIVOT t ON column, ... [INTO NAME name VALUE value]"


def _listed(text: str | None) -> list[str]:
    """The items of a list, cut at commas outside brackets and quotes."""
    items, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text or ""):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'`\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            items.append(text[start:i].strip())
            start = i + 1
    return [*items, text[start:].strip()] if text else []


def _unquoted(name: str) -> str:
    return name[1:-1] if len(name) > 1 and name[0] == name[-1] and name[0] in "\"`" else name


def pivot_statement(table: DataFrame, sql: str, view: str = "t") -> DataFrame:
    """``PIVOT t ON expression [IN (labels)] [USING aggregates] [GROUP BY columns]``.

    One column a label, in label order, and label ``_`` aggregate if an aggregate has a name
    or there are several. Labels that are not listed are found in one pass over the table;
    NULL is no label. Without USING rows are counted; without GROUP BY all columns group
    that the statement does not name. Counts of nothing are 0, other aggregates NULL. More
    labels than ``spark.sql.pivotMaxValues`` are refused. Expressions are Spark SQL.
    """
    form = _PIVOT.match(sql)
    if not form or form[1].lower() != view.lower() or len(_listed(form[2])) != 1:
        raise SqlRejected(PIVOT_FORM)
    on, using = form[2], _listed(form[4]) or ["count(*)"]
    aggregates = [(a[1], a[2]) if (a := _ALIAS.match(u)) else (u, None) for u in using]
    named = {w.lower() for text in (on, *using) for w in re.findall(r"\w+", text)}
    groups = [_unquoted(g) for g in _listed(form[5])] or [c for c in table.columns if c.lower() not in named]
    if lost := [g for g in groups if g.lower() not in {c.lower() for c in table.columns}]:
        raise SqlRejected(f"{PIVOT_FORM}; no column {', '.join(lost)}")
    base = table.withColumn("_label", F.expr(on).cast("string"))
    if form[3] is not None:
        labels = [x[1:-1].replace("''", "'") if x[:1] == "'" else x for x in _listed(form[3])]
    else:
        most = int(table.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = base.select("_label").where("_label is not null").distinct().limit(most + 1).collect()
        if len(found) > most:
            raise SqlRejected(f"PIVOT finds more than {most} labels")
        labels = sorted(r[0] for r in found)
    plain = len(aggregates) == 1 and aggregates[0][1] is None
    names = [label if plain else f"{label}_{alias or text}" for label in labels for text, alias in aggregates]
    counts = [n for n, (text, _) in zip(names, aggregates * len(labels)) if re.match(r"(?i)count\s*\(", text)]
    if not labels:
        return base.select(*groups).distinct()
    wide = base.groupBy(*groups).pivot("_label", labels).agg(*[F.expr(text).alias(f"_a{i}") for i, (text, _) in enumerate(aggregates)])
    return wide.toDF(*groups, *names).na.fill(0, subset=counts) if counts else wide.toDF(*groups, *names)


def unpivot_statement(table: DataFrame, sql: str, view: str = "t") -> DataFrame:
    """``UNPIVOT t ON columns [INTO NAME name VALUE value]``: a row for each named column's
    value that is not NULL, next to all other columns; ``name`` and ``value`` by default."""
    form = _UNPIVOT.match(sql)
    if not form or form[1].lower() != view.lower():
        raise SqlRejected(UNPIVOT_FORM)
    by_name = {c.lower(): c for c in table.columns}
    wanted = [_unquoted(c).lower() for c in _listed(form[2])]
    if lost := [c for c in wanted if c not in by_name]:
        raise SqlRejected(f"{UNPIVOT_FORM}; no column {', '.join(lost)}")
    columns = [by_name[c] for c in wanted]
    name, value = form[3] or "name", form[4] or "value"
    kept = [c for c in table.columns if c not in columns]
    return unpivot_long(table, kept, columns, name, value).where(F.col(f"`{value}`").isNotNull())


def total_by(df: DataFrame, dim: str, measure: str, n: int | None = None, out: str = "total") -> DataFrame:
    """``SUM(TRY_CAST(measure AS DOUBLE))`` by ``dim``, largest first; with ``n``, the first ``n``.

    Sums are rounded to 2 places so the result does not depend on row order;
    ties are broken by ``dim`` (NULLs last in both orders).
    """
    agg = df.groupBy(dim).agg(F.round(F.sum(try_double(measure)), 2).alias(out))
    ordered = agg.orderBy(F.col(out).desc_nulls_last(), F.col(dim).asc_nulls_last())
    return ordered if n is None else ordered.limit(n)


def monthly_totals(df: DataFrame, date_col: str, measure: str, out: str = "total") -> DataFrame:
    """``yyyy-MM`` bucket of the parseable dates, summed, in month order."""
    d = try_date(date_col)
    return (
        df.where(d.isNotNull())
        .groupBy(F.date_format(d, "yyyy-MM").alias("month"))
        .agg(F.round(F.sum(try_double(measure)), 2).alias(out))
        .orderBy("month")
    )


def month_labels(suffix: str) -> list[str]:
    return [f"{m}{suffix}" for m in range(1, 13)]


def pivot_wide(df: DataFrame, dims: list[str], date_col: str, measure: str, suffix: str = "月_revenue",
               prefix_from: str | None = "source_file", prefix_name: str = "data_source") -> DataFrame:
    """Rows ``(source prefix, dims...)`` x one column per month ``{m}{suffix}``
    holding ``COALESCE(ROUND(SUM(measure), 2), 0)``; unparseable dates are
    filtered first so no stray label appears.

    Month values are passed explicitly (one aggregation job, no distinct pass);
    absent cells are filled after the pivot.
    """
    d = try_date(date_col)
    keys = []
    base = df.where(d.isNotNull())
    if prefix_from:
        base = base.withColumn(prefix_name, source_prefix(prefix_from))
        keys.append(prefix_name)
    keys += list(dims)
    labels = month_labels(suffix)
    base = base.select(
        *keys,
        F.concat(F.month(d).cast("string"), F.lit(suffix)).alias("_label"),
        try_double(measure).alias("_amt"),
    )
    wide = base.groupBy(*keys).pivot("_label", labels).agg(F.round(F.sum("_amt"), 2))
    return wide.na.fill(0.0, subset=labels)


def unpivot_long(df: DataFrame, ids: list[str], values: list[str] | None = None,
                 var: str = "label", val: str = "value") -> DataFrame:
    """Inverse of the pivot: one row per (ids, label)."""
    vals = values if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(ids, vals, var, val)


def preview(df: DataFrame, limit: int | None = None, order_by: list | None = None) -> DataFrame:
    """The first ``limit`` rows, or all; with ``order_by`` the choice is deterministic."""
    ordered = df.orderBy(*[as_col(c) for c in order_by]) if order_by else df
    return ordered if limit is None else ordered.limit(limit)


def audit_queries(df: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Guard over a table of SQL texts: ``accepted`` and ``reason`` per row."""
    return df.withColumn("accepted", guard_accepts(sql_col)).withColumn("reason", guard_reason(sql_col))
