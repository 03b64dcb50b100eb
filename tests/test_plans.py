"""Plan-shape checks: the properties the operators rely on at scale."""

import contextlib
import io
import os
import sys

from pyspark.sql import functions as F

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tessera.operators import catalog as cat  # noqa: E402
from tessera.operators import grid as gd  # noqa: E402
from tessera.operators import ops  # noqa: E402

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_dedupe_is_partial_aggregate(spark):
    df = spark.range(3000).selectExpr("cast(id % 3 as string) as k", "cast(id as string) as v")
    p = plan(ops.dedupe(df, ["k"]))
    assert "partial_min_by" in p and "Window" not in p


def test_heads_use_group_limit(spark):
    g = spark.range(3000).selectExpr("concat('f', id % 4) as source_file", "id as row_no",
                                     "array(cast(id as string), 'x') as cells")
    assert plan(gd.head_rows(g)).count("WindowGroupLimit") >= 2
    assert plan(cat._first_n(g, ["source_file"], ["row_no"], 5)).count("WindowGroupLimit") >= 2
    assert "Window" not in plan(gd.head_rows(g, dense=True))


def test_hot_file_keeps_every_row(spark):
    """One file holds a third of all rows: cleaning keeps all of them."""
    hot = spark.range(3000).selectExpr("'hot.csv' as source_file", "id + 1 as row_no",
                                       "array(cast(id as string), cast(id * 2 as string)) as cells")
    cold = spark.range(6000).selectExpr("concat('c', id % 300, '.csv') as source_file", "id + 1 as row_no",
                                        "array(cast(id as string), cast(id * 3 as string)) as cells")
    headers = spark.range(301).selectExpr(
        "case when id = 300 then 'hot.csv' else concat('c', id, '.csv') end as source_file", "cast(0 as bigint) as row_no",
        "array('key', 'value') as cells")
    grid = hot.unionByName(cold).unionByName(headers)
    rows, heads = gd.clean_sheets(grid)
    assert heads.count() == 301
    assert rows.count() == 9000
    assert rows.where(F.col("source_file") == "hot.csv").count() == 3000





def test_no_python_or_cross_join_in_any_query(spark):
    for name, fn in E.QUERIES.items():
        p = plan(fn(spark, E.SMOKE_DIR))
        bad = [f for f in FORBIDDEN if f in p]
        assert not bad, (name, bad)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_global_index_with_other_columns(spark, adaptive):
    from tessera.operators.mapping import raw_canonical

    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        catalog = spark.range(400_000).selectExpr("cast((id * 7919) % 400000 as int) as source_order", "0 as pos", "concat('n', id) as name", "'VARCHAR' as type")
        got = raw_canonical(catalog)
        one = got.selectExpr("count(distinct pos) n", "min(pos) a", "max(pos) b", "count(distinct name) m").first()
        assert tuple(one) == (400_000, 0, 399_999, 400_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_global_index_dense_and_ordered(spark):
    from tessera.operators.sizing import global_index

    df = spark.range(5000).selectExpr("cast((id * 7919) % 5000 as int) as k", "id")
    got = global_index(df, ["k"], "pos", parts=7).select("k", "pos").collect()
    assert sorted(r["pos"] for r in got) == list(range(5000))
    assert all(r["pos"] == r["k"] for r in got)
    assert "SinglePartition" not in plan(global_index(df, ["k"], "pos", parts=7)).split("BroadcastExchange")[0]


def test_global_index_with_ties(spark):
    from tessera.operators.sizing import global_index

    df = spark.range(3000).selectExpr("cast(id % 17 as int) as k", "id")
    rows = sorted(global_index(df, ["k"], "pos", parts=5).select("pos", "k").collect())
    assert [r["pos"] for r in rows] == list(range(3000))
    assert all(a["k"] <= b["k"] for a, b in zip(rows, rows[1:]))
