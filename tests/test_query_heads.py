"""PIVOT and UNPIVOT statements, and the forms that are refused; match classes."""

import duckdb
import pytest

from tessera.functions.guard import SqlRejected
from tessera.operators import catalog as cat
from tessera.operators import ops
from tessera.operators.query import run_query

ROWS = [("a", "x", "1", "f1"), ("a", "y", "2", "f1"), ("b", "x", "3", "f2"), ("b", None, "4", "f2"), ("c", "y", None, "f1"), ("it's", "z,(", "9", "f2")]
STATEMENTS = [
    "PIVOT t ON seg USING sum(try_cast(rev as double)) GROUP BY cust", "PIVOT t ON seg USING sum(try_cast(rev as double)) AS s, count(*) AS n GROUP BY cust",
    "PIVOT t ON seg USING count(*) GROUP BY cust", "pivot t on seg using max(rev);", "PIVOT t ON seg IN ('y','x','q') USING max(rev) GROUP BY cust",
    "PIVOT t ON upper(seg) USING max(rev) GROUP BY cust, source_file", "PIVOT t ON seg", "PIVOT t ON seg USING max(rev), min(rev) GROUP BY cust",
    "PIVOT FROM t ON seg || '_' || cust USING max(rev) GROUP BY source_file",
    "UNPIVOT t ON seg, rev INTO NAME k VALUE v", "UNPIVOT t ON seg, rev", "unpivot t on cust, source_file, rev",
]


@pytest.mark.parametrize("sql", STATEMENTS)
def test_equals_the_statement_elsewhere(spark, sql):
    df = spark.createDataFrame(ROWS, "cust string, seg string, rev string, source_file string")
    got = run_query(spark, df, sql)
    c = duckdb.connect()
    c.execute("create table t (cust varchar, seg varchar, rev varchar, source_file varchar)")
    c.executemany("insert into t values (?, ?, ?, ?)", ROWS)
    want = c.sql(sql.rstrip(";").replace("PIVOT FROM", "PIVOT"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("sql", ["PIVOT t ON seg, source_file USING max(rev)", "PIVOT other ON seg", "PIVOT t USING max(rev)", "PIVOT t ON seg GROUP BY nope",
                                 "UNPIVOT t ON nope", "UNPIVOT t", "UNPIVOT u ON seg", "PIVOT (select 1) ON x"])
def test_other_forms_are_refused_with_a_reason(spark, sql):
    df = spark.createDataFrame(ROWS, "cust string, seg string, rev string, source_file string")
    with pytest.raises(SqlRejected, match="takes the form"):
        run_query(spark, df, sql)


def test_labels_have_a_limit(spark):
    df = spark.range(30).selectExpr("cast(id as string) as k", "'v' as v")
    kept = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "20")
    try:
        with pytest.raises(SqlRejected, match="more than 20 labels"):
            run_query(spark, df, "PIVOT t ON k USING max(v)")
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", kept)
    assert run_query(spark, df.limit(0), "PIVOT t ON k USING max(v) GROUP BY v").collect() == []


def test_match_classes_expand_to_the_join(spark):
    sources = spark.createDataFrame([(f"s{i}", f"f{i % 3}") for i in range(30)], "source_id string, fingerprint string")
    skills = spark.createDataFrame([(i, f"f{i % 4 + 1}") for i in range(20)], "skill_id long, fingerprint string")
    classes, members = cat.match_classes(sources, skills)
    assert {tuple(r) for r in classes.collect()} == {("f1", 10, 5), ("f2", 10, 5)}
    assert members.count() == 30
    pairs = {(r.source_id, r.skill_id) for r in cat.expand_matches(members).collect()}
    assert pairs == {(r.source_id, str(r.skill_id)) for r in cat.match_skills(sources, skills).collect()} and len(pairs) == 100


def test_one_mapping_gives_the_rows_of_the_table(spark):
    mapping = {"Cust Name": {"to": "customer_name"}, "Amount": {"to": "revenue"}, "Day": {"to": "order_date"}, "Note": {"to": None}, "x": {"to": ""}}
    canonical = [{"name": "customer_name", "type": None}, {"name": "order_date", "type": "date"}, {"name": "phone", "type": "DATE"}, {"name": "revenue", "type": "DECIMAL"}]
    rows = [("one", i, c, e["to"], True) for i, (c, e) in enumerate(mapping.items())]
    table = ops.steps_table(spark.createDataFrame(rows, "fingerprint string, pos int, source_col string, to string, confirmed boolean"),
                            spark.createDataFrame([(i, f["name"], f["type"]) for i, f in enumerate(canonical)], "pos int, name string, type string"))
    want = [{k: v for k, v in r.asDict().items() if v is not None and k not in ("fingerprint", "step_no")} for r in table.orderBy("step_no").collect()]
    assert ops.steps_from_mapping(mapping, canonical) == want
