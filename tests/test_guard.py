"""Read-only query guard, Column form and Python form agree."""

import pytest

from tessera.functions.guard import SqlRejected, guard_reason, validate_select

ACCEPTED = ["select 1", "WITH a AS (select 1) select * from a;", "FROM t", "PIVOT t ON x USING sum(y)",
            "  select 1 ;;  "]
REFUSED = {
    "select 1; select 2": "multiple statements",
    "values (1)": "not a SELECT/WITH/PIVOT/UNPIVOT/FROM",
    "(select 1)": "not a SELECT/WITH/PIVOT/UNPIVOT/FROM",
    "select * from t where x = 'drop it'": "contains a write/DDL keyword",
    'select "set" from t': "contains a write/DDL keyword",
    "": "not a SELECT/WITH/PIVOT/UNPIVOT/FROM",
    "select 1 ; ;": "multiple statements",
}


def test_column_form(spark):
    texts = ACCEPTED + list(REFUSED)
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    got = {r["sql"]: r["reason"] for r in df.select("sql", guard_reason("sql").alias("reason")).collect()}
    for t in ACCEPTED:
        assert got[t] is None, t
    for t, reason in REFUSED.items():
        assert got[t] == reason, t


@pytest.mark.parametrize("text", ACCEPTED)
def test_python_accepts(text):
    assert validate_select(text)


@pytest.mark.parametrize("text,reason", list(REFUSED.items()))
def test_python_refuses(text, reason):
    with pytest.raises(SqlRejected, match=reason.split("/")[0]):
        validate_select(text)


def test_run_query_caps_and_guards(spark):
    from tessera.operators.query import run_query

    t = spark.range(5000).selectExpr("id", "cast(id % 7 as string) as g")
    spark.range(3).createOrReplaceTempView("t")
    assert run_query(spark, t, "select * from t").count() == 5000
    assert run_query(spark, t, "select * from t", cap=1000).count() == 1000
    assert spark.table("t").count() == 3
    assert run_query(spark, t, "FROM t SELECT g, count(*) AS n GROUP BY g").count() == 7
    with pytest.raises(SqlRejected):
        run_query(spark, t, "drop table t")
