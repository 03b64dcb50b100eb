"""The seven typed steps and their three-phase fold."""

import hashlib

import pytest

from tessera.operators import catalog as cat
from tessera.operators import ops
from tessera.operators.unify import unify


@pytest.fixture()
def df(spark):
    rows = [("Acme", "2026-01-05", "1,200.50", "+1 (415) 555-0100"), ("Acme", "2026-01-05", "1200.50", "415.555.0100"),
            ("Globex", "bad", "890", None)]
    return spark.createDataFrame(rows, "`Cust Name` string, `Date` string, `Amt` string, `Tel` string")


def test_unknown_op_refused(df):
    with pytest.raises(ops.StepError, match="unknown op"):
        ops.apply_steps(df, [{"op": "sql", "text": "x"}])


@pytest.mark.parametrize("bad", ["1; drop table t", "x -- c", "x /* c */", "DELETE", "insert"])
def test_unsafe_expr_refused(df, bad):
    with pytest.raises(ops.StepError, match="unsafe"):
        ops.apply_steps(df, [{"op": "filter", "predicate": bad}])
    with pytest.raises(ops.StepError, match="unsafe"):
        ops.apply_steps(df, [{"op": "derive", "expr": bad, "to": "x"}])


def test_renames_first_then_rest(df):
    out = ops.apply_steps(df, [{"op": "map_column", "from": "Amt", "to": "revenue"},
                               {"op": "map_column", "from": "cust_name", "to": "customer"}])
    assert out.columns == ["revenue", "customer", "Date", "Tel"]


def test_missing_from_is_error(df):
    with pytest.raises(ops.StepError):
        ops.apply_steps(df, [{"op": "map_column", "from": "Nope", "to": "x"}])


def test_duplicate_targets_get_suffix(df):
    out = ops.apply_steps(df, [{"op": "map_column", "from": "Amt", "to": "v"},
                               {"op": "map_column", "from": "Tel", "to": "v"}])
    assert out.columns[:2] == ["v", "v_1"]


def test_phases_ignore_list_order(df):
    steps = [{"op": "filter", "predicate": "revenue > 1000"},
             {"op": "cast", "column": "revenue", "type": "DOUBLE"},
             {"op": "map_column", "from": "Amt", "to": "revenue"}]
    moved = [steps[1], steps[2], steps[0]]
    a = sorted(map(tuple, ops.apply_steps(df, steps).collect()))
    b = sorted(map(tuple, ops.apply_steps(df, moved).collect()))
    assert a == b and len(a) == 1


def test_filter_before_derive_same_result(df):
    base = [{"op": "map_column", "from": "Amt", "to": "revenue"}, {"op": "cast", "column": "revenue", "type": "DOUBLE"}]
    d = {"op": "derive", "expr": "revenue * 2", "to": "twice"}
    f = {"op": "filter", "predicate": "revenue IS NOT NULL"}
    a = ops.apply_steps(df, base + [f, d]).collect()
    b = ops.apply_steps(df, base + [d, f]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_phone_and_dates(df):
    out = ops.apply_steps(df, [{"op": "normalize_phone", "column": "Tel", "region": "US"},
                               {"op": "parse_date", "column": "Date", "to": "Date", "format": "auto"}])
    rows = out.orderBy("Amt").collect()
    assert [r["Tel"] for r in rows] == ["14155550100", "4155550100", None]
    assert str(rows[0]["Date"]) == "2026-01-05" and rows[2]["Date"] is None


def test_parse_date_format_strict(spark):
    df = spark.createDataFrame([("05/01/2026",), ("bad",)], "d string")
    lenient = ops.parse_date(df, "d", "d", "%d/%m/%Y").collect()
    assert [str(r[0]) if r[0] else None for r in lenient] == ["2026-01-05", None]
    with pytest.raises(Exception):
        ops.parse_date(df, "d", "d", "%d/%m/%Y", strict=True).collect()


def test_dedupe_survivor_and_scope(spark):
    df = spark.createDataFrame([("a", "2", "f1"), ("a", "1", "f1"), ("a", "3", "f2")], "k string, v string, source_file string")
    assert sorted(map(tuple, ops.dedupe(df, ["k"]).collect())) == [("a", "1", "f1")]
    scoped = ops.dedupe(df, ["k"], scope="source_file").collect()
    assert sorted(map(tuple, scoped)) == [("a", "1", "f1"), ("a", "3", "f2")]
    assert ops.dedupe(df.select("k"), ["k"]).count() == 1


def test_steps_from_mapping_skips_unproduced():
    mapping = {"Cust Name": {"to": "customer_name"}, "Amount": {"to": "revenue"}, "Note": {"to": None}}
    canon = [{"name": "order_date", "type": "DATE"}, {"name": "revenue", "type": "DECIMAL"},
             {"name": "customer_name", "type": "VARCHAR"}]
    steps = ops.steps_from_mapping(mapping, canon)
    assert steps == [{"op": "map_column", "from": "Cust Name", "to": "customer_name"},
                     {"op": "map_column", "from": "Amount", "to": "revenue"},
                     {"op": "cast", "column": "revenue", "type": "DECIMAL"}]


def test_unify_row_count_and_first_present(spark):
    a = spark.createDataFrame([("x", "1")], "n string, m string")
    b = spark.createDataFrame([("y", "2"), ("z", None)], "name string, amount string")
    out = unify([("a.csv", a), ("b.csv", b)], [("n", "customer"), ("name", "customer"), ("amount", "revenue")])
    assert out.columns == ["customer", "revenue", "source_file"]
    assert out.count() == 3
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("x", None, "a.csv"), ("y", "2", "b.csv"), ("z", None, "b.csv")], key=str)


def test_fingerprint_ignores_column_order(spark):
    c = spark.createDataFrame([("s1", 0, "A b", "VARCHAR"), ("s1", 1, "C", "VARCHAR"),
                               ("s2", 0, "c", "VARCHAR"), ("s2", 1, "a_b", "VARCHAR")],
                              "source_id string, pos int, name string, type string")
    fps = {r["source_id"]: r["fingerprint"] for r in cat.fingerprints(c).collect()}
    assert fps["s1"] == fps["s2"] == "h:" + hashlib.sha256(b"a_b:VARCHAR|c:VARCHAR").hexdigest()[:12]


def test_latest_and_next_version(spark):
    skills = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "id long, name string, version int")
    nv = {r["name"]: r["next_version"] for r in cat.next_version(skills, ["name"]).collect()}
    assert nv == {"a": 3, "b": 2}
    latest = {r["name"]: r["id"] for r in cat.latest_version(skills, ["name"]).collect()}
    assert latest == {"a": 2, "b": 3}
    assert [r["id"] for r in cat.list_newest_first(skills).collect()] == [3, 2, 1]


def test_append_versions(spark):
    existing = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "id long, name string, version int")
    new = spark.createDataFrame([(3, "a"), (4, "b"), (5, "a")], "id long, name string")
    got = {r["id"]: r["version"] for r in cat.append_versions(existing, new).collect()}
    assert got == {3: 3, 5: 4, 4: 1}


def test_derive_replaces_existing_name(df):
    out = ops.apply_steps(df, [{"op": "derive", "expr": "upper(Amt)", "to": "Amt"}])
    assert out.columns == df.columns
