"""Drift classification cases (required = Cust Name, Amount USD)."""

import pytest

from tessera.operators import drift

CASES = [
    (["Amount USD", "Cust Name"], "exact", [], []),
    (["cust_name", "amount usd"], "exact", [], []),
    (["Cust Name", "Amount USD", "Note"], "mappable", [], ["Note"]),
    (["Customer", "Amount USD"], "mappable", ["Cust Name"], ["Customer"]),
    (["Amount USD"], "unmappable", ["Cust Name"], None),
    (["Foo"], "unmappable", ["Cust Name", "Amount USD"], None),
]


@pytest.fixture(scope="module")
def reports(spark):
    req = spark.createDataFrame([(1, 0, "Cust Name"), (1, 1, "Amount USD")], "skill_id long, pos int, name string")
    inc = spark.createDataFrame(
        [(f"s{i}", p, n) for i, (cols, *_rest) in enumerate(CASES) for p, n in enumerate(cols)],
        "source_id string, pos int, name string")
    pairs = spark.createDataFrame([(1, f"s{i}") for i in range(len(CASES))], "skill_id long, source_id string")
    return {r["source_id"]: r for r in drift.classify_drift(pairs, req, inc).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(reports, i):
    _, kind, missing, extra = CASES[i]
    r = reports[f"s{i}"]
    assert r["kind"] == kind
    assert list(r["missing"]) == missing
    assert (None if r["extra"] is None else list(r["extra"])) == extra


def test_worst_and_total(spark, reports):
    rows = spark.createDataFrame([(r["skill_id"], r["source_id"], r["kind"]) for r in reports.values()],
                                 "skill_id long, source_id string, kind string")
    w = drift.worst_drift(rows).first()
    assert w["worst"] == "unmappable"
    assert w["n_exact"] + w["n_mappable"] + w["n_unmappable"] == len(CASES)


def test_duplicate_normalized_names_count_once(spark):
    req = spark.createDataFrame([(1, 0, "Cust Name"), (1, 1, "cust_name")], "skill_id long, pos int, name string")
    inc = spark.createDataFrame([("a", 0, "Other")], "source_id string, pos int, name string")
    pairs = spark.createDataFrame([(1, "a")], "skill_id long, source_id string")
    r = drift.classify_drift(pairs, req, inc).first()
    assert list(r["missing"]) == ["cust_name"] and r["kind"] == "mappable"


def test_remap_steps_keep_other_ops():
    steps = [{"op": "map_column", "from": "a", "to": "x"}, {"op": "cast", "column": "x", "type": "DOUBLE"},
             {"op": "dedupe", "keys": ["x"]}]
    new = drift.remap_steps(steps, {"b": {"to": "x"}, "c": {"to": None}})
    assert new == [{"op": "map_column", "from": "b", "to": "x"}] + steps[1:]


def test_remap_skills_table(spark):
    from tessera.operators.ops import STEP_SCHEMA

    skills = spark.createDataFrame(
        [(1, [("map_column", "a", "x", None, None, None, None, None, None),
              ("cast", None, None, "x", "DOUBLE", None, None, None, None)])],
        f"skill_id long, steps array<{STEP_SCHEMA}>")
    new = spark.createDataFrame([(1, [("map_column", "b", "x", None, None, None, None, None, None)])],
                                f"skill_id long, steps array<{STEP_SCHEMA}>")
    out = drift.remap_skills_table(skills, new).first()["steps"]
    assert [(s["op"], s["from"]) for s in out] == [("map_column", "b"), ("cast", None)]
    req = drift.required_columns(drift.remap_skills_table(skills, new)).collect()
    assert [r["name"] for r in req] == ["b"]
