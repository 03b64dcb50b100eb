"""Run log and keyed stores: repeated, half-failed and concurrent-reader cases; many skills."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import commits, drift
from tessera.operators.commits import read_keyed, read_reports, read_runs, record_runs, upsert_keyed
from test_fold import SKILLS, rename, skill_rows, step

REPORTS = "skill_id long, source_id string, kind string, missing array<string>, extra array<string>"
MEMORY = "fingerprint string, source_col string, to string"


def reports(spark, *rows):
    return spark.createDataFrame([(s, f, k, [], []) for s, f, k in rows], REPORTS)


def test_a_run_written_twice_is_one_run(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert read_runs(spark, path).collect() == [] and read_reports(spark, path).collect() == []
    r = reports(spark, (1, "a", "exact"), (1, "b", "mappable"), (2, "a", "exact"))
    for _ in range(2):
        assert record_runs(path, drift.run_rows(r), r, "run-1", "2024-01-01 00:00:00") == "run-1"
    other = record_runs(path, drift.run_rows(r, "ok"), r)
    got = sorted((x.run_id == "run-1", x.skill_id, x.status, x.n_inputs) for x in read_runs(spark, path).collect())
    assert got == [(False, 1, "ok", 2), (False, 2, "ok", 1), (True, 1, "drift_mappable", 2), (True, 2, "ok", 1)]
    assert read_reports(spark, path).groupBy("run_id").count().collect() and read_reports(spark, path).where(F.col("run_id") == other).count() == 3


def test_a_half_failed_run_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/log"
    r = reports(spark, (1, "a", "exact"))
    with monkeypatch.context() as m:
        m.setattr(commits, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            record_runs(path, drift.run_rows(r), r, "run-1")
    assert spark.read.parquet(f"{path}/runs").count() == 1  # staged, not committed
    assert read_runs(spark, path).collect() == [] and read_reports(spark, path).collect() == []
    record_runs(path, drift.run_rows(r), r, "run-1")
    assert read_runs(spark, path).count() == 1 and read_reports(spark, path).count() == 1
    commits._staged(read_runs(spark, path), path, "runs", "other")  # a second writer of the same run got through, too
    commits._commit(spark, path, ["run-1"], "other")
    assert read_runs(spark, path).count() == 1


def test_upsert_replaces_keys_and_touches_their_buckets_only(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/memory"
    first = spark.createDataFrame([(f"f{i}", c, "x") for i in range(300) for c in "ab"], MEMORY)
    assert len(upsert_keyed(path, first, "fingerprint")) > 50
    before = read_keyed(spark, path, MEMORY)
    assert before.count() == 600
    new = spark.createDataFrame([("f7", "c", "new"), ("fresh", "a", "new")], MEMORY)
    with monkeypatch.context() as m:
        m.setattr(commits, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            upsert_keyed(path, new, "fingerprint")
    assert read_keyed(spark, path, MEMORY).count() == 600
    touched = upsert_keyed(path, new, "fingerprint")
    assert 1 <= len(touched) <= 2
    now = {tuple(r) for r in read_keyed(spark, path, MEMORY).collect()}
    assert now == ({tuple(r) for r in first.collect()} - {("f7", "a", "x"), ("f7", "b", "x")}) | {("f7", "c", "new"), ("fresh", "a", "new")}
    assert before.count() == 600  # a reader that began before the commit still sees the old table, whole
    one = read_keyed(spark, path, MEMORY, touched[:1])
    files = {r[0] for r in one.select(F.input_file_name()).collect()}
    assert files and all(f"bucket={touched[0]}/" in f for f in files)
    assert "Filter " not in one._jdf.queryExecution().executedPlan().toString()  # both are partition filters: other files are not opened
    assert upsert_keyed(path, new.limit(0), "fingerprint") == []


def test_many_skills_close_the_loop(spark, tmp_path):
    skills = {1: [rename("Cust Name", "customer_name"), rename("Amount USD", "revenue"), step(op="cast", column="revenue", type="DECIMAL")],
              2: [rename("Cust Name", "customer_name")], 3: [rename("a", "x"), rename("b", "y"), rename("c", "z")],
              4: [rename("Customer", "customer_name"), step(op="cast", column="gone", type="DOUBLE")]}
    sources = {"next": (["Customer", "Revenue USD", "Note"], [["Acme", "12.5", "n"], ["Globex", "n/a", None]]),
               "same": (["Cust Name"], [["Initech"]]), "few": (["q"], [["1"]])}
    pairs = [(1, "next", 0), (2, "same", 0), (3, "few", 0), (4, "next", 0)]
    table = spark.createDataFrame(skill_rows(skills), SKILLS).withColumn("fingerprint", F.lit("h:old"))
    grid = spark.createDataFrame([(f, i, c) for f, (_, rows) in sources.items() for i, c in enumerate(rows)], "source_file string, row_no long, cells array<string>")
    headers = spark.createDataFrame([(f, h) for f, (h, _) in sources.items()], "source_file string, header array<string>")
    links = spark.createDataFrame(pairs, "skill_id long, source_file string, source_order int")
    log = f"{tmp_path}/runs"
    out = drift.apply_skills(table, grid, headers, links, runs_path=log, run_id="gate")
    assert {r.skill_id: r.worst for r in out["verdicts"].collect()} == {1: "mappable", 2: "exact", 3: "unmappable", 4: "mappable"}
    assert [(r.skill_id, r.names, r["values"]) for r in out["result"].collect()] == [(2, ["customer_name"], ["Initech"])]
    proposed = {(r.skill_id, r.source_col): r.to for r in out["proposed_mapping"].collect()}
    assert proposed == {(s, c): t for s in (1, 4) for c, t in (("Customer", "customer_name"), ("Revenue USD", "revenue"), ("Note", None))}
    mapping = out["proposed_mapping"].where("skill_id = 1").drop("skill_id")
    paths = {k: f"{tmp_path}/{k}" for k in ("memory_path", "skills_path")}
    for _ in range(2):  # repeated: the same stores, one run
        done = drift.remap_skills(table, mapping, grid, headers, links.where("skill_id in (1, 4)"), runs_path=log, run_id="remap", **paths)
    assert sorted((r.skill_id, tuple(zip(r.names, r["values"]))) for r in done["result"].collect()) == [
        (1, (("customer_name", "Acme"), ("revenue", "12.500"), ("Note", "n"))), (1, (("customer_name", "Globex"), ("revenue", None), ("Note", None)))]
    assert [(r.skill_id, r.problem) for r in done["problems"].collect()] == [(4, "cast: column not found: gone")]
    new = {r.skill_id: ([(s["op"], s["from"]) for s in r.steps], r.fingerprint) for r in done["skills"].collect()}
    assert new[1][0] == [("map_column", "Customer"), ("map_column", "Revenue USD"), ("cast", None)] and new[1][1] != "h:old" == new[2][1]
    stored = read_keyed(spark, paths["skills_path"], f"{SKILLS}, fingerprint string")
    assert {r.skill_id: r.fingerprint for r in stored.collect()} == {1: new[1][1], 4: new[1][1]}
    assert sorted((r.source_col, r.to) for r in done["memory"].collect() if r.fingerprint == new[1][1]) == [
        ("Customer", "customer_name"), ("Note", None), ("Revenue USD", "revenue")]
    runs = sorted((r.run_id, r.skill_id, r.status) for r in read_runs(spark, log).collect())
    assert runs == [("gate", 1, "drift_mappable"), ("gate", 2, "ok"), ("gate", 3, "drift_unmappable"), ("gate", 4, "drift_mappable"),
                    ("remap", 1, "ok"), ("remap", 4, "ok")]
