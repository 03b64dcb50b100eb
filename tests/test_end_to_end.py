"""The reference's end-to-end path on its three sample exports, with its
regression anchors: 2 fingerprints, dictionary hits, canonical v1, memory
reuse, 10 unified rows, exact replay keeps 5 rows, dedupe 5 -> 4, mappable
drift with the right proposal, 3 rows after remap."""

from pyspark.sql import functions as F

from conftest import SALES_FEB_ZH, SALES_JAN, SALES_MAR_DRIFT, write_text
from tessera.operators import catalog as cat
from tessera.operators import commits, drift
from tessera.operators import mapping as mp
from tessera.operators import ops
from tessera.operators.unify import unify
from tessera.sources.delimited import read_delimited


def _load(spark, tmp_path, name, text):
    p = write_text(tmp_path, name, text)
    df = read_delimited(spark, p).withColumn("source_file", F.lit(name))
    return df


def _catalog(df, order):
    c = cat.introspect(df, "source_file")
    return c.withColumnRenamed("source_id", "source_id").withColumn("source_order", F.lit(order))


def test_reference_flow(spark, tmp_path):
    jan = _load(spark, tmp_path, "sales_jan.csv", SALES_JAN)
    feb = _load(spark, tmp_path, "sales_feb_zh.csv", SALES_FEB_ZH)
    catalog = _catalog(jan, 0).unionByName(_catalog(feb, 1))
    fps = cat.fingerprints(catalog)
    assert fps.select("fingerprint").distinct().count() == 2
    assert all(r["fingerprint"].startswith("h:") and len(r["fingerprint"]) == 14 for r in fps.collect())

    proposal = mp.propose_by_synonyms(catalog)
    m = {r["source_col"]: r for r in proposal.collect()}
    assert m["Cust Name"]["to"] == "customer_name"
    assert m["客户名称"]["to"] == "customer_name"
    assert m["金额"]["to"] == "revenue"
    assert m["Cust Name"]["confidence"] == 0.95

    canon = mp.canonical_from_mapping(proposal)
    assert all(r["desc_zh"] for r in canon.collect())
    canon_table = canon.withColumn("version", F.lit(None).cast("int")).where("false")
    assert cat.next_version(canon_table).first()["next_version"] == 1

    sources = fps.join(catalog.select("source_id", "source_order").distinct(), "source_id")
    confirmed = mp.backfill_unmapped(proposal, catalog)
    memory = mp.confirm_mapping(confirmed, catalog, sources, confirmed_at="2026-01-31 00:00:00")
    assert mp.reuse_confirmed(sources, catalog, memory) is not None

    flat = {r["source_col"]: r["to"] for r in mp.flat_mapping(sources, memory).collect()}
    table = unify([("sales_jan.csv", jan), ("sales_feb_zh.csv", feb)], list(flat.items()))
    assert "customer_name" in table.columns
    assert table.count() == 10

    jan_map = {r["source_col"]: {"to": r["to"]} for r in memory.join(
        fps.where(F.col("source_id") == "sales_jan.csv"), "fingerprint").orderBy("pos").collect()}
    canon_rows = [r.asDict() for r in canon.orderBy("pos").collect()]
    steps = ops.steps_from_mapping(jan_map, canon_rows)
    assert any(s["op"] == "map_column" for s in steps)

    jan_cat = catalog.where(F.col("source_id") == "sales_jan.csv")
    out = drift.apply_skill(steps, [("sales_jan.csv", jan)], jan_cat)
    assert out["status"] == "ok"
    res = out["result"]
    assert res.count() == 5
    assert {"customer_name", "revenue"} <= set(res.columns)

    deduped = ops.apply_steps(jan, steps + [{"op": "dedupe", "keys": ["customer_name", "order_date", "revenue"]}])
    assert deduped.count() == 4

    mar = _load(spark, tmp_path, "sales_mar_drift.csv", SALES_MAR_DRIFT)
    mar_cat = _catalog(mar, 2)
    applied = drift.apply_skill(steps, [("sales_mar_drift.csv", mar)], mar_cat)
    assert applied["status"] == "drift_mappable"
    prop = {r["source_col"]: r["to"] for r in applied["proposed_mapping"].collect()}
    assert prop["Customer"] == "customer_name" and prop["Revenue USD"] == "revenue"
    assert prop["Discount"] is None

    new_steps = drift.remap_steps(steps, {k: {"to": v} for k, v in prop.items()})
    assert [s["op"] for s in new_steps if s["op"] != "map_column"] == [s["op"] for s in steps if s["op"] != "map_column"]
    rerun = drift.replay(new_steps, [("sales_mar_drift.csv", mar)])
    assert rerun.count() == 3
    row = rerun.where(F.col("customer_name") == "Acme Corp").first()
    assert str(row["revenue"]) == "1750.000"
    assert str(row["order_date"]) == "2026-03-04"


def test_run_log_appends(spark, tmp_path):
    jan = _load(spark, tmp_path, "sales_jan.csv", SALES_JAN)
    steps = [{"op": "map_column", "from": c, "to": c.lower().replace(" ", "_")} for c in jan.columns
             if c != "source_file"]
    runs = str(tmp_path / "runs")
    cat_jan = _catalog(jan, 0)
    drift.apply_skill(steps, [("sales_jan.csv", jan)], cat_jan, runs_path=runs)
    drift.apply_skill(steps[:2], [("sales_jan.csv", jan)], cat_jan, runs_path=runs)
    log = commits.read_runs(spark, runs)
    assert sorted((r["status"], r["n_inputs"]) for r in log.collect()) == [("drift_mappable", 1), ("ok", 1)]
    reports = commits.read_reports(spark, runs)
    drifted = log.where(F.col("status") == "drift_mappable").select("run_id")
    assert [r["kind"] for r in reports.join(drifted, "run_id").collect()] == ["mappable"]


def test_lake_path(spark, tmp_path):
    """All three exports of different shapes through the grid path in one job."""
    from tessera.plans.lake import lake_catalog, unify_lake

    d = tmp_path / "lake"
    d.mkdir()
    paths = [write_text(d, n, t) for n, t in [("sales_jan.csv", SALES_JAN), ("sales_feb_zh.csv", SALES_FEB_ZH),
                                               ("sales_mar_drift.csv", SALES_MAR_DRIFT)]]
    rows, headers, c = lake_catalog(spark, paths)
    assert headers.count() == 3 and rows.count() == 13
    table, memory = unify_lake(spark, paths)
    assert table.columns == ["country", "customer_name", "email", "order_date", "phone", "revenue", "source_file"]
    assert table.count() == 13
    assert memory.select("fingerprint").distinct().count() == 3
    mar = table.where(F.col("source_file").endswith("sales_mar_drift.csv")).orderBy("order_date").first()
    assert (mar["customer_name"], mar["revenue"], mar["order_date"]) == ("Acme Corp", "1750.00", "2026-03-04T00:00:00")


def test_remap_skill_closes_the_loop(spark, tmp_path):
    jan = _load(spark, tmp_path, "sales_jan.csv", SALES_JAN)
    mar = _load(spark, tmp_path, "sales_mar_drift.csv", SALES_MAR_DRIFT)
    steps = [{"op": "map_column", "from": "Cust Name", "to": "customer_name"},
             {"op": "map_column", "from": "Amount USD", "to": "revenue"},
             {"op": "cast", "column": "revenue", "type": "DECIMAL"}]
    mar_cat = _catalog(mar, 0)
    proposal = drift.propose_remap(mar_cat)
    out = drift.remap_skill(steps, proposal, [("sales_mar_drift.csv", mar)], mar_cat,
                            confirmed_at="2026-03-31 00:00:00")
    assert [s["from"] for s in out["steps"] if s["op"] == "map_column"][:1] == ["Customer"]
    assert out["steps"][-1] == {"op": "cast", "column": "revenue", "type": "DECIMAL"}
    assert out["fingerprint"] == cat.fingerprints(mar_cat).first()["fingerprint"]
    assert out["memory"].where(F.col("source_col") == "Revenue USD").first()["to"] == "revenue"
    assert out["result"].count() == 3
    assert sorted(str(r["revenue"]) for r in out["result"].collect()) == ["1020.000", "1750.000", "3100.400"]
    assert jan.count() == 5
