"""Mapping memory: proposals, confirmation, reuse gate, flattening."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import mapping as mp

CAT = "source_id string, pos int, name string, type string, source_order int"


@pytest.fixture()
def catalog(spark):
    rows = [("a.csv", 0, "Cust Name", "VARCHAR", 0), ("a.csv", 1, "Amount USD", "VARCHAR", 0),
            ("b.csv", 0, "客户名称", "VARCHAR", 1), ("b.csv", 1, "备注", "VARCHAR", 1)]
    return spark.createDataFrame(rows, CAT)


@pytest.fixture()
def sources(spark):
    return spark.createDataFrame([("a.csv", "h:a", 0), ("b.csv", "h:b", 1)],
                                 "source_id string, fingerprint string, source_order int")


def test_synonyms_and_misses(catalog):
    p = {r["source_col"]: r for r in mp.propose_by_synonyms(catalog).collect()}
    assert p["Cust Name"]["to"] == "customer_name" and p["Amount USD"]["to"] == "revenue"
    assert p["备注"]["to"] is None and p["备注"]["confidence"] == 0.0
    assert p["备注"]["rationale"] == mp.MISS_RATIONALE
    low = mp.low_confidence(mp.propose_by_synonyms(catalog)).collect()
    assert [r["source_col"] for r in low] == ["备注"]


def test_raw_and_canonical(catalog):
    raw = {r["source_col"]: r["to"] for r in mp.propose_raw(catalog).collect()}
    assert raw == {"Cust Name": "Cust Name", "Amount USD": "Amount USD", "客户名称": "客户名称", "备注": "备注"}
    order = [r["name"] for r in mp.raw_canonical(catalog).orderBy("pos").collect()]
    assert order == ["Cust Name", "Amount USD", "客户名称", "备注"]
    canon = [r["name"] for r in mp.canonical_from_mapping(mp.propose_by_synonyms(catalog)).orderBy("pos").collect()]
    assert canon == ["customer_name", "revenue"]


def test_enrich_fills_blanks_only(spark):
    f = spark.createDataFrame([("revenue", "", "", "mine"), ("other", "", "", "")],
                              "name string, type string, desc_en string, desc_zh string")
    got = {r["name"]: r for r in mp.enrich_canonical(f).collect()}
    assert got["revenue"]["type"] == "DECIMAL" and got["revenue"]["desc_zh"] == "mine"
    assert got["other"]["type"] == ""


def test_confirm_reuse_and_flat(spark, catalog, sources):
    hits = mp.propose_by_synonyms(catalog).where(F.col("to").isNotNull())
    proposal = mp.backfill_unmapped(hits, catalog)
    assert proposal.count() == 4
    assert proposal.where(F.col("rationale") == mp.BACKFILL_RATIONALE).count() == 1

    only_a = mp.confirm_mapping(proposal, catalog.where("source_id = 'a.csv'"), sources.where("source_id = 'a.csv'"))
    assert mp.reuse_confirmed(sources, catalog, only_a) is None
    with pytest.raises(mp.MappingNotConfirmed):
        mp.flat_mapping(sources, only_a)

    memory = mp.confirm_mapping(proposal, catalog, sources, memory=only_a, confirmed_at="2026-02-01 00:00:00")
    assert memory.select("fingerprint").distinct().count() == 2
    reused = {r["source_col"]: r["to"] for r in mp.reuse_confirmed(sources, catalog, memory).collect()}
    assert reused["客户名称"] == "customer_name" and reused["备注"] is None
    flat = {r["source_col"]: r["to"] for r in mp.flat_mapping(sources, memory).collect()}
    assert flat == {"Cust Name": "customer_name", "Amount USD": "revenue", "客户名称": "customer_name"}


def test_nothing_mapped_is_an_error(spark, catalog, sources):
    proposal = mp.backfill_unmapped(mp.propose_by_synonyms(catalog).where("false"), catalog)
    memory = mp.confirm_mapping(proposal, catalog, sources)
    with pytest.raises(mp.MappingNotConfirmed, match="no confirmed"):
        mp.flat_mapping(sources, memory)


def test_union_of_frames_and_of_grids_agree_on_entry_order(spark):
    """Two columns of one file map to one field, in either order (U1 = U2)."""
    from pyspark.sql import functions as F

    from tessera.operators import catalog as cat
    from tessera.operators import mapping as mp
    from tessera.operators.unify import unify, unify_grid

    files = {"a.csv": (["Revenue", "Amount"], ["1", "2"]), "b.csv": (["Amount", "Revenue", "Country"], ["20", "10", "x"])}
    headers = spark.createDataFrame([(f, h, i) for i, (f, (h, _)) in enumerate(files.items())], "source_file string, header array<string>, source_order int")
    catalog = headers.select(F.col("source_file").alias("source_id"), "source_order", F.posexplode("header").alias("pos", "name")).withColumn("type", F.lit("VARCHAR"))
    sources = cat.fingerprints(catalog).join(headers.select(F.col("source_file").alias("source_id"), "source_order"), "source_id")
    flat = mp.flat_mapping(sources, mp.confirm_mapping(mp.propose_by_synonyms(catalog), catalog, sources))
    grid = spark.createDataFrame([(f, 1, r) for f, (_, r) in files.items()], "source_file string, row_no int, cells array<string>")
    by_grid = unify_grid(grid, headers, flat).select("country", "revenue", "source_file")
    entries = [(r["source_col"], r["to"]) for r in flat.orderBy("ord").collect()]
    frames = [(f, spark.createDataFrame([tuple(r)], ", ".join(f"{c} string" for c in h))) for f, (h, r) in files.items()]
    want = sorted(map(tuple, unify(frames, entries).select("country", "revenue", "source_file").collect()), key=str)
    assert sorted(map(tuple, by_grid.collect()), key=str) == want == sorted([(None, "1", "a.csv"), ("x", "10", "b.csv")], key=str)


def test_hand_typed_fields_are_kept(spark):
    from tessera.operators import mapping as mp

    prop = spark.createDataFrame([("Foo", "my_field"), ("Rev", "revenue"), ("X", None)], "source_col string, to string")
    got = {r["name"]: (r["pos"], r["type"]) for r in mp.canonical_from_mapping(prop).collect()}
    assert got == {"my_field": (0, "VARCHAR"), "revenue": (1, "DECIMAL")}
    fields = spark.createDataFrame([(0, "revenue", "DECIMAL", "", ""), (1, "zip", "VARCHAR", "", "")], "pos int, name string, type string, desc_en string, desc_zh string")
    joined = [(r["pos"], r["name"]) for r in mp.join_canonical(fields, prop).orderBy("pos").collect()]
    assert joined == [(0, "revenue"), (1, "zip"), (2, "my_field")]
