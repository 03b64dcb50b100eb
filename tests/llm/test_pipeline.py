"""The pipeline's stages, one after another, against plain versions."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tessera.llm import quality  # noqa: E402
from tests.llm.test_packing import verify  # noqa: E402
from tests.llm.test_secret_scan import plain as secrets  # noqa: E402
from tests.llm.test_simhash import groups, plain_simhash  # noqa: E402

DIR = "/root/testdata/sf0.01"


def masked(text):
    if text is None:
        return None
    out, at = "", 0
    for s, _, e in secrets(text):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, labels)
    want = {i: r for i, r in rows.items() if model.perplexity([r.text or ""], r.lang)[0] <= model.limit(r.lang).threshold}
    frames, at = [], docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, DIR)
        frames.append(at.persist())
    good, unique, clean, packed = frames
    assert [f.columns for f in frames[:3]] == [docs.columns] * 3
    assert {r.doc_id: r for r in good.collect()} == want
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(trusted & want.keys()) >= 0.97 * len(trusted)
    fps = {i: plain_simhash(r.text or "") for i, r in want.items()}
    first = {min(i for i, f in fps.items() if f in g) for g in groups(list(fps.values()), 2).values()}
    assert {r.doc_id: r for r in unique.collect()} == {i: want[i] for i in first}
    texts = {i: masked(want[i].text) for i in first}
    got = clean.collect()
    assert {r.doc_id: r.text for r in got} == texts
    assert all(r.n_chars == len(r.text) for r in got)
    assert any("[SECRET]" in t for t in texts.values())
    verify(packed.collect(), texts, 2048)


def test_run_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    some = docs.where("n_chars > 1000 and lang = 'en'").first().text
    long = (some + " ") * (150_000 // len(some))
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0), (-2, long, None, None, len(long))], docs.schema)
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("doc_id = -2").count() >= 10 and out.where("doc_id = -1").count() == 1


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["quality_classifier", "near_dedup", "secret_scans", "best_fit_packing"])
def test_names(name):
    assert name in [n for n, _ in corpus_pipeline.STAGES]
