"""Closed syncmers against their definition; neighbours against a plain loop."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, syncmers
from tessera.llm.syncmers import ODD, _mixed, anchors, compare_neighbours, edited, fingerprints, likeness, sketch, written


def plain_anchors(text: str, k: int = 16, s: int = 8) -> set[tuple[str, int]]:
    def h(gram: str) -> int:
        x = 0
        for c in gram:
            x = (x * int(ODD) + ord(c)) % (1 << 64)
        return int(_mixed(np.array([x], np.uint64))[0])

    found = set()
    for i in range(len(text) - k + 1):
        inner = [h(text[j:j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.add((text[i:i + k], i))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_anchors_are_the_closed_syncmers(seed, monkeypatch):
    monkeypatch.setattr(syncmers, "BLOCK", 50)
    text = "".join(random.Random(seed).choices("abé \U0001f600", k=300))
    hashes, places = anchors(text)
    assert {(text[p:p + 16], p) for p in places.tolist()} == plain_anchors(text)
    of = {}
    for h, p in zip(hashes.tolist(), places.tolist()):
        assert of.setdefault(text[p:p + 16], h) == h
    assert len(set(of.values())) == len(of)


def test_an_edit_moves_no_other_anchor():
    rnd = random.Random(5)
    a = "".join(rnd.choices("abcdefgh ", k=4000))
    b = a[:2000] + "XYZ" + a[2000:]
    near, far = likeness(sketch(a), sketch(b)), likeness(sketch(a), sketch("".join(rnd.choices("abcdefgh ", k=4000))))
    assert near > 0.85 and far < 0.05 and likeness(sketch(a), sketch(a)) == 1.0
    shuffled = "".join(a[i:i + 400] for i in range(3600, -1, -400))
    assert likeness(sketch(a), sketch(shuffled)) < 0.4  # the same anchors elsewhere


def test_long_texts_and_insertions():
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(n))
    long, other = words(17_000), words(17_000)
    assert len(sketch(long)) > len(long) // 100
    for _ in range(20):
        passage = words(60)
        mine, theirs = ({h for _, h in sketch(t[:50_000] + passage + t[50_000:])} for t in (long, other))
        assert mine & theirs and likeness(sketch(long[:40_000] + passage + long[40_000:]), sketch(other + passage)) > 0
    text = words(600)
    half = len(text) // 2
    assert likeness(sketch(text), sketch(text[:half] + " " + words(10) + " " + text[half:])) > 0.85


def expected(rows):
    rows = sorted(((i is not None, i or 0, t or "", i) for i, t in rows))
    for k, (*_, text, i) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][2]
        changed = edited(text, other)
        assert changed == text[:len(text) - len(text) // 4] + other[:len(text) // 4]
        yield (i, len(text), hashlib.sha256(changed.encode()).hexdigest(), written(sketch(text)), written(sketch(changed)),
               likeness(sketch(text), sketch(changed)), likeness(sketch(text), sketch(other)))


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_neighbours(spark, bucket_rows):
    rnd = random.Random(1)
    rows = [(rnd.randrange(-20, 40), " ".join(rnd.choices(["one", "two", "drei", "é"], k=rnd.randrange(60)))) for _ in range(60)]
    rows += [(None, "no id"), (7, None), (7, ""), (7, "x" * 100_000), (3, "twin"), (3, "twin")]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, n_chars int, fingerprint string").repartition(5)
    got = [tuple(r) for r in compare_neighbours(df, bucket_rows=bucket_rows).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_single_and_none(spark):
    df = spark.createDataFrame([(1, "a single text")], "doc_id long, text string")
    assert [tuple(r) for r in compare_neighbours(df).collect()] == list(expected([(1, "a single text")]))
    assert compare_neighbours(df.limit(0)).collect() == [] and fingerprints(df.limit(0)).collect() == []


def test_query_on_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    got = queries.QUERIES["op7_closed_syncmers"](spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected([tuple(r) for r in docs]))
    assert got.where(F.col("n_chars") > 500).agg(F.avg("near_edited")).first()[0] > 0.5
