"""Packing: gapless sequences, whole documents, and best-fit's own result."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import queries
from tessera.llm.common import ranked, tokenizer_file
from tessera.llm.packing import best_fit, pack_documents


def one_by_one(sizes: list[int], capacity: int) -> list[int]:
    """Gaps left by best-fit, documents taken by falling size."""
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_rounds_give_what_one_by_one_gives(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 37, 100])
    sizes = [min(capacity, 1 + int(rnd.expovariate(1 / rnd.choice([3, 20, 60])))) for _ in range(rnd.randrange(1, 300))]
    counts = defaultdict(int)
    for s in sizes:
        counts[s] += 1
    plan = best_fit(dict(counts), capacity)
    used = defaultdict(list)
    for k, (size, rank, each, first, offset) in enumerate(plan):
        end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == size else counts[size]
        for r in range(rank, end):
            used[first + (r - rank) // each].append((offset + (r - rank) % each * size, size))
    gaps = []
    for places in used.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        gaps.append(capacity - at)
    assert sorted(gaps) == one_by_one(sizes, capacity)
    assert sorted(used) == list(range(len(used)))


def verify(rows, texts: dict, capacity: int) -> int:
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    library.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    total = 0
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            part = ids[k * capacity:(k + 1) * capacity]
            assert (r.piece, r.start, r.length) == (k, k * capacity, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert len(by_doc[doc]) == -(-len(ids) // capacity)
    for places in by_seq.values():
        at = 0
        for r in sorted(places, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_seq) <= -(-total // capacity) * 1.02 + 1
    return len(by_seq)


def test_odd_rows(spark):
    texts = {1: "a few words", 2: None, 3: "", 4: "long " * 9000, 5: "same", 6: "same", 7: "same"}
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in texts.items()], "doc_id long, text string, rank string, length int")
    verify(pack_documents(df, 64).collect(), texts, 64)
    assert pack_documents(df.limit(0)).collect() == []
    twice = pack_documents(df.union(df).selectExpr("cast(null as long) doc_id", "text"), 64, keep_ids=True).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in pack_documents(df, 64).collect())
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in twice)


def test_added_tokens_are_those_of_the_library_as_opened(spark):
    texts = ["a<|endoftext|>b", "<|startoftext|> <|endoftext|>", "no such token"]
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.length, r.ids_crc32) for r in rows}
    want = [np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4") for t in texts]
    assert got == {i: (len(ids), zlib.crc32(ids.tobytes())) for i, ids in enumerate(want)}


def test_query_on_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op4_best_fit_packing"](spark, d).collect()
    verify(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}, 2048)


def test_ranks_of_large_groups_go_in_more_parts(spark):
    rows = spark.range(3_000).selectExpr("id", "cast(if(id % 3 = 0, id % 7, 9) as long) as length")
    sizes = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    got = ranked(rows, "length", ["id"], salts=2, sizes=sizes, part_rows=10)
    by_size: dict[int, list[int]] = {}
    for r in got.collect():
        by_size.setdefault(r["length"], []).append(r["rank"])
    assert set(got.columns) == {"length", "id", "rank"}
    assert {k: sorted(v) for k, v in by_size.items()} == {k: list(range(n)) for k, n in sizes.items()}
    plain = ranked(rows, "length", ["id"], salts=2, sizes={9: 5}, part_rows=10)
    assert sorted(plain.where("length = 9").select("rank").toPandas()["rank"]) == list(range(sizes[9]))
