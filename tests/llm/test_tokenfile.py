"""Token files: exact round trip, order, and the odd cases."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import queries, tokenfile
from tessera.llm.common import new_path, tokenizer_file
from tessera.llm.tokenfile import Coding, read_corpus, write_and_read, write_corpus


@pytest.mark.parametrize("size", [300, 65_536, 65_537, 1 << 24, 1 << 32])
def test_coding(size):
    rnd = np.random.default_rng(size)
    coding = Coding(size)
    docs = [np.minimum(rnd.integers(0, size, n), rnd.integers(0, size, n) >> rnd.integers(0, 30, n)).astype("u4") for n in (0, 1, 7, 8, 9, 0, 500, 4)]
    counts = np.array([len(d) for d in docs])
    coded = coding.encode(np.concatenate(docs), counts)
    control, data = (np.frombuffer(b"".join(x), "u1") for x in coded)
    assert (coding.decode(control, data, counts) == np.concatenate(docs)).all()
    assert all(len(d) == sum(1 + (x >= 256) + (x >= 1 << 16) + (x >= 1 << 24) for x in v.tolist()) for d, v in zip(coded[1], docs))
    assert coding.encode(np.zeros(0, "u4"), np.zeros(0, int)) == ([], [])


def verify(rows, docs: list[tuple]) -> None:
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = sorted((i is not None, i or 0, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs)
    got = sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    ids = [r.doc_id if r.doc_id is not None else -(1 << 70) for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_odd_rows(spark):
    docs = [(5, "five words in this text"), (5, "five words in this text"), (5, "other"), (None, "null id"), (-3, None), (9, ""), (7, "long text " * 20_000), (1 << 62, "é")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, bucket int, data string")
    verify(write_and_read(df).collect(), docs)
    assert write_and_read(df.limit(0)).collect() == []


def test_many_files_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 100)
    rnd = random.Random(2)
    docs = [(rnd.randrange(300), " ".join(rnd.choices(["ab", "the", "xyz", "é"], k=rnd.randrange(30)))) for _ in range(700)]
    folder = write_corpus(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), new_path(spark, "t"), file_ids=1_000)
    assert spark.read.parquet(f"{folder}/manifest").count() > 5
    verify(read_corpus(spark, folder).collect(), docs)


def test_frequent_ids_take_one_byte(spark):
    folder = write_corpus(spark.createDataFrame([(k, "common " * 50) for k in range(20)], "doc_id long, text string"), new_path(spark, "t"))
    assert {r.rank for r in spark.read.parquet(f"{folder}/ranks").where("token = 2").collect()} <= set(range(5))


def test_added_tokens_are_those_of_the_library_as_opened(spark):
    texts = ["a<|endoftext|>b", "<|endoftext|> <|endoftext|>", "no such token"]
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = write_and_read(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == dict(enumerate(want))
    assert [r.start for r in sorted(rows, key=lambda r: r.doc_id)] == [0, len(want[0]), len(want[0]) + len(want[1])]


def test_query_on_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op6_token_file"](spark, d).orderBy("doc_id").collect()
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    at = 0
    for r, doc in zip(rows, spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = library.encode(doc.text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
