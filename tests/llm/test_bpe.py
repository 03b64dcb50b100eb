"""Own BPE against the tiktoken library, on odd texts and on whole tables."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries
from tessera.llm.bpe import RANKS, RankQueue, decode_documents, encode_documents, encoder, round_trip

LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANKS), "rb"))})


def ids(text: str) -> list[int]:
    return np.frombuffer(encoder().encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", [
    "", " ", "a", "  a  b \n\n c ", "it's we'll I'd", "x" * 5_000, "ab" * 3_000 + "é" * 2_000, "日本語テキスト 中文", "\x1c \x85 x",
    "<|endoftext|>", "á \U0001f600\U0001f468‍\U0001f469", "tab\there  \t ", "12345 67.89", "thethethe" * 900])
def test_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert encoder().decode(encoder().encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_a_very_long_pre_token_is_linear():
    text = "".join(random.Random(1).choices("abcdeé", k=200_000))
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_queue_gives_lowest_rank_first():
    rnd, q, held = random.Random(3), RankQueue(300_000), {}
    for _ in range(3_000):
        if rnd.random() < 0.6:
            r, p = rnd.randrange(300_000), rnd.randrange(99)
            q.push(r, p)
            held.setdefault(r, []).append(p)
        elif held:
            r = min(held)
            assert q.pop() == (r, held.pop(r))
    while held:
        r = min(held)
        assert q.pop() == (r, held.pop(r))
    assert q.pop() is None


def test_rows(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, "n"), (2, "", None), (3, "y" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = encode_documents(df)
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in decode_documents(enc).collect()) == sorted((i or -1, (t or "").encode()) for i, t, _ in rows)
    assert round_trip(df.limit(0)).collect() == []


def test_query_on_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op5_byte_bpe"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        want = np.array(LIBRARY.encode_ordinary(r.text or ""), "<u4")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
