"""Chunk-wise ids against the library's own, for both kinds of file."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.common import tokenizer_file
from tessera.llm.textids import text_ids

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def same(name: str, text: str) -> None:
    t = text_ids(tokenizer_file(name))
    got = np.frombuffer(t.encode(text), "<u4").tolist()
    assert got == t.library.encode(text, add_special_tokens=False).ids, (name, text)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("text", ["", " ", "a b", " a  b ", "It's WE'LL\nÀÉ İx ŉ Σας", "x\x1c y\x85z", "<|endoftext|> <|startoftext|>", "é é", "日本 語", "A" * 4000 + " 1234,5", "a  b  c", "\U0001f600 ǅ ß ſ Ĳ"])
def test_texts(name, text):
    same(name, text)


@pytest.mark.parametrize("name, token, token_id", [("byte_bpe_50k.json", "<|endoftext|>", 50256), ("word_bpe_49k.json", "<|endoftext|>", 49407), ("word_bpe_49k.json", "<|startoftext|>", 49406)])
@pytest.mark.parametrize("text", ["{}", "a{}b", "a {} b", "A  {}{} \n{}", "é{}日本 It's"])
def test_added_tokens(name, token, token_id, text):
    """Against the library as it is opened."""
    path, text = tokenizer_file(name), text.format(*[token] * 3)
    got = np.frombuffer(text_ids(path).encode(text), "<u4").tolist()
    assert got == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert got.count(token_id) == text.count(token)


@pytest.mark.parametrize("name", FILES)
def test_a_table(name, spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        same(name, r.text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=50), st.sampled_from(FILES))
def test_any_text(text, name):
    same(name, text)


@settings(max_examples=200, deadline=None)
@given(st.text("abEÉß '\n\t,.1 s", max_size=60), st.sampled_from(FILES))
def test_ordinary_text(text, name):
    same(name, text)
