"""Kneser-Ney probabilities against their textbook form; decisions on held-out labels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import quality, queries
from tessera.llm.quality import ANY, ORDER, Model, keep_good, score, train

WORDS = {"en": "the cat sat on mat and dog ran far off".split(), "de": "der hund lief weit und die katze blieb hier".split()}


def corpus(n: int, seed: int = 0) -> list[tuple]:
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS[lang := rnd.choice(["en", "de"])], k=rnd.randrange(5, 40))), lang, "x") for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, keep string"


@pytest.fixture(scope="module")
def model(spark) -> Model:
    docs = spark.createDataFrame(corpus(300), SCHEMA)
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    return train(docs, labels.union(labels))


def plain(texts: list[str], encode) -> tuple[dict, dict]:
    """Counts by size, each of the n-grams of symbols, and discounts by size."""
    start = [0] * (ORDER - 1)
    top = Counter()
    for t in texts:
        s = start + encode(t)
        top.update(tuple(s[i:i + ORDER]) for i in range(len(s) - ORDER + 1))
    counts = {ORDER: top}
    for size in range(ORDER - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
    discounts = {}
    for size, c in counts.items():
        n = Counter(min(v, 5) for v in c.values())
        ds = []
        for k in (1, 2, 3):
            if n[k] and n[1] + 2 * n[2]:
                ds.append(max(0.1, min(k - 0.1, k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k])))
            else:
                ds.append(0.5)
        discounts[size] = ds
    return counts, discounts


def test_probabilities(spark, monkeypatch):
    rows = corpus(40, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(quality, "HELD_OUT", 1 << 40)  # all texts are counted
    model = train(docs, docs.selectExpr("doc_id", "1 as quality", "0 as toxic"))
    encode = lambda t: model.languages[ANY].alphabet.encode(t)[0].tolist()
    counts, discounts = plain([r[1] for r in rows], encode)
    by_context = {size: defaultdict(dict) for size in counts}
    for size, c in counts.items():
        for g, n in c.items():
            by_context[size][g[:-1]][g[-1]] = n

    def p(c: int, context: tuple, size: int) -> float:
        if size == 0:
            return 1 / (1 << quality.BITS)
        seen = by_context[size].get(context)
        shorter = p(c, context[1:], size - 1)
        if not seen:
            return shorter
        d = lambda n: discounts[size][min(n, 3) - 1]
        total = sum(seen.values())
        own = (seen[c] - d(seen[c])) / total if c in seen else 0.0
        return own + sum(d(n) for n in seen.values()) / total * shorter

    for text in ["the cat", "der dog zzz", "Qé", "𝄞 the", ""]:
        s = [0] * (ORDER - 1) + encode(text)
        want = sum(math.log(p(s[i], tuple(s[i - ORDER + 1:i]), ORDER)) for i in range(ORDER - 1, len(s)))
        assert model.log_probability([text], None)[0] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_rows_of_probabilities_sum_to_one(model):
    for known in model.languages.values():
        assert np.allclose(np.exp(known.tables[1].astype(float)).sum(axis=1), 1, atol=1e-3)


def test_pieces_of_a_long_text_add_up(model, monkeypatch):
    text = corpus(1, 7)[0][1] * 50
    whole = model.log_probability([text, "x", text], "en")
    monkeypatch.setattr(quality, "SEGMENT", 11)
    assert np.allclose(model.log_probability([text, "x", text], "en"), whole, rtol=1e-5)


def test_rows(spark, model):
    rows = [(1, "the cat sat on the mat", "en", "a"), (1, "the cat sat on the mat", "en", "a"), (2, "#~#~ %% QQ ZX" * 30, "en", "b"),
            (3, None, "en", "c"), (4, "", None, "d"), (None, "der hund lief weit", None, None), (5, "die katze blieb hier " * 4_000, "xx", "e")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.length): r.keep for r in score(df, model).collect()}
    assert not got.pop((2, len(rows[2][1]))) and all(got.values())
    kept = keep_good(df, model)
    assert kept.columns == df.columns and sorted(kept.collect(), key=str) == sorted((r for r in df.collect() if r.doc_id != 2), key=str)
    assert score(df.limit(0), model).collect() == []


def test_without_trusted_texts_all_stay(spark):
    df = spark.createDataFrame(corpus(5), SCHEMA)
    none = df.selectExpr("doc_id", "0 as quality", "0 as toxic")
    assert keep_good(df, train(df, none)).count() == 5
    assert train(df.limit(0), none.limit(0)).languages == {}


def test_a_rare_language_uses_the_model_over_all(model):
    assert set(model.languages) == {"en", "de", ANY}
    assert model.of("fr") is model.languages[ANY] and model.of(None) is model.languages[ANY]


def test_query_on_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op3_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality], [r.keep for r in rows if not r.quality]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


HAN = [chr(0x4E00 + i) for i in range(3_000)]


def han(n: int, first: int, seed: int = 1) -> list[tuple]:
    """Texts of two-character words that share no character, over 3,000 characters."""
    rnd = random.Random(seed)
    words = [HAN[i] + HAN[i + 1] for i in range(0, 3_000, 2)]
    return [(first + i, "".join(rnd.choices(words, k=200)), "zh", "x") for i in range(n)]


def labelled(df):
    return df.selectExpr("doc_id", "1 as quality", "0 as toxic")


def test_a_script_of_thousands_of_characters(spark):
    df = spark.createDataFrame(corpus(300) + han(400, 1_000), SCHEMA)
    model = train(df, labelled(df))
    assert set(model.languages) == {"en", "de", "zh", ANY}
    alphabet = model.languages["zh"].alphabet
    assert len({tuple(alphabet.encode(c)[0]) for c in HAN}) == len(HAN)
    rnd = random.Random(5)
    clean = han(30, 1, seed=9)
    shuffled = [(100 + i, "".join(rnd.sample(r[1], len(r[1]))), "zh", "x") for i, r in enumerate(clean)]
    got = score(spark.createDataFrame(clean + shuffled, SCHEMA), model).collect()
    assert all(r.keep == (r.doc_id < 100) and r.model == "zh" for r in got)


def test_pieces_of_texts_with_pairs_add_up(spark, monkeypatch):
    df = spark.createDataFrame(han(40, 0), SCHEMA)
    known = train(df, labelled(df)).languages[ANY]
    texts = [han(1, 0, seed=3)[0][1], "the 𝄞", "", "é" * 30]
    whole = known.log_probability(texts)
    monkeypatch.setattr(quality, "SEGMENT", 7)
    assert np.allclose(known.log_probability(texts), whole, rtol=1e-5)


def test_counts_do_not_depend_on_the_cut(spark, monkeypatch):
    df = spark.createDataFrame(han(3, 0) + corpus(3), SCHEMA).select("lang", "text")
    alphabets = quality._alphabets(df)
    counts = lambda: sorted(map(tuple, quality._top_counts(df, alphabets).collect()))
    whole = counts()
    for name in ("zh", ANY):
        own = [r.text for r in df.collect() if name in (ANY, r.lang)]
        by_hand, _ = plain(own, lambda t: alphabets[name].encode(t)[0].tolist())
        want = {sum(x << quality.BITS * (ORDER - 1 - i) for i, x in enumerate(g)): n for g, n in by_hand[ORDER].items()}
        assert {g: n for lang, g, n in whole if lang == name} == want
    text = han(1, 0)[0][1]
    monkeypatch.setattr(quality, "SEGMENT", 5)
    pieces = [p for _, ps in quality._segments([text]) for p in ps]
    assert "".join(p[ORDER - 1:] for p in pieces) == text
    grams = Counter()
    for piece in pieces:
        symbols, at = alphabets["zh"].encode(piece)
        grams.update(quality._keys(symbols, ORDER)[at[ORDER - 1] - ORDER + 1:].tolist())
    assert sum(grams.values()) == len(alphabets["zh"].encode(text)[0])


def test_the_sample_is_bounded_in_each_language(spark):
    """A language that is a few hundredths of a large sample keeps its model and threshold,
    and thresholds come from all held-out texts whatever the sample."""
    many = corpus(2_000)
    rare = [(10_000 + i, t.upper(), "up", "x") for i, t, _, _ in corpus(120, 4)]
    df = spark.createDataFrame(many + rare, SCHEMA)
    model = train(df, labelled(df), max_docs=60)
    assert set(model.languages) == {"en", "de", "up", ANY}
    got = score(df, model).collect()
    assert sum(r.keep for r in got) / len(got) > 0.98 and {r.model for r in got if r.lang == "up"} == {"up"}


def test_clean_texts_of_a_language_with_few_labels_stay(spark):
    rare = [(10_000 + i, t.swapcase(), "up", "x") for i, t, _, _ in corpus(30, 4)]
    df = spark.createDataFrame(corpus(600) + rare, SCHEMA)
    model = train(df, labelled(df))
    assert model.limit("up").model == ANY and model.limit("up").threshold >= model.limit(None).threshold
    got = score(df, model).where("lang = 'up'").collect()
    assert all(r.keep and r.model == ANY for r in got)


def test_whole_texts_are_counted(spark):
    late = "the cat sat on the mat " * 2_000 + "žluťoučký kůň"
    df = spark.createDataFrame([(i, late, "en", "x") for i in range(8)], SCHEMA)
    alphabet = train(df, labelled(df)).languages[ANY].alphabet
    assert all(len(alphabet.encode(c)[0]) == 1 for c in "žťčýů")
