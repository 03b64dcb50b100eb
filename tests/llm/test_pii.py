"""Personal data: base rules against plain ones, the tagger against its gradient and on held-out windows."""

import hashlib
import random
import time
import re
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import pii, queries
from tessera.llm.pii import KINDS, STRIDE, TAGS, WIDTH, Tagger, added_spans, base_spans, digest, find_personal_data, labelled, made_windows, plausible, reconcile, train, windows

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, base string, spans int"


def plain(text: str) -> list[tuple]:
    """The contract's words, one rule after another."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(int(p) for p in m[0].split(".")) <= 255:
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


@pytest.fixture(scope="module")
def tagger(spark):
    return train(spark.read.parquet(f"{DIR}/documents.parquet"))


@pytest.mark.parametrize("text", ["", "a@b", "x@y.z@w.v", "1.2.3.4.5", "256.1.1.1 1.2.3", "0004.1.2.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
                                  "+1 (235) 555-3833 x +12", "é\U0001f600 a.b%c@d-e.f.g", "1" * 5000, "٣٣٣@x.y +٣"])
def test_base(text):
    assert sorted(base_spans(text)) == plain(text)


def test_base_on_random_texts():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choices(["1", "22", "4111", "255", "300", ".", "@", "-", " ", "+", "(", ")", "a", "b.c", "é"], k=rnd.randrange(25)))
        assert sorted(base_spans(text)) == plain(text)


def test_gradient():
    tagger, made = Tagger(1), made_windows(["some plain words here"], 8)
    ids, tags = labelled([], made)
    _, grad = tagger.gradient(ids, tags)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = tagger.p[name][at]
        tagger.p[name][at] = kept + 1e-4
        more = tagger.gradient(ids, tags)[0]
        tagger.p[name][at] = kept - 1e-4
        less = tagger.gradient(ids, tags)[0]
        tagger.p[name][at] = kept
        assert (more - less) / 2e-4 == pytest.approx(g[at], rel=1e-3)


def test_best_path_and_posteriors_by_enumeration():
    rnd = np.random.default_rng(2)
    tagger = Tagger(2)
    tagger.p["move"] = rnd.normal(0, 1, (TAGS, TAGS))
    scores, mask = rnd.normal(0, 1, (3, 1, TAGS)), np.ones((3, 1), bool)
    move, first = tagger._moves()
    paths = {(a, b, c): first[a] + scores[0, 0, a] + move[a, b] + scores[1, 0, b] + move[b, c] + scores[2, 0, c] for a in range(TAGS) for b in range(TAGS) for c in range(TAGS)}
    total, marginal, _ = tagger.posteriors(scores, mask)
    weight = np.array(list(paths.values()))
    assert total[0] == pytest.approx(np.log(np.exp(weight - weight.max()).sum()) + weight.max())
    p = np.exp(weight - total[0])
    assert marginal[1, 0, 3] == pytest.approx(sum(q for (_, b, _), q in zip(paths, p) if b == 3))


def test_windows_cover_every_anchor():
    text = "x" * 100 + "7" + "y" * 500 + "@" + "z" * 30
    for a in (100, 601):
        assert any(s <= a < s + WIDTH for s in windows(text)) and all(s % STRIDE == 0 for s in windows(text))
    assert windows("no anchor " * 50) == [] and windows("7") == [0]


def test_reconcile_by_enumeration():
    rnd = random.Random(8)
    for _ in range(60):
        found = [((rnd.randrange(4), a := rnd.randrange(20), a + rnd.randrange(1, 8)), rnd.random()) for _ in range(rnd.randrange(9))]
        best = {}
        for s, c in found:
            best[s] = max(best.get(s, 0), c)
        free = lambda part: all(x[2] <= y[1] or y[2] <= x[1] for x, y in combinations(part, 2))
        value = lambda part: sum(best[s] * (s[2] - s[1]) for s in part)
        most = max(value(p) for n in range(len(best) + 1) for p in combinations(best, n) if free(p))
        got = reconcile(found)
        assert free(got) and value(got) == pytest.approx(most)


def test_the_model_alone_finds_held_out_data(spark, tagger):
    rows = [(t, s) for t, s in made_windows(["plain words that stand around such data in a text"], 300, seed=99)]
    hit = want = extra = 0
    for (text, spans), found in zip(rows, tagger.decode([t for t, _ in rows])):
        whole = {s for s in spans if s[1] >= 0 and s[2] <= len(text) and (s[2] < WIDTH)}
        mine = {s for s, sure in found if sure >= pii.CONFIDENCE}
        hit, want, extra = hit + len(whole & mine), want + len(whole), extra + len([s for s in mine if s not in spans])
    assert hit / want > 0.75 and extra / want < 0.25


def test_added_spans_are_plausible_and_apart(tagger):
    texts = ["reach (415) 555-0132 or 212-555-0187 by day", "nothing of the kind, on 2024-01-15 for 1,234.50", "4690149265297988 is no card",
             "write to anna@mail3.example.com or +1 (415) 555-0132"]
    for text, spans in zip(texts, added_spans(tagger, texts)):
        base = base_spans(text)
        assert all(plausible(k, text[a:b]) and not any(x < b and a < y for _, x, y in base) for k, a, b in spans)
    assert added_spans(tagger, texts)[1] == [] and added_spans(tagger, texts)[2] == []
    assert any(added_spans(tagger, texts)[0])


def test_runs_without_a_blank_take_linear_time():
    began = time.time()
    n = 300_000
    for text in ("1" * n, "a" * n + " x@y", "a" * n + "@b.c", "1." * n, "@" * n, "a@" * n, "a@b" * n, "a@b." * n, "+1" * n, "1 " * n, "1" * n + ".2.3.4", "a.b@c-" * n):
        base_spans(text)
    assert base_spans("a" * n + "@b.c") == [(0, 0, n + 4)]
    assert time.time() - began < 20


def test_long_spans_are_found_wherever_they_begin(tagger):
    """A spelled-out address longer than a window's overlap, at every place of two strides."""
    span = "firstname.lastname (at) department (dot) university (dot) example (dot) org"
    assert len(span) > pii.STRIDE
    texts = [("words " * 40)[:k + 60] + "see " + span + " for more" + " of these words" * 20 for k in range(0, 96)]
    hits = 0
    for text, spans in zip(texts, added_spans(tagger, texts)):
        a = text.index(span)
        hits += (0, a, a + len(span)) in spans
    assert hits >= 0.9 * len(texts), hits


def test_planted_forms_are_found_in_whole_documents(spark, tagger):
    """Recall and precision of what the model adds, on documents with planted data in forms
    that the rules do not reach."""
    rnd = random.Random(12)
    docs = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").limit(300).collect() if r.text and len(r.text) > 400]
    word = lambda: "".join(rnd.choices("abcdefghiklmnoprstu", k=rnd.randint(4, 9)))
    digits = lambda k: "".join(rnd.choices("0123456789", k=k))
    forms = [lambda: (0, f"{word()}.{word()} (at) {word()} (dot) com"), lambda: (0, f"{word()} [at] {word()} [dot] org"),
             lambda: (3, f"({digits(3)}) {digits(3)}-{digits(4)}"), lambda: (3, f"{digits(3)}-{digits(3)}-{digits(4)}")]
    texts, want = [], []
    for text in docs[:150]:
        kind, piece = rnd.choice(forms)()
        cut = text.find(" ", rnd.randrange(len(text) - 100))
        cut = cut if cut > 0 else 0
        texts.append(text[:cut] + " " + piece + " " + text[cut:])
        want.append((kind, cut + 1, cut + 1 + len(piece)))
    found = added_spans(tagger, texts)
    hit = sum(w in f for w, f in zip(want, found))
    extra = sum(len(f) for f in found) - hit
    assert hit >= 0.9 * len(want) and extra <= 0.1 * len(want), (hit, extra, len(want))


def test_rows(spark, tagger):
    long = "word " * 30_000 + "a@b.cd " + "word " * 100
    rows = [(1, "mail x@y.zz", "", 0), (1, "mail x@y.zz", "", 0), (None, "+49 30 1234567", None, None), (2, None, "q", 1), (3, "", "q", 1), (4, long, "q", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, digest(find_personal_data(df, tagger)).collect()), key=str)
    assert [g[0] for g in got] == sorted([r[0] for r in rows], key=lambda i: str((i,)))
    assert ("email:150000:150006") in [g[-1] for g in got]
    assert digest(find_personal_data(df.limit(0), tagger)).collect() == []
    assert train(df.limit(0), rounds=1) is not None


def test_query_on_the_whole_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_personal_data"](spark, DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        told = [f"{KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert tuple(r)[1:5] == tuple(sum(k == n for k, _, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r.spans.split(","))
    more = sum(len(r.spans.split(",")) if r.spans else 0 for r in rows) - sum(sum(tuple(r)[1:5]) for r in rows)
    assert more <= 5
