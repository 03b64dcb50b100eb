"""Language-model scores: counts by hand, a distribution that sums to one, held-out gain."""

import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from tessera.llm import mixing, queries
from tessera.llm.mixing import Mixer, blocks, contexts, decisions, score, spelled, words_of

SCHEMA = "doc_id long, text string, score string, key int"


def plain(rows):
    """Base columns of each row."""
    def tokens(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for blank in "\t\n\x0b\x0c\r":
            t = t.replace(blank, " ")
        return [w for w in t.split(" ") if w] + [""]

    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t, *_ in rows:
        mine = tokens(t)
        yield i, held(i), len(mine), sum(c[w] > 0 for w in mine), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in mine)


def same(got, rows):
    key = lambda r: tuple((x is not None, x) for x in r[:5]) + (round(r[5], 4),)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(plain(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] < 0 and math.isfinite(a[6])
        size = len((dict((r[0], r[1]) for r in rows)[a[0]] or "").encode()) if sum(r[0] == a[0] for r in rows) == 1 else None
        assert size is None or a[7] == pytest.approx(-a[6] * math.log2(10) / max(1, size))


def test_words():
    assert words_of(" A\x0bb Éx\x1cy \n") == ["a".encode(), "b Éx\x1cy".encode()]


def test_looked_up_logits_leave_the_own_occurrence_out():
    rnd = np.random.default_rng(5)
    zeros, ones = rnd.integers(0, 40, (2, mixing.INPUTS, 1 << mixing.SLOT_BITS))
    mixer = Mixer.new((zeros + 256 * ones).astype("<u2"))
    at = [rnd.integers(0, 1 << mixing.SLOT_BITS, 500) for _ in range(mixing.INPUTS)]
    bit = rnd.integers(0, 2, 500)
    for own in (None, bit):
        x, gate = mixer.inputs(at, own)
        levels = []
        for k in range(mixing.INPUTS):
            a, b = ones[k][at[k]], zeros[k][at[k]]
            if own is not None:
                a, b = np.maximum(a - bit, 0), np.maximum(b - (1 - bit), 0)
            assert np.allclose(x[k], np.log((a + 0.2) / (b + 0.2)), atol=1e-6)
            levels.append((a + b > 0) * 1 + (a + b > 2) + (a + b > 20))
        assert (gate == 4 * levels[-2] + levels[-1]).all() and (x[-1] == 1).all()


def test_contexts_are_of_the_word_alone():
    for words in ([b"abcabc", b"", b"abd"], [b"zz", b"abcabc", b"abd", b""]):
        joined, starts = spelled(words)
        at = dict(zip(words, starts.tolist()))
        h = contexts(joined, starts)
        assert (h[:, at[b"abcabc"] + 2] == h[:, at[b"abd"] + 2]).all()
        assert h[0, at[b"abcabc"] + 1] == h[0, at[b"abcabc"] + 4] and h[5, at[b"abcabc"] + 1] != h[5, at[b"abcabc"] + 4]
        if words[0] == b"abcabc":
            kept = h[:, at[b"abcabc"]:at[b"abcabc"] + 7]
        else:
            assert (h[:, at[b"abcabc"]:at[b"abcabc"] + 7] == kept).all()


def test_contexts_run_over_words():
    joined = np.frombuffer(b"the cat sat  " + b"the dog sat  ", np.uint8)
    h = contexts(joined, np.array([0, 13]))
    at = 8, 13 + 8  # both "sat", after other words
    assert all((h[k, at[0]] == h[k, at[1]]) == (k in (0, mixing.ORDERS)) for k in range(mixing.INPUTS))
    assert (h[:, :4] == h[:, 13:17]).all()  # a text's start sees nothing of the text before
    assert (h[mixing.ORDERS + 1, at[0] + 3] != h[mixing.ORDERS + 1, at[1] + 3])


def test_blocks_cut_no_context():
    rnd = random.Random(2)
    texts = [[bytes(rnd.choices(b"ab", k=rnd.randrange(1, 5))) for _ in range(rnd.choice([0, 1, 30, 400]))] for _ in range(30)]
    texts += [[b"y" * 300, b"a"], []]
    whole = {}
    for block in blocks(texts, 1 << 30):
        whole = {i: contexts(block.joined, block.starts)[:, a:b] for i, a, b in zip(block.owners, block.starts, [*block.starts[1:], len(block.joined)])}
    parts = {}
    for block in blocks(texts, 100):
        h = contexts(block.joined, block.starts)
        for i, a, b in zip(block.owners, block.starts, [*block.starts[1:], len(block.joined)]):
            parts.setdefault(i, []).append(h[:, max(a, block.skip):b])
    assert sorted(whole) == sorted(parts) == list(range(len(texts)))
    assert all((np.concatenate(parts[i], axis=1) == whole[i]).all() for i in whole)
    assert sum(len(b.joined) - b.skip for b in blocks(texts, 100)) == sum(sum(len(w) + 1 for w in t) + 1 for t in texts)


def test_neighbours_count(spark):
    """The order of words is learned: a text in a known order is likelier than the same words in another one."""
    rnd = random.Random(4)
    turns = ["a b c d", "b c d a"]
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, " ".join(rnd.choices(turns, k=8)), "", 0) for i in range(400) if i not in held]
    rows += [(held[0], "a b c d a b c d", "", 0), (held[1], "d c b a d c b a", "", 0)]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 3


def test_next_byte_probabilities_sum_to_one(monkeypatch):
    rnd = np.random.default_rng(3)
    size = 1 << mixing.SLOT_BITS
    mixer = Mixer.new((rnd.integers(0, 5, (mixing.INPUTS, size)) + 256 * rnd.integers(0, 5, (mixing.INPUTS, size))).astype("<u2"))
    mixer.weights = rnd.normal(0.3, 0.2, mixer.weights.shape)
    total = 0.0
    for byte in range(256):
        joined = np.frombuffer(b"wor" + bytes([byte]), np.uint8)
        p = 1.0
        for at, bit in decisions(joined, np.array([0])):
            x, gate = mixer.inputs(at, None)
            one = mixer.refined(mixer.mixed(x, gate), gate)[-1]
            p *= one if bit[-1] else 1 - one
        total += p
    assert total == pytest.approx(1)


@pytest.mark.parametrize("hot_words", [1, 10, 100_000])
def test_rows(spark, hot_words):
    rnd = random.Random(hot_words)
    rows = [(i, " ".join(rnd.choices(["the", "The", "a", "cat", "dog", "é", f"w{i}"], k=rnd.randrange(12))), "x", 0) for i in range(150)]
    rows += [(None, "null id", None, 1), (7, None, "", 1), (8, "", "", 1), (9, "same row", "", 1), (9, "same row", "", 1), (9, "other text", "", 1), (11, "y" * 100_000 + " " + "the " * 20_000, "", 1)]
    same(score(spark.createDataFrame(rows, SCHEMA).repartition(3), hot_words=hot_words).collect(), rows)


def test_a_batch_is_scored_in_parts_of_bounded_text(monkeypatch):
    """The words of a whole batch took hundreds of MB a task."""
    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(mixing, "BATCH_BYTES", 20_000)
    rnd = random.Random(6)
    texts = [None, "", "z" * 50_000, *(" ".join(rnd.choices(["ab", "cd", "e"], k=rnd.randrange(900))) for _ in range(60)), None]
    mixer = Mixer.new(rnd_pairs := np.random.default_rng(6).integers(0, 9, (mixing.INPUTS, 1 << mixing.SLOT_BITS)).astype("<u2"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts, pa.string())], names=["doc_id", "held", "text"])
    hot = SimpleNamespace(value=([b"ab", b""], np.array([5.0, 7.0])))
    parts = list(mixing._sums(hot, mixer, SimpleNamespace(value=rnd_pairs), "doc_id")(iter([batch, batch.slice(0, 0)])))
    sizes = [[len(texts[i] or "") for i in part["doc_id"].to_pylist()] for part in parts]
    assert len(parts) > 3 and all(sum(size) <= 20_000 + max(size) for size in sizes)
    got = pa.Table.from_batches(parts)
    assert got["doc_id"].to_pylist() == list(range(len(texts))) and len(set(got["key"].to_pylist())) == len(texts)
    assert np.allclose(got["score"].to_numpy(), mixer.log10([words_of(t or "") for t in texts]), rtol=1e-9)


def test_parts_of_a_block_give_the_same(monkeypatch):
    """Weights, maps and scores do not depend on how many bytes are worked on at a time."""
    rnd = random.Random(8)
    texts = [[rnd.choice([b"the", b"cat", b"sat", b"on"]) for _ in range(rnd.randrange(300))] for _ in range(20)] + [[]]
    pairs = np.random.default_rng(8).integers(0, 9, (mixing.INPUTS, 1 << mixing.SLOT_BITS)).astype("<u2") * 257
    found = []
    for most in (1 << 30, 1000):
        monkeypatch.setattr(mixing, "PART_BYTES", most)
        mixer = Mixer.new(pairs)
        used = sum(mixer.learn(block) for block in blocks(texts))
        found.append((used, mixer.weights, mixer.seen.sum(axis=1), mixer.log10(texts)))
    size = sum(sum(len(w) + 1 for w in t) + 1 for t in texts)
    assert found[0][0].sum() == 8 * size and (found[0][0] == found[1][0]).all() and (found[0][2] == found[1][2]).all()
    assert np.allclose(found[0][1], found[1][1], atol=1e-5) and np.allclose(found[0][3], found[1][3], rtol=1e-4)


def test_packed_tables_give_what_each_slot_does():
    """A half's four decisions are read at once; logits, gates, weights, maps and scores are those of single slots."""
    rnd, dice = random.Random(9), np.random.default_rng(9)
    pairs = dice.integers(0, 30, (mixing.INPUTS, 1 << mixing.SLOT_BITS)) + 256 * dice.integers(0, 30, (mixing.INPUTS, 1 << mixing.SLOT_BITS))
    pairs[dice.random(pairs.shape) < 0.3] = 0
    mixer = Mixer.new(pairs.astype("<u2"))
    texts = [[rnd.choice([b"the", b"cat", "\u00e9".encode(), b"on"]) for _ in range(rnd.randrange(60))] for _ in range(20)] + [[]]
    block, = blocks(texts)
    plain = list(decisions(block.joined, block.starts))
    for own in (True, False):
        table = mixing._pack(mixer.pairs, own)
        for k, parts in enumerate(mixing.halves(block.joined, block.starts)):
            (_, leaves, half), = parts
            x, gate, bit = mixer.packed(table, leaves, half)
            for j, (at, want) in enumerate(plain[4 * k:4 * k + 4]):
                logits, gates = mixer.inputs(at, want if own else None)
                assert (mixing.LOGITS[x[:, j::4]] == logits[:-1]).all()
                assert (gate[j::4] == gates).all() and (bit[j::4] == want).all()
    twin = Mixer.new(mixer.pairs)
    mixer.learn(block)
    for first in (0, 4):
        step, amount = np.zeros_like(twin.weights, "f8"), np.zeros(mixing.GATES)
        for at, bit in plain[first:first + 4]:
            x, gate = twin.inputs(at, bit)
            error = bit - 1 / (1 + np.exp(-twin.mixed(x, gate)))
            for g in range(mixing.GATES):
                step[g] += x[:, gate == g] @ error[gate == g]
                amount[g] += (gate == g).sum()
        twin.weights += mixing.RATE * np.clip(step / np.maximum(amount, 1)[:, None], -2, 2).astype("f4")
    assert np.allclose(mixer.weights, twin.weights, atol=1e-6) and mixer.seen.sum() == 8 * len(block.joined)
    want = np.zeros(len(block.joined))
    for at, bit in plain:
        x, gate = mixer.inputs(at, None, len(bit))
        one = mixer.refined(mixer.mixed(x, gate), gate)
        want += np.log10(np.where(bit, one, 1 - one))
    assert np.allclose(mixer.log10(texts), np.add.reduceat(want, block.starts), rtol=1e-3)


def test_words_are_counted_in_parts_of_bounded_text(spark):
    rows = [(i, t, "", 0) for i, t in enumerate([None, "", "  A\x0ba b\u00c9 ", "\x1c x\x85y a\n", "a " * 3000, "z" * 9000] * 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {bytes(r.word): (r.c, r.m) for r in mixing.word_counts(docs, "doc_id", "text").collect()}
    trained, every = Counter(), Counter()
    for i, t, *_ in rows:
        mine = [*words_of(t or ""), b""]
        every.update(mine)
        trained.update(mine if zlib.crc32(str(i).encode()) % 5 != 1 else [])
    assert got == {w: (trained[w], n) for w, n in every.items()}


def test_empty_and_all_held_out(spark):
    assert score(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(held, "nothing was learned", "", 0)]
    same(score(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_query_on_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.QUERIES["op8_context_mixing"](spark, d).collect()
    same(got, rows)
    texts = dict(rows)
    held = [r for r in got if r.held_out]
    size = sum(len(" ".join(w.decode() for w in words_of(texts[r.doc_id])).encode()) + 1 for r in held)
    bits = -sum(r.score for r in held) / math.log10(2) / size
    assert bits < 3.4  # per byte; a byte's own frequency gives over four
