"""Prefix tries against a plain tree of Python tuples."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm.convtrie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 int, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    original = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            original[c].append((t is not None, t or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(v)] for c, v in original.items()}
    whole = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(original.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = (len(members[s]) - 1) * words + sum(saved[x] for x in children[s])
    out = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = conversation_trie(df, **options)
    assert got.columns == COLUMNS and all(t == "bigint" for n, t in got.dtypes if n != "ends_sha256")
    return sorted(map(tuple, got.collect()), key=str)


def lake(seed, convs, first=0):
    rnd = random.Random(seed)
    text = lambda: " ".join(rnd.choice(["a", "b", "ça", "x\ty", "　"]) for _ in range(rnd.randint(0, 3)))
    rows = []
    for c in range(first, first + convs):
        if rnd.random() < 0.15:
            continue
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if t else "user", rnd.choice(["a b", "hot first turn", text()])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, first", [(1, 0), (2, -90)])
def test_equals_a_plain_trie(spark, seed, first):
    rows = lake(seed, 180, first)
    assert run(spark, rows) == plain(rows)


def test_one_conversation_or_one_group_of_copies_may_be_most_rows(spark):
    rows = [(40, t, "user", f"turn {t % 7}") for t in range(900)]  # one long conversation, its prefixes shared
    rows += [(c, t, "user", f"turn {t % 7}") for c in (41, 47, 800) for t in range(c % 11 + 3)]
    rows += [(c, t, "bot", "same words here") for c in range(1000, 1900) for t in range(2)]  # copies in many id ranges
    assert run(spark, rows) == plain(rows)


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(None, 1, "user", "lost"), (5, None, "user", "first"), (5, 0, None, None), (5, 1, "user", ""), (5, 1, "user", ""),
            (5, 1, "assistant", "tie"), (3, 0, "user", "x" * 200_000 + " end"), (61, 0, "user", "only"), (0, 7, "u", "late"), (0, 2, "u", "a\nb")]
    rows += [(c, 0, "user", "short") for c in range(100, 140)]  # h may exceed their turns: turnless, members of the root
    got = run(spark, rows)
    assert got == plain(rows)
    root = [r for r in got if r[1] == 0]
    assert len(root) == 1 and root[0][2] is None and root[0][3] == 44


def test_empty_table(spark):
    assert run(spark, []) == []


def test_other_groupings(spark):
    rows = lake(5, 60)
    alone = run(spark, rows, every=1, heads=1)  # nothing is taken from another conversation
    assert sum(r[3] for r in alone if r[1] == 0) == len({r[0] for r in rows})
