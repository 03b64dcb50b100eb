"""SimHash near-duplicates against all pairs, and the cases of odd input."""

import random
from itertools import combinations

import pytest
import xxhash

from tessera.llm.simhash import drop_near_duplicates, near_duplicates, near_links, simhash

SCHEMA = "doc_id long, text string, extra string"


def plain_simhash(text: str) -> int:
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace(
            "\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps: list[int], distance: int) -> dict[int, set[int]]:
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(set(fps), 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
            root[find(a)] = find(b)
    out = {}
    for f in fps:
        out.setdefault(find(f), set()).add(f)
    return out


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "A b C d a B c", "Ünï Éa b x", "a " * 40_000])
def test_fingerprint(text):
    assert simhash(text.encode()) == plain_simhash(text)


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("bucket", [2, 64])
def test_links_connect_as_all_pairs_do(spark, distance, bucket):
    rnd = random.Random(distance)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    rows = near_links(df, distance, bucket).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= distance for r in rows)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        root[find(r.a)] = find(r.b)
    got = {}
    for f in fps:
        got.setdefault(find(f), set()).add(f)
    key = lambda g: sorted(map(sorted, g.values()))
    assert key(got) == key(groups(fps, distance))


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base + " end", base, None, "", "  ", "other text altogether here", base.upper(), "x" * 200_000]
    rows = [(10 + i, t, "e") for i, t in enumerate(texts)] + [(10, base, "again")]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {i: plain_simhash(t or "") for i, t, _ in rows}
    for g in groups(list(fps.values()), 2).values():
        ids = [i for i, f in fps.items() if f in g]
        assert {got[i].component_id for i in ids} == {min(ids)}
    assert all(got[i].fp % (1 << 64) == f for i, f in fps.items())


def test_drop_keeps_one_row_of_each_group(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (2, "quite another text", None), (None, "lonely words here now", "z"), (5, None, "n"), (6, "", "m")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted([df.collect()[k] for k in (1, 3, 4, 5)], key=str)


@pytest.mark.parametrize("group_bytes", [64 << 20, 3000])
def test_rows_are_dropped_while_files_are_read(spark, tmp_path, group_bytes):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randint(0, 30)) for _ in range(12)) for _ in range(300)]
    rows = [(rnd.choice([None, *range(900)]), rnd.choice([*texts, None, "one text in very many rows"]), f"e{i}") for i in range(70_000)]
    rows += [(5000 + i, f"text number {i} of its own {i * i}", "own") for i in range(2000)]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(path)
    df = spark.read.parquet(path)
    out = drop_near_duplicates(df, in_place=True, group_bytes=group_bytes)
    kept = out.collect()
    given = df.collect()
    fps = {t: plain_simhash(t or "") for t in {r.text for r in given}}
    group = {f: min(g) for g in groups(sorted(set(fps.values())), 2).values() for f in g}
    by_group = {}
    for r in given:
        by_group.setdefault(group[fps[r.text]], []).append(r)
    assert len(kept) == len(by_group) and set(kept) <= set(given)
    ids = {group[fps[r.text]]: r.doc_id for r in kept}
    assert ids == {g: min((r.doc_id for r in rs if r.doc_id is not None), default=None) for g, rs in by_group.items()}
    if group_bytes == 64 << 20:
        plan = out._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "text" in line]
        assert "BroadcastHashJoin" in plan and not scans


def test_same_id_in_two_groups_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, _file string, _row long, _bits int, _metadata string, fp int"
    rows = [(1, "a b c d", "x", 1, 1, "m", 1), (1, "quite another text", "y", 2, 2, "m", 2), (2, "a b c d", "z", 3, 3, "m", 3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/clash")
    df = spark.read.parquet(f"{tmp_path}/clash")
    for in_place in (True, False):
        out = drop_near_duplicates(df, in_place=in_place)
        assert out.columns == df.columns and sorted(map(tuple, out.collect())) == rows[:2]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).collect() == [] and drop_near_duplicates(df).collect() == []
