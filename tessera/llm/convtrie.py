"""Prefix trie of conversations by whole-sequence collapse.

Conversations are first reduced to narrow rows (place, 128-bit hash of role and text,
words), so texts are read once and never shuffled. A prefix of d turns is identified by
its depth and the 128-bit sum of the hashes of (place, turn) over its turns; such sums
are running sums, which split a conversation of any length over tasks.

1. Identical conversations are grouped into one weighted sequence: weight, smallest id
   (its representative) and the list of ends as ranges of ids.
2. Only representatives keep their prefixes. A sequence that is a proper prefix of
   another one (its end is some row's parent) is dropped by an anti-join; the sequences
   that are left are the leaves.
3. Weighted prefixes are aggregated into nodes. The nodes first met in a sequence (those
   whose smallest member represents it) are the tail of its chain. So a subtree's sum is,
   over the sequences through its top, the sum of their own nodes below the top: two
   aggregates by prefix and one by sequence, whatever the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.operators.sizing import running_sums

#: ASCII blanks: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
LOW = 0xFFFFFFFF
KEY = ["depth", "k1", "k2"]


def narrow_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, t1, t2, words)`` for every row with a conversation id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """Narrow turns with their place ``pos`` (from 0) in their conversation. Null turns
    come first; rows of one turn follow role, then the hash of the text."""
    placed = running_sums(turns, "conv_id", [F.asc_nulls_first("turn"), "role", "t1", "t2"], {"n": F.lit(1)})
    return placed.select("conv_id", (F.col("n") - 1).cast("long").alias("pos"), "t1", "t2", "words")


def head_length(conv_id: str, heads: int) -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % heads


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns taken from conversation
    ``c - c % every`` (all it has if fewer, none if it is absent), h being
    ``crc32(c) % heads``, and c's own turns after its first h. ``turns`` are numbered.
    Returns all conversation ids, and the rebuilt turns numbered anew."""
    counts = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "convs")
    base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    want = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), head_length("conv_id", heads).alias("h"))
    plan = want.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k"))
    plan = stored(plan, "plan")
    own = turns.join(plan, "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "t1", "t2", "words")
    head = turns.where((F.col("pos") < heads - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    head = head.join(plan, "base").where("pos < k").select("conv_id", "pos", "t1", "t2", "words")
    return plan.select("conv_id"), own.unionByName(head)


def _prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: its key, its parent's key and the words of its
    last turn; the empty prefix (depth 0, no parent) included."""
    g = [F.xxhash64(F.lit(seed), "pos", "t1", "t2") for seed in (3, 4)]
    parts = {"a": g[0].bitwiseAND(LOW), "b": F.shiftrightunsigned(g[0], 32), "c": g[1].bitwiseAND(LOW), "d": F.shiftrightunsigned(g[1], 32)}
    with_parts = turns.select("*", *[c.alias(f"_{n}") for n, c in parts.items()])
    sums = running_sums(with_parts, "conv_id", ["pos"], {n: F.col(f"_{n}") for n in parts})

    def key(x: str, y: str, minus: bool = False) -> Column:
        low, high = [(F.col(n) - F.col(f"_{n}") if minus else F.col(n)).bitwiseAND(LOW) for n in (x, y)]
        return F.shiftleft(high, 32).bitwiseOR(low)

    rows = sums.select("conv_id", (F.col("pos") + 1).alias("depth"), key("a", "b").alias("k1"), key("c", "d").alias("k2"),
                       key("a", "b", True).alias("p1"), key("c", "d", True).alias("p2"), "words")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"),
                        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("words"))
    return rows.unionByName(root)


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` from ``(key, range, ids)``: the hash of each key's comma-joined
    ids. A key with one range is hashed where it is; the ranges of others are
    streamed in order through one hash object, whatever their number."""
    one = ends.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("ids").alias("ids")).where("n = 1")
    one = one.select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    several = ends.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = ends.join(several, KEY).select(*KEY, "range", "ids").repartition(parts, *KEY).sortWithinPartitions(*KEY, "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != at:
                    done += [(*at, state.hexdigest())] if at else []
                    at, state = row[:3], hashlib.sha256(row[4].encode())
                else:
                    state.update(b"," + row[4].encode())
            yield out(done)
        yield out([(*at, state.hexdigest())] if at else [])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEY, "ends_sha256"])

    return one.unionByName(stream.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a distinct prefix of the conversations ``convs`` (``conv_id``) with turns
    ``(conv_id, pos, t1, t2, words)``: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, (n_convs - 1) x words of the last turn) and
    ``ends_sha256`` (ids of the members that end there, ascending, comma-joined).

    A conversation without turns is a member of the root alone, and ends there.
    No conversation at all: no row, not even the root.
    """
    prefixes = stored(_prefixes(convs, turns), "prefixes")

    # identical conversations -> one weighted sequence; its ends as ranges of ids
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("end")).select("conv_id", "end.*")
    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = stored(last.repartitionByRange(parts, "conv_id").withColumn("range", F.spark_partition_id()), "ends")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ends = last.groupBy(*KEY, "range").agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    ends = stored(ends, "ranges")
    sequences = ends.groupBy(*KEY).agg(F.sum("n").alias("weight"), F.min("least").alias("conv_id"))
    sequences = stored(sequences, "sequences")

    # the prefixes of representatives, weighted
    weight = sequences.select("conv_id", "weight")
    kept = stored(prefixes.join(weight, "conv_id"), "kept")
    nodes = kept.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    # leaves: sequences that are no proper prefix; what each sequence's own nodes save
    inner = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    inner = stored(inner.agg(F.count("*").alias("n_children")), "inner")
    leaf = sequences.join(inner, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("own"))
    through = own.join(leaf, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    below = kept.select("conv_id", *KEY).join(through, "conv_id").groupBy(*KEY)
    below = below.agg(F.sum("own").alias("all_own"), F.sum("leaf").alias("n_leaves"))

    # of its own sequence a node counts only itself and what is deeper
    above = running_sums(nodes.select("conv_id", *KEY, "saved"), "conv_id", ["depth"], {"upto": F.col("saved")})
    above = above.select(*KEY, (F.col("upto") - F.col("saved")).alias("above"))
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                          F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(below, KEY).join(above, KEY).join(inner, KEY, "left").join(_ends_hashes(ends), KEY, "left")
    found = found.join(parent, ["depth", "p1", "p2"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("all_own") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """The prefix trie of rebuilt ``conversations`` (``conv_id, turn, role, text``).

    Null role or text: empty. Null turn: first. Rows of one turn: by role, then by a
    hash of the text; equal rows are turns of their own. A row without a conversation id
    belongs to no conversation. Other columns are not read. Empty table: no row.
    """
    narrow = stored(narrow_turns(conversations), "narrow")  # texts are read and hashed once
    turns = stored(numbered(narrow), "turns")
    return prefix_trie(*rebuilt(turns, every, heads))
