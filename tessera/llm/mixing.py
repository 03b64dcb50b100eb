"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its tokens: words in lower case, spelled byte by byte with a space after
each, and the empty word at the end. A byte is eight binary decisions. Seven predictors
look a decision up by a hash of what came before in the text in a table of fixed size:
the last one to five bytes, whatever words they are of; the word so far; the word so far
and the word before it. The tables hold how often either bit followed in the training
texts. The predictors' logits are mixed by weights that a gate selects from how often the
two word contexts were seen. The weights are learned online along the training texts, each
decision predicted as if its own occurrence were not in the tables; then an adaptive map
corrects the mixed probability by what was seen at that probability.

A text's score is the sum over all its decisions, so the order of words matters. Tables
are counted, weights learned and texts scored where Spark reads the texts; word counts for
the base score are counted and joined by Spark. The tables, weights and maps are of fixed
size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stored

ORDERS = 5
INPUTS = ORDERS + 2  # and the word so far, alone and after the word before it
SLOT_BITS = 22
SHARD_BITS = 16
GATES = 16
STEPS = 33  # of the adaptive map, over logits from -8 to 8
SPACE = 0x20
HOT_WORDS = 1 << 18
WAITING_BYTES = 1 << 24  # of texts whose words are counted at a time
BLOCK_BYTES = 1 << 14
PART_BYTES = 1 << 13  # worked on at a time
BATCH_BYTES = 1 << 20  # of texts whose words are held at a time
PAD = 40  # items between an array's rows: rows a power of two apart push each other out of the cache
CURVE = 64  # steps of the scoring curve a unit of logit
RATE = 0.1
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
with np.errstate(over="ignore"):  # hashes wrap
    SPREAD = ODD * STEP
    STEP_TWICE, STEP_SPREAD = STEP * STEP, STEP * SPREAD
    STEPS_OF = np.arange(ORDERS + 1, dtype=np.uint64) * STEP
NODES = np.arange(32, dtype=np.uint64) * SPREAD


def words_of(text: str | bytes) -> list[bytes]:
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()


def held_out(doc: Column) -> Column:
    """Whether a document is scored only; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 5 == 1


# --- bit predictors ---

def contexts(joined: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes (input, byte) of what stands before each byte in its text; ``starts``: of texts."""
    n = len(joined)
    value = joined.astype(np.uint64)
    value += np.uint64(1)
    out = np.empty((INPUTS, n), np.uint64)
    h = np.full(n, 1, np.uint64)
    for k in range(1, ORDERS + 1):
        h *= STEP
        h[k:] += value[:-k]
        early = (starts[:, None] + np.arange(k)).ravel()  # nothing of the text before
        early = early[(early >= k) & (early < n)]
        h[early] -= value[early - k]
        np.multiply(h, SPREAD, out=out[k - 1])
        out[k - 1] += STEPS_OF[k]
    first = np.zeros(n, bool)  # of a word
    first[1:] = joined[:-1] == SPACE
    first[starts] = True
    begin = np.flatnonzero(first)
    sizes = np.diff(np.r_[begin, n])
    inside = np.arange(n) - np.repeat(begin, sizes)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(inside.max(initial=0)), STEP)])  # wraps
    value *= power.take(inside)
    word = np.cumsum(value)
    word -= value  # all before it
    word -= np.repeat(word[begin], sizes)
    word *= ODD
    word += inside.astype(np.uint64)
    np.multiply(word, STEP_TWICE, out=out[ORDERS])
    before = word[begin - 1]  # the word before has its hash at its space
    before[np.searchsorted(begin, starts)] = 0
    np.multiply(word, STEP_SPREAD, out=out[ORDERS + 1])
    out[ORDERS + 1] += np.repeat(before * SPREAD + STEP, sizes)
    return out


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where the 16 slots of a nibble begin: the first is free, a nibble's nodes have the others.
    ``node``: its hash."""
    x = context + node
    x ^= x >> np.uint64(29)
    x *= ODD
    x >>= np.uint64(64 - SLOT_BITS + 4)
    x <<= np.uint64(4)
    return x.view(np.int64)


def halves(joined: np.ndarray, starts: np.ndarray, skip: int = 0) -> Iterator[Iterator[tuple[int, Iterator[np.ndarray], np.ndarray]]]:
    """For both halves of all bytes but the first ``skip``, in parts of ``PART_BYTES``: where the
    part begins, by input where the slots of a byte's half begin plus the half, and the halves."""
    context = contexts(joined, starts)[:, skip:]
    high, low = (joined[skip:] >> 4).astype(np.int64), (joined[skip:] & 15).astype(np.int64)

    def leaves(cut: slice, half: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
        for row in context[:, cut]:
            leaf = slots(row, node)
            leaf += half
            yield leaf

    def parts(half: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[int, Iterator[np.ndarray], np.ndarray]]:
        for lo in range(0, len(half), PART_BYTES):
            cut = slice(lo, lo + PART_BYTES)
            yield lo, leaves(cut, half[cut], NODES.take(nodes[cut])), half[cut]

    yield parts(high, np.ones_like(high))
    yield parts(low, high + 16)


def decisions(joined: np.ndarray, starts: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For each of the eight bits of all bytes: the slots by input, and the bits."""
    for parts in halves(joined, starts):
        found = [(np.array(list(leaves)) - half, half + 16) for _, leaves, half in parts]
        base, value = np.concatenate([at for at, _ in found], axis=1), np.concatenate([value for _, value in found])
        for k in (4, 3, 2, 1):
            yield list(base + (value >> k)), (value >> (k - 1)) & 1


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, a space after each, and where words start."""
    sizes = np.array([len(w) + 1 for w in words])
    return np.frombuffer(b" ".join(words) + b" ", np.uint8), np.cumsum(sizes) - sizes


@dataclass
class Block:
    """Some bytes of texts; ``starts``: where the texts ``owners`` begin. The first ``skip``
    bytes were in the block before: the last words of a text that goes on here."""

    joined: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    skip: int


def blocks(texts: Iterable[list[bytes]], most: int = BLOCK_BYTES) -> Iterator[Block]:
    """All texts, each a list of words, cut between words. No context is cut: three words
    stand before a part, and so the word before and five bytes."""
    parts: list[bytes] = []
    owners: list[int] = []
    size = skip = 0

    def flush() -> Block:
        sizes = np.array([len(p) for p in parts])
        return Block(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, np.array(owners), skip)

    for i, words in enumerate(texts):
        text = b" ".join([*words, b""]) + b" "
        lead = start = 0
        while start < len(text):
            stop = len(text)
            if size + stop - start > most:
                stop = text.rfind(b" ", start, start + max(most - size, 0)) + 1
                if stop == 0 and parts:
                    yield flush()
                    parts, owners, size = [], [], 0
                    continue
                stop = stop or text.find(b" ", start) + 1  # a word longer than a block
            if not parts:
                skip = start - lead
            parts.append(text[lead:stop])
            owners.append(i)
            size += stop - start
            if stop < len(text):
                yield flush()
                parts, owners, size = [], [], 0
                lead = stop
                for _ in range(3):
                    lead = text.rfind(b" ", 0, max(lead - 1, 0)) + 1
            start = stop
    if parts:
        yield flush()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lookups() -> tuple[np.ndarray, np.ndarray]:
    """Logit and gate level of a slot's two counts (zeros + 256 * ones): as they are, as if a
    zero were not counted, as if a one were not counted."""
    ones, zeros = np.divmod(np.arange(1 << 16), 256)
    logits, levels = [], []
    for less_ones, less_zeros in ((0, 0), (0, 1), (1, 0)):
        a, b = np.maximum(ones - less_ones, 0), np.maximum(zeros - less_zeros, 0)
        logits.append(np.log((a + 0.2) / (b + 0.2)))
        levels.append((a + b > 0) * 1 + (a + b > 2) + (a + b > 20))
    return np.concatenate(logits).astype("f4"), np.concatenate(levels).astype("i1")


LOGITS, LEVELS = _lookups()
FEWER = np.arange(1 << 16, dtype="<u2") - np.array([[0], [1], [256]], "<u2") * (np.array([np.full(1 << 16, 1), np.arange(1 << 16) % 256, np.arange(1 << 16) // 256]) > 0)
FEWER = FEWER.astype("<u2").ravel()  # a slot's counts, as in ``_lookups``
LEAF_NODES = np.array([[(16 + leaf) >> k for k in (4, 3, 2, 1)] for leaf in range(16)])  # on the way to each leaf
LEAF_BITS = np.array([[(16 + leaf) >> k & 1 for k in (3, 2, 1, 0)] for leaf in range(16)], "u1").view("u4").ravel()


def _pack(pairs: np.ndarray, own: bool) -> np.ndarray:
    """Of each leaf, by input, its four decisions' counts side by side, so that they are read at
    once; with ``own``, as if the decision's own occurrence were not counted."""
    out = np.empty((len(pairs), pairs.shape[1]), "<i8")
    nodes, less = LEAF_NODES.ravel(), (LEAF_BITS.view("u1").astype(np.int64) + 1 << 16) * own
    for k, row in enumerate(pairs):
        of, to = row.reshape(-1, 16), out[k].view("<u2").reshape(-1, 64)
        for lo in range(0, len(of), 1 << 10):
            FEWER.take(of[lo:lo + (1 << 10)].take(nodes, axis=1) + less, out=to[lo:lo + (1 << 10)], mode="clip")
    return out


class _Packed:
    """The packed tables in use: a worker has one at a time, and keeps it for its next task."""

    pairs = own = table = None

    @classmethod
    def of(cls, pairs: np.ndarray, own: bool) -> np.ndarray:
        if cls.pairs is not pairs or cls.own != own:
            cls.pairs = cls.table = None
            cls.table = _pack(pairs, own)
            cls.pairs, cls.own = pairs, own
        return cls.table


@dataclass
class Mixer:
    """``pairs``: counts (input, slot), zeros + 256 * ones. ``weights``: (gate, input and
    bias). ``hits`` and ``seen``: of the adaptive map, (gate, step)."""

    pairs: np.ndarray
    weights: np.ndarray
    hits: np.ndarray
    seen: np.ndarray
    shared: object = None  # the tables' broadcast
    room: np.ndarray | None = None  # for a part's inputs and bias

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": None, "shared": None, "room": None}

    @staticmethod
    def new(pairs: np.ndarray) -> Mixer:
        weights = np.full((GATES, INPUTS + 1), 0.3, "f4")
        weights[:, -1] = 0
        return Mixer(pairs, weights, np.zeros((GATES, STEPS)), np.zeros((GATES, STEPS)))

    def inputs(self, at: Iterable[np.ndarray], bit: np.ndarray | None, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits (input and bias, decision) and gates of all or ``size`` decisions; with
        ``bit``, as if the decision's own occurrence were not counted."""
        if size is None:
            size = len(at[0] if bit is None else bit)
        x = np.empty((INPUTS + 1, size), "f4")
        x[-1] = 1
        own = None if bit is None else (bit + 1) << 16
        for k, slot in enumerate(at):
            pair = self.pairs[k].take(slot)
            pair = pair.astype(np.int64) if own is None else own + pair
            LOGITS.take(pair, out=x[k], mode="clip")  # (clip: pairs are in range, and it spares a copy)
            if k == INPUTS - 2:
                gate = LEVELS.take(pair, mode="clip") * 4
            elif k == INPUTS - 1:
                gate = (gate + LEVELS.take(pair, mode="clip")).astype(np.int64)
        return x, gate

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The logits under all gates' weights by one product, of which each decision takes its gate's."""
        n = len(gate)
        logit = (self.weights @ x).take(gate * n + np.arange(n), mode="clip")
        return np.clip(logit, -14, 14, out=logit)

    def refined(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one, half of it by the adaptive map."""
        steps = np.arange(STEPS) / 2 - 8
        table = (self.hits + 8 * _sigmoid(steps)) / (self.seen + 8)
        place = (np.clip(logit, -8, 8) + 8) * 2
        low = np.minimum(place.astype(np.int64), STEPS - 2)
        part = place - low
        mapped = table[gate, low] * (1 - part) + table[gate, low + 1] * part
        return np.clip((_sigmoid(logit) + mapped) / 2, 1e-7, 1 - 1e-7)

    def packed(self, table: np.ndarray, leaves: Iterable[np.ndarray], half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``inputs``, of the four decisions of each byte's half one after the other: their
        counts, gates, and bits."""
        x = np.empty((INPUTS, len(half) + PAD), "<i8")[:, :len(half)]
        for k, leaf in enumerate(leaves):
            table[k].take(leaf, out=x[k], mode="clip")
        x = x.view("<u2")
        gate = LEVELS.take(x[-2], mode="clip") << 2
        gate |= LEVELS.take(x[-1], mode="clip")
        return x, gate, LEAF_BITS.take(half).view("u1")

    def learn(self, block: Block) -> np.ndarray:
        """One online step for either half of a block's bytes; returns how much each gate was used."""
        used, table = np.zeros(GATES), _Packed.of(self.pairs, True)
        for parts in halves(block.joined, block.starts, block.skip):
            step, amount = np.zeros((GATES, INPUTS + 1)), np.zeros(GATES)
            weights = self.weights.astype("f4")
            for _, leaves, half in parts:
                q, gate, bit = self.packed(table, leaves, half)
                order = gate.view("u1").argsort(kind="stable")  # each gate's decisions stand together
                many = np.bincount(gate, minlength=GATES)
                if self.room is None or self.room.shape[1] < len(gate):
                    self.room = np.ones((INPUTS + 1, len(gate) + PAD), "f4")
                x, row = self.room[:, :len(gate)], np.empty_like(q[0])
                for k in range(INPUTS):
                    LOGITS.take(q[k].take(order, out=row, mode="clip"), out=x[k], mode="clip")
                bit = bit.take(order)
                logit = np.empty(len(gate), "f4")
                cuts = [(g, slice(end - n, end)) for g, (n, end) in enumerate(zip(many.tolist(), np.cumsum(many).tolist())) if n]
                for g, cut in cuts:
                    np.dot(weights[g], x[:, cut], out=logit[cut])
                np.clip(logit, -14, 14, out=logit)
                error = np.exp(-logit)
                error += 1
                np.divide(-1, error, out=error)
                error += bit
                for g, cut in cuts:
                    step[g] += x[:, cut] @ error[cut]
                np.clip(logit, -8, 8, out=logit)
                logit *= 2
                logit += 16.5
                place = logit.astype(np.int64)
                place += np.repeat(np.arange(GATES) * 2 * STEPS, many)
                place += bit * np.int64(STEPS)
                zeros, ones = np.bincount(place, minlength=2 * GATES * STEPS).reshape(GATES, 2, STEPS).transpose(1, 0, 2)
                self.hits += ones
                self.seen += zeros + ones
                amount += many
            step /= np.maximum(amount, 1)[:, None]
            self.weights += RATE * np.clip(step, -2, 2).astype("f4")
            used += amount
        return used

    def curve(self) -> np.ndarray:
        """``refined`` for all gates at ``CURVE`` steps a unit of logit."""
        logit = np.arange(-14 * CURVE, 14 * CURVE + 1) / CURVE
        return np.concatenate([self.refined(logit, np.full(len(logit), g)) for g in range(GATES)])

    def log10(self, texts: list[list[bytes]]) -> np.ndarray:
        """Log of the probability of each text, a list of words."""
        out, curve, table = np.zeros(len(texts)), self.curve(), _Packed.of(self.pairs, False)
        logs = np.log10(np.concatenate([1 - curve, curve])).astype("f4")  # of a zero, of a one
        most = 28 * CURVE
        scale = (self.weights.T * CURVE).astype("f4")  # to steps of the curve
        scale[-1] += most / 2 + 0.5
        four = np.ones(4, "f4")
        rows = (np.arange(2)[:, None] * len(curve) + np.arange(GATES) * (most + 1)).ravel()
        for block in blocks(texts):
            sums = np.zeros(len(block.joined) - block.skip)
            for parts in halves(block.joined, block.starts, block.skip):
                for lo, leaves, half in parts:
                    x, gate, bit = self.packed(table, leaves, half)
                    gate = gate.astype(np.int64)
                    logit = scale[-1].take(gate, mode="clip")
                    part, row = np.empty_like(logit), np.empty_like(logit)
                    for k in range(INPUTS):
                        scale[k].take(gate, out=part, mode="clip")
                        part *= LOGITS.take(x[k], out=row, mode="clip")
                        logit += part
                    place = np.clip(logit, 0.5, most + 0.5, out=logit).astype(np.int64)
                    gate += bit * np.int64(GATES)
                    place += rows.take(gate, mode="clip")
                    logs.take(place, out=part, mode="clip")
                    sums[lo:lo + len(half)] += part.reshape(-1, 4) @ four
            out[block.owners] += np.add.reduceat(sums, np.maximum(block.starts - block.skip, 0))
        return out


# --- corpus counts ---

def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(word, c, m)``: of each distinct token (the end is the empty word) the number in
    training documents and in all."""

    def counted(held: bool, texts: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        words = pc.list_flatten(pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(""))))  # at blanks, empty ones at the ends
        word, n = words.value_counts().flatten()
        real = pc.not_equal(word, "")
        word, n = pa.concat_arrays([word.filter(real), pa.array([""])]), pa.concat_arrays([n.filter(real), pa.array([len(texts)])])
        yield pa.RecordBatch.from_arrays([word.cast(pa.binary()), pc.multiply(n, 0) if held else n, n], names=["word", "c", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = {False: [], True: []}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for held, parts in waiting.items():
                if sum(map(len, parts)):
                    yield from counted(held, pa.chunked_array(parts))
                parts.clear()

        for batch in (part for whole in batches for part in slices(whole, 1, WAITING_BYTES)):
            text = batch.column(1).cast(pa.string())
            for held, parts in waiting.items():
                parts.append(text.filter(batch.column(0) if held else pc.invert(batch.column(0))))
            size += pc.sum(pc.binary_length(text)).as_py() or 0
            if size >= WAITING_BYTES:
                yield from flush()
                size = 0
        yield from flush()
        pa.default_memory_pool().release_unused()  # workers go on to other stages

    rows = docs.select(held_out(F.col(id_col)).alias("held"), text_col).mapInArrow(run, "word binary, c long, m long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            yield words_of(text.as_py() or b"")


def _pairs(leaves: np.ndarray) -> np.ndarray:
    """Counts of either bit by node from those of the 16 values of a nibble, as zeros + 256 * ones."""
    level = leaves.reshape(-1, 16).astype("f8")
    out = np.zeros((len(level), 16), "<u2")
    for first in (8, 4, 2, 1):
        pair = level.reshape(len(level), first, 2)
        scaled = np.rint(pair * (255 / np.maximum(pair.max(axis=2, keepdims=True), 255)))  # one byte a count; the ratio stays
        out[:, first:2 * first] = scaled[:, :, 0] + 256 * scaled[:, :, 1]
        level = pair.sum(axis=2)
    return out.ravel()


def _tables(texts: DataFrame) -> np.ndarray:
    """How often either bit followed in the training texts, by slot: each task adds up its
    texts by nibble, shards of tables are summed."""
    shards = 1 << (SLOT_BITS - SHARD_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros((INPUTS, 1 << SLOT_BITS), "u4"), False
        for block in blocks(_texts(batches), PART_BYTES << 2):
            some = True
            for parts in halves(block.joined, block.starts, block.skip):
                for _, leaves, _ in parts:
                    for k, leaf in enumerate(leaves):
                        np.add.at(counts[k], leaf, np.uint32(1))
        if some:
            for shard, part in enumerate(counts.reshape(INPUTS * shards, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([part.tobytes()], pa.binary())], names=["shard", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SHARD_BITS, "u8")
        for part in parts:
            for blob in part.column("counts"):
                total += np.frombuffer(blob.as_buffer(), "u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([_pairs(total).tobytes()], pa.binary())], names=["shard", "counts"])

    parts = texts.mapInArrow(run, "shard long, counts binary")
    rows = parts.groupBy("shard").applyInArrow(add, "shard long, counts binary").collect()  # tables of fixed size
    pairs = np.zeros((INPUTS * shards, 1 << SHARD_BITS), "<u2")
    for r in rows:
        pairs[r["shard"]] = np.frombuffer(r["counts"], "<u2")
    return pairs.reshape(INPUTS, -1)


def train(texts: DataFrame) -> Mixer:
    """Tables, weights and maps from all of the only column of ``texts``; the weights online,
    in each task on its own and then averaged by use."""
    mixer = Mixer.new(_tables(texts))
    mixer.shared = shared = texts.sparkSession.sparkContext.broadcast(mixer.pairs)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, used = Mixer.new(shared.value), np.zeros(GATES)
        for block in blocks(_texts(batches)):
            used += mine.learn(block)
        values = np.concatenate([mine.weights * used[:, None], mine.hits, mine.seen, used[:, None]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])

    learned = texts.mapInArrow(run, "place long, value double")
    rows = learned.groupBy("place").agg(F.sum("value").alias("value")).collect()  # of fixed size
    values = np.zeros(GATES * (INPUTS + 2 + 2 * STEPS))
    for r in rows:
        values[r["place"]] = r["value"]
    values = values.reshape(GATES, -1)
    used = values[:, -1:]
    mixer.weights = np.where(used > 0, values[:, :INPUTS + 1] / np.maximum(used, 1e-9), mixer.weights).astype("f4")
    mixer.hits, mixer.seen = values[:, INPUTS + 1:INPUTS + 1 + STEPS], values[:, INPUTS + 1 + STEPS:-1]
    return mixer


# --- scores ---

class _Places(dict):
    """Words to their places; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


def slices(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in parts of about ``most`` (``BATCH_BYTES``) of text, or one row: words take many times their text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // (most or BATCH_BYTES))) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if stop > start:
            yield batch.slice(start, stop - start)


def _sums(hot, mixer: Mixer, shared, id_col: str):
    names = ["key", id_col, "held_out", "n_tokens", "n_known", "n_bytes", "logs", "score", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mixer.pairs = shared.value
        words, c = hot.value
        place = _Places(zip(words, range(len(words)))).__getitem__
        c, logs = np.r_[c, 0.0], np.r_[np.log10(c + 0.5), 0.0]  # the last: place -1
        key = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole, 2)):
            tokens: list[bytes] = []
            counts: list[int] = []
            sizes, lengths, texts = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = words_of(text or b"")
                texts.append(found)
                mine = Counter(found)
                mine[b""] = 1
                tokens += mine
                counts += mine.values()
                sizes.append(len(mine))
                lengths.append(len(text or b""))
            at, n = np.fromiter(map(place, tokens), np.int64, len(tokens)), np.array(counts, np.int64)
            starts = np.cumsum([0, *sizes])
            total = lambda values: np.add.reduceat(values, starts[:-1]) if len(sizes) else values
            other = at < 0
            rare = pa.StructArray.from_arrays([pa.array([tokens[i] for i in np.flatnonzero(other)], pa.binary()), pa.array(n[other])], ["word", "n"])
            ends = np.r_[0, np.cumsum(total(other.astype(np.int64)))].astype(np.int32)
            keys = np.arange(key, key + batch.num_rows)
            key += batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(keys), batch.column(0), batch.column(1), pa.array(total(n)), pa.array(total(n * (c[at] > 0))), pa.array(lengths, pa.int64()),
                pa.array(total(n * logs[at])), pa.array(mixer.log10(texts)), pa.ListArray.from_arrays(pa.array(ends), rare)], names=names)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``
    for each row. ``base_score`` is that of smoothed word counts, ``score`` the model's;
    both are log10, and learn from documents that are not held out.

    A null text is empty: its only token is the end. Repeated rows count each and keep
    their rows. Other columns are not read. Empty table: no row. The counts of the
    ``hot_words`` most frequent words (a bound on what is broadcast) are looked up where
    texts are read, the others by a join."""
    spark = docs.sparkSession
    words = stored(word_counts(docs, id_col, text_col), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    mixer = train(docs.where(~held_out(F.col(id_col))).select(text_col))
    top = words.orderBy(F.desc("m"), "word").limit(hot_words).toArrow()
    least = (int(top["m"][-1].as_py()), top["word"][-1].as_py()) if len(top) else (0, b"")
    hot = spark.sparkContext.broadcast((top["word"].to_pylist(), top["c"].to_numpy().astype(float)))
    kept = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField(id_col, kept), T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("logs", T.DoubleType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rare", T.DataType.fromDDL("array<struct<word:binary,n:bigint>>"))])
    read = docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
    sums = stored(read.mapInArrow(_sums(hot, mixer, mixer.shared, id_col), schema), "sums", compression="zstd")
    rare = sums.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.n")
    cold = words.where((F.col("m") < least[0]) | ((F.col("m") == least[0]) & (F.col("word") > F.lit(bytearray(least[1])))))
    cold = cold.select("word", (F.col("c") > 0).cast("long").alias("known"), F.log10(F.col("c") + 0.5).alias("log"))
    found = rare.join(cold, "word").groupBy("key").agg(F.sum(F.col("n") * F.col("known")).alias("more_known"), F.sum(F.col("n") * F.col("log")).alias("more_logs"))
    whole = sums.drop("rare").join(found, "key", "left")
    total = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    each = float(np.log10(n + 0.5 * (v + 1)))
    return whole.select(id_col, "held_out", "n_tokens", total("n_known", "more_known").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
                        (total("logs", "more_logs") - F.col("n_tokens") * each).alias("base_score"), "score",
                        (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
