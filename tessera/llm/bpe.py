"""Byte-level BPE by merge ranks, for pre-tokens of any length.

The adjacent pairs of pre-tokens wait in buckets, one for each merge rank, that hold
positions of a linked list. A hierarchy of 64-bit words marks the ranks whose buckets
are in use: the lowest set bit of the top word names a word of the level below, down
to the next rank. A bucket's positions are merged from left to right; an entry whose
pair has changed since it was queued is skipped. A merge costs a few word operations,
so a pre-token of n bytes takes about n steps, not n squared.

Pre-tokens do not touch each other, so one queue serves all new ones of many texts:
their bytes are one linked list with breaks, and a bucket is merged in one vector step.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import tokenizer_file

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHE = 300_000
GROUP = 4_000_000  # characters or bytes at a time
EMPTY = b""


class RankQueue:
    """Positions (or arrays of them) by rank; ``pop`` gives the lowest rank in use and its positions."""

    def __init__(self, ranks: int) -> None:
        self.levels = []
        while True:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, position) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            before = level[word]
            level[word] = before | bit
            if before:
                break
            rank = word

    def pop(self) -> tuple[int, list] | None:
        if not self.buckets:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return rank, self.buckets.pop(rank)


class Recent(dict):
    """Values of short strings. Full, it becomes the older half, from which what is used
    again comes back; the half before it goes."""

    def __init__(self) -> None:
        self.older: dict[str, bytes] = {}

    def known(self, key: str) -> bool:
        if key in self:
            return True
        value = self.older.get(key)
        if value is None:
            return False
        self[key] = value
        return True

    def trim(self) -> None:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Merge ranks with the pre-token pattern. Every single byte must have a rank."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        import public_tokenizers
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.tokens = [EMPTY] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.queue = RankQueue(len(self.tokens))
        # what two tokens become: the rank of their bytes put together
        size, ranks = len(self.tokens), self.ranks
        pairs = [(ranks[t[:i]] * size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pair_keys, self.pair_ranks = (np.array(c, np.int64) for c in zip(*sorted(pairs)))
        self.pieces, self.first, self.spaced = Recent(), Recent(), Recent()

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 if they are not merged."""
        keys = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token (not empty), as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        token = self.bytes[np.frombuffer(EMPTY.join(pieces), np.uint8)]
        n, queue = len(token), self.queue
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        queued = np.full(n, -1)
        inner = np.flatnonzero(after >= 0)
        queued[inner] = self.pair_rank(token[inner], token[inner + 1])
        owner = np.repeat(np.arange(len(pieces)), sizes)
        again: set[int] = set()

        def push(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
            start = 0
            for rank, end in zip(ranks[[0, *cuts]].tolist(), [*cuts, len(ranks)]):
                queue.push(rank, positions[start:end])
                start = end

        some = np.flatnonzero(queued >= 0)
        if len(some):
            push(some, queued[some])
        while (found := queue.pop()) is not None:
            rank, parts = found
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            at = at[queued[at] == rank]  # the others are stale
            if len(parts) > 1:
                at.sort()
                if len(at) > 1:
                    at = at[np.r_[True, at[1:] != at[:-1]]]
            if not len(at):
                continue
            if len(at) > 1:  # of pairs that share a token, the left one is merged
                touch = after[at[:-1]] == at[1:]
                if touch.any():
                    start = np.flatnonzero(np.r_[True, ~touch])
                    place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
                    at = at[place % 2 == 0]
            gone = after[at]
            follow = after[gone]
            token[at], after[at] = rank, follow
            queued[gone] = -1
            linked = follow >= 0
            before[follow[linked]] = at[linked]
            left = before[at]
            changed = np.concatenate([at, left[left >= 0]])
            if len(changed) > 1:
                changed.sort()
                changed = changed[np.r_[True, changed[1:] != changed[:-1]]]
            right = after[changed]
            whole = right >= 0
            queued[changed[~whole]] = -1
            changed = changed[whole]
            if len(changed):
                new = self.pair_rank(token[changed], token[right[whole]])
                queued[changed] = new
                if ((new < rank) & (new >= 0)).any():  # a lower rank came up before the bucket's end
                    lower = owner[changed[(new < rank) & (new >= 0)]]
                    merged, times = np.unique(owner[at], return_counts=True)
                    again.update(np.intersect1d(lower, merged[times > 1]).tolist())
                fresh = new >= 0
                if fresh.any():
                    push(changed[fresh], new[fresh])
        alive = np.ones(n, bool)
        alive[_merged_away(after, ends, sizes)] = False
        counts = np.add.reduceat(alive, ends - sizes)
        ids = token[alive].astype("<u4").tobytes()
        stops = 4 * np.cumsum(counts)
        out = [ids[b - 4 * c:b] for b, c in zip(stops.tolist(), counts.tolist())]
        for i in again:
            out[i] = self.merge_alone(pieces[i])
        return out

    def merge_alone(self, piece: bytes) -> bytes:
        """As ``merge``, of one pre-token and one position at a time."""
        n, ranks, queue = len(piece), self.ranks, self.queue
        after, before, queued = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        none = len(self.tokens)

        def look(i: int) -> int:
            """Queue the pair that starts at i; its rank, or the largest number."""
            queued[i] = -1
            if (j := after[i]) < n and (rank := ranks.get(piece[i:after[j]], -1)) >= 0:
                queued[i] = rank
                queue.push(rank, i)
                return rank
            return none

        for i in range(n - 1):
            look(i)
        while (found := queue.pop()) is not None:
            rank, positions = found
            positions.sort()
            for k, i in enumerate(positions):
                if queued[i] != rank:
                    continue  # stale
                gone = after[i]
                after[i] = end = after[gone]
                queued[gone] = -1
                if end < n:
                    before[end] = i
                lowest = look(i)
                if before[i] >= 0:
                    lowest = min(lowest, look(before[i]))
                if lowest < rank:  # it goes first
                    for later in positions[k + 1:]:
                        queue.push(rank, later)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers.

        A space between two characters that are no white space always starts a pre-token,
        so what lies between such spaces is put together once for each distinct string."""
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= GROUP or i == len(texts) - 1:
                yield from self._encode_group(texts[start:i + 1])
                start, size = i + 1, 0

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        pieces, first, spaced = self.pieces, self.first, self.spaced
        cut: list[list[str] | None] = []  # the chunks of a text, or its pre-tokens
        plain: list[bool] = []
        new_first: dict[str, list[str]] = {}
        new_spaced: dict[str, list[str]] = {}
        todo: dict[str, None] = {}
        for text in texts:
            head, *rest = text.split(" ")
            mine = {c for c in rest if c not in new_spaced and not spaced.known(c)}
            blank = any(not c or c[0].isspace() or c[-1].isspace() for c in mine) or not head or head[0].isspace() or head[-1].isspace()
            plain.append(not blank)
            if blank:
                cut.append(self.split(text))
                todo.update((p, None) for p in set(cut[-1]) if not pieces.known(p))
                continue
            cut.append([head, *rest])
            for lead, held, chunks in (("", new_first, [head] if head not in new_first and not first.known(head) else []), (" ", new_spaced, mine)):
                for c in chunks:
                    held[c] = self.split(lead + c)
                    todo.update((p, None) for p in held[c] if not pieces.known(p))
        todo_bytes = [p.encode() for p in todo]
        fresh = dict(zip(todo, self._merge_some(todo_bytes)))
        get = lambda p: fresh[p] if p in fresh else pieces[p]
        at_start = {c: EMPTY.join(map(get, ps)) for c, ps in new_first.items()}
        later = {c: EMPTY.join(map(get, ps)) for c, ps in new_spaced.items()}
        out = []
        for whole, chunks in zip(plain, cut):
            if not whole:
                out.append(EMPTY.join(map(get, chunks)))
            else:
                head = at_start[chunks[0]] if chunks[0] in at_start else first[chunks[0]]
                out.append(head + EMPTY.join([later[c] if c in later else spaced[c] for c in chunks[1:]]))
        for cache, held in ((pieces, fresh), (first, at_start), (spaced, later)):
            cache.update((k, v) for k, v in held.items() if len(k) <= 64)
            cache.trim()
        return out

    def _merge_some(self, pieces: list[bytes]) -> Iterator[bytes]:
        start = size = 0
        for i, piece in enumerate(pieces):
            size += len(piece)
            if size >= GROUP or i == len(pieces) - 1:
                yield from self.merge(pieces[start:i + 1])
                start, size = i + 1, 0

    def encode(self, text: str) -> bytes:
        return next(iter(self.encode_all([text])))

    def decode(self, ids: bytes) -> bytes:
        return EMPTY.join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _merged_away(after: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions that no link reaches and that start no pre-token."""
    reached = np.zeros(len(after), bool)
    reached[ends - sizes] = True
    # links of what was merged away still point on; a live one skips over them, so a
    # position is live if the position its token's bytes end before says so
    at = ends - sizes
    while len(at):
        at = after[at]
        at = at[at >= 0]
        reached[at] = True
    return np.flatnonzero(~reached)


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """The encoder of this process for ``path``, read at its first use."""
    path = path or tokenizer_file(RANKS)
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def _per_text(docs: DataFrame, id_col: str, text_col: str, fields: dict[str, T.DataType], make) -> DataFrame:
    """``(id_col, *fields)`` with the columns that ``make`` gives for a list of texts (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = make([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *fields])

    kept = T.StructField(id_col, docs.schema[id_col].dataType)
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([kept, *(T.StructField(k, v) for k, v in fields.items())]))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)`` for each row; ``ids`` holds little-endian unsigned 32-bit
    integers. Null or empty text: no ids. Rows are independent: repeated rows and
    null ids pass through, other columns are not read."""

    def make(texts: list[str]) -> list[pa.Array]:
        return [pa.array(list(encoder(path).encode_all(texts)), pa.binary())]

    return _per_text(docs, id_col, text_col, {"ids": T.BinaryType()}, make)


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, bytes)`` from ids as ``encode_documents`` gives them."""

    def make(ids: list[bytes]) -> list[pa.Array]:
        decode = encoder(path).decode
        return [pa.array([decode(i or EMPTY) for i in ids], pa.binary())]

    return _per_text(encoded, id_col, ids_col, {"bytes": T.BinaryType()}, make)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, and its ids decoded."""

    def make(texts: list[str]) -> list[pa.Array]:
        coder = encoder(path)
        counts, of_ids, of_bytes = [], [], []
        for ids in coder.encode_all(texts):
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]

    fields = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return _per_text(docs, id_col, text_col, fields, make)
