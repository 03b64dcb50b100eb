"""Token ids by the ``tokenizers`` library, with repeated words encoded once.

Two kinds of file are known by their settings: byte-level BPE split by the usual
pattern, and BPE with word ends whose text is lower-cased and loses its white space.
In both, a space between two characters that are no white space is an end of
pieces, so a text's ids are those of its space-separated chunks, one after another.
Chunks of ordinary Latin characters go to the library's BPE model piece by piece;
all others go through the library's whole chain. Texts with other blanks around a
space are encoded whole, and so are texts that hold an added token of the file
(``<|endoftext|>``), which has one id of its own wherever it stands.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex

CACHE = 500_000
EMPTY = b""
#: Characters that composing leaves alone, whose lower case is one character.
PLAIN = regex.compile(r"[\t\n\x21-\x7eÀ-įĲ-ňŊ-ſ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Blank(Exception):
    """A chunk is empty, or starts or ends with white space."""


class _Recent(dict):
    """Values of short strings, made at need. Full, it becomes the older half, from
    which what is used again comes back; the half before it goes."""

    def __init__(self, make) -> None:
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class TextIds:
    """Ids of texts, as little-endian unsigned 32-bit integers, by the file at ``path``."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        pre = told.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        self.lower = any(s["type"] == "Lowercase" for s in (told.get("normalizer") or {}).get("normalizers", []))
        byte_level = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not told.get("normalizer")
        word_ends = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and self.lower
        added = told.get("added_tokens") or []
        self.added = [a["content"] for a in added]
        # an added token that is looked for in the normalized text could be in any
        self.known = (byte_level or word_ends) and not any(a["normalized"] for a in added)
        if byte_level:
            import public_tokenizers

            self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        elif word_ends:
            self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.letters = _byte_letters()
        self.model = self.library.model
        self.words = _Recent(self.piece)
        # white space is dropped: where a chunk stands in its text makes no difference
        self.first = _Recent(lambda chunk: self.chunk("", chunk))
        self.spaced = self.first if word_ends else _Recent(lambda chunk: self.chunk(" ", chunk))

    def whole(self, text: str) -> bytes:
        """By the library's whole chain."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """By the library's BPE model."""
        lead, body = (self.letters[32], piece[1:]) if piece[0] == " " else ("", piece)
        if not (body.isascii() and body.isalnum()):  # those bytes stand for themselves
            lead, body = "", piece.encode().decode("latin1").translate(self.letters)
        found = self.model.tokenize(lead + body)
        if len(found) == 1:
            return found[0].id.to_bytes(4, "little")
        return array("I", [t.id for t in found]).tobytes()

    def chunk(self, lead: str, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Blank
        if not PLAIN(chunk):
            return self.whole(lead + chunk)
        text = lead + (chunk.lower() if self.lower else chunk)
        if chunk.isalpha():
            return self.piece(text)
        return EMPTY.join(map(self.words.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return EMPTY
        if self.known and not any(a in text for a in self.added):
            head, *rest = text.split(" ")
            try:
                return self.first[head] + EMPTY.join(map(self.spaced.__getitem__, rest))
            except _Blank:
                pass
        return self.whole(text)


_OPEN: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """The one of this process for ``path``, read at its first use."""
    if path not in _OPEN:
        _OPEN[path] = TextIds(path)
    return _OPEN[path]
