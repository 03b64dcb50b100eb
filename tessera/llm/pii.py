"""Personal data: base rules, and a character-level bidirectional LSTM with a CRF.

The rules give the base spans. The model adds what they miss: it is trained in numpy
on windows of documents labelled by the rules, and on labelled variants of such data
that the rules do not reach (a phone number without its plus sign, an address with
its at sign or dots spelled out). Texts are cut into overlapping windows. The CRF
allows a span only around an anchor (a digit, an at sign or its spelling), so windows
without one cannot hold a span and are not run. Each window is decoded on its own. A span
that comes near a window's inner edge and that no other window holds whole is decoded again in
a window twice as wide around it, until its edges are inside or it can be no plausible
span any more. Of all plausible spans those of the largest total confidence that do not
overlap are taken, over the whole text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: kinds and base rules ---
KINDS = ["email", "ip", "card", "phone"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# --- end of fixed values ---
# The same rules in parts, for scans that look at no character twice.
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
NUMBER = re.compile(r"[0-9]++")
# What may stand in a plausible span of each kind.
PIECES = [re.compile(p) for p in (r"[\w.%+()\[\]@ -]*", r"[0-9. ()\[\]dot]*", r"[0-9 ./-]*", r"[+() 0-9./-]*")]

ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]")
ANCHOR_SQL = r"[0-9@]|[(\[]at[)\]]"
WIDTH, STRIDE = 96, 48
MARGIN = 10  # so near an inner edge a span may go on beyond it
HIDDEN, EMBED, CHARS, TAGS = 20, 14, 104, 1 + 2 * len(KINDS)
SAMPLE_DOCS, SAMPLE_WINDOWS, MADE_WINDOWS = 300, 700, 1500
CONFIDENCE = 0.6

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """The matches of ``EMAIL``, each found from its at sign: its name reaches back to the last
    character that is none of a name's, or to the previous match. Linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in NAME:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield 0, start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[Span]:
    """The matches of ``IP`` that are addresses: of each chain of numbers joined by dots, every
    four in turn."""
    for chain in CHAIN.finditer(text):
        parts = list(NUMBER.finditer(chain[0]))
        for k in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0]) <= 255 for p in parts[k:k + 4]):
                yield 1, chain.start() + parts[k].start(), chain.start() + parts[k + 3].end()


def base_spans(text: str) -> list[Span]:
    """By kind, then start. Linear in the text, also in runs without a blank."""
    found: list[Span] = [*_emails(text)]
    if re.search("[0-9]", text):
        found += _addresses(text)
        found += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def may_go_on(kind: int, part: str) -> bool:
    """Whether ``part`` can be a piece of a plausible span: no character that such a span
    has not, and no more digits than it may have."""
    most = {1: 12, 2: 19, 3: 15}.get(kind)
    return PIECES[kind].fullmatch(part) is not None and (most is None or len(_digits(part)) <= most)


def plausible(kind: int, text: str) -> bool:
    """Whether a span of the model can be what it says."""
    digits = _digits(text)
    if text != text.strip():
        return False
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|[(\[]at[)\]]) ?[\w-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[\w-]+)+", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?: ?(?:\.|[(\[]dot[)\]]) ?[0-9]{1,3}){3}", text)) and all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", text))
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][ ().0-9/-]+[0-9]", text)) and bool(re.search(r"[()]|[0-9][ ./-][0-9]", text))


# --- windows and characters ---

def char_ids(text: str) -> np.ndarray:
    """Printable ASCII has its own numbers; other letters, blanks, breaks and the rest one each; 0 pads."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ids = np.where((codes >= 32) & (codes < 127), codes.astype(np.int64) - 31, 96)
    for i in np.flatnonzero(ids == 96):
        c = text[i]
        ids[i] = 97 if c == "\n" else 98 if c.isspace() else 99 if c.isalpha() else 100
    return ids


def windows(text: str) -> list[int]:
    """Starts of the windows that hold an anchor."""
    last = max(0, -(-(len(text) - WIDTH) // STRIDE))
    found: set[int] = set()
    for m in ANCHOR.finditer(text):
        i = m.start() // STRIDE
        found.update(k for k in (i - 1, i) if 0 <= k <= last)
    return sorted(k * STRIDE for k in found)


def window_tags(spans: list[Span], start: int, end: int) -> np.ndarray:
    """Tags of one window; a span that its edge cuts is cut."""
    tags = np.zeros(end - start, np.int64)
    for kind, a, b in spans:
        a, b = max(a, start) - start, min(b, end) - start
        if a < b:
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
    return tags


# --- model ---

def _allowed() -> np.ndarray:
    """An inner tag follows the first or an inner tag of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


FORBIDDEN = -1e4
ALLOWED = _allowed()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, two LSTMs in either direction, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 7) -> None:
        rnd = np.random.default_rng(seed)
        size = EMBED + HIDDEN
        self.p = {"embed": rnd.normal(0, 0.3, (CHARS, EMBED)), "out": rnd.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS),
                  "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for way in ("ahead", "back"):
            self.p[way] = rnd.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN))
            self.p[way + "_b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """States of one direction over (time, row, embedding), and what the way back needs."""
        weights, bias = self.p[way], self.p[way + "_b"]
        steps, rows = x.shape[:2]
        h, c = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
        out, kept = np.zeros((steps, rows, HIDDEN)), [None] * steps
        for t in range(steps) if way == "ahead" else range(steps - 1, -1, -1):
            z = np.concatenate([x[t], h], axis=1)
            g = z @ weights + bias
            i, f, o = (_sigmoid(g[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            n = np.tanh(g[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c_new = f * c + i * n
            kept[t] = (z, i, f, o, n, c, np.tanh(c_new), m)
            h, c = np.where(m, o * np.tanh(c_new), 0), np.where(m, c_new, 0)
            out[t] = h
        return out, kept

    def _run_back(self, d_out: np.ndarray, kept: list, way: str, grad: dict) -> np.ndarray:
        weights = self.p[way]
        steps, rows = d_out.shape[:2]
        d_x = np.zeros((steps, rows, EMBED))
        d_h, d_c = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
        d_w, d_b = np.zeros_like(weights), np.zeros(4 * HIDDEN)
        for t in range(steps - 1, -1, -1) if way == "ahead" else range(steps):
            z, i, f, o, n, c, tanh_c, m = kept[t]
            d_h = np.where(m, d_h + d_out[t], 0)
            d_c = np.where(m, d_c, 0) + d_h * o * (1 - tanh_c ** 2)
            d_g = np.concatenate([d_c * n * i * (1 - i), d_c * c * f * (1 - f), d_h * tanh_c * o * (1 - o), d_c * i * (1 - n ** 2)], axis=1)
            d_w += z.T @ d_g
            d_b += d_g.sum(axis=0)
            d_z = d_g @ weights.T
            d_x[t], d_h, d_c = d_z[:, :EMBED], d_z[:, EMBED:], d_c * f
        grad[way], grad[way + "_b"] = d_w, d_b
        return d_x

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (time, row, tag) of windows ``ids`` (row, time; 0 pads the end)."""
        mask = ids.T > 0
        x = self.p["embed"][ids.T]
        ahead, kept_a = self._run(x, mask, "ahead")
        back, kept_b = self._run(x, mask, "back")
        both = np.concatenate([ahead, back], axis=2)
        return both @ self.p["out"] + self.p["bias"], (mask, both, kept_a, kept_b)

    def _moves(self) -> tuple[np.ndarray, np.ndarray]:
        start = self.p["first"].copy()
        return np.where(ALLOWED, self.p["move"], FORBIDDEN), start

    def posteriors(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the CRF: log partition (row), marginals (time, row, tag), expected moves (tag, tag)."""
        move, first = self._moves()
        steps, rows, _ = scores.shape
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[0] = first + scores[0]
        for t in range(1, steps):
            x = alpha[t - 1][:, :, None] + move
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1)) + scores[t]
            alpha[t] = np.where(mask[t][:, None], new, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            x = move + (scores[t + 1] + beta[t + 1])[:, None, :]
            top = x.max(axis=2)
            new = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
            beta[t] = np.where(mask[t + 1][:, None], new, beta[t + 1])
        top = alpha[-1].max(axis=1)
        total = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))
        tags = np.exp(alpha + beta - total[:, None]) * mask[:, :, None]
        moves = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            pair = alpha[t - 1][:, :, None] + move + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
            moves += (np.exp(pair) * mask[t][:, None, None]).sum(axis=0)
        return total, tags, moves

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        scores, (mask, both, kept_a, kept_b) = self.emissions(ids)
        total, marginal, moves = self.posteriors(scores, mask)
        y, rows = tags.T, len(ids)
        one = np.eye(TAGS)[y] * mask[:, :, None]
        move, first = self._moves()
        path = (scores * one).sum() + first[y[0]].sum()
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (y[:-1][mask[1:]], y[1:][mask[1:]]), 1)
        path += (move * seen).sum()
        d_scores = (marginal - one) / rows
        grad = {"move": (moves - seen) / rows * ALLOWED, "first": (marginal[0] - one[0]).sum(axis=0) / rows,
                "out": np.einsum("trh,trk->hk", both, d_scores), "bias": d_scores.sum(axis=(0, 1))}
        d_both = d_scores @ self.p["out"].T
        d_x = self._run_back(d_both[:, :, :HIDDEN], kept_a, "ahead", grad) + self._run_back(d_both[:, :, HIDDEN:], kept_b, "back", grad)
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], ids.T, d_x)
        return float((total.sum() - path) / rows), grad

    def fit(self, ids: np.ndarray, tags: np.ndarray, rounds: int = 10, batch: int = 32, rate: float = 0.015, seed: int = 3) -> list[float]:
        """Adam; returns the mean loss of each round."""
        rnd, losses, step = np.random.default_rng(seed), [], 0
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for r in range(rounds):
            order, sums = rnd.permutation(len(ids)), []
            for at in range(0, len(order), batch):
                part = order[at:at + batch]
                width = int((ids[part] > 0).sum(axis=1).max(initial=1))
                loss, grad = self.gradient(ids[part, :width], tags[part, :width])
                sums.append(loss)
                step += 1
                norm = np.sqrt(sum((g ** 2).sum() for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g ** 2
                    rated = rate * (0.5 if r >= rounds - 3 else 1.0)
                    self.p[k] -= rated * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
            losses.append(float(np.mean(sums)))
        return losses

    def decode(self, texts: list[str]) -> list[list[tuple[Span, float]]]:
        """Spans of each window by the best path, with the least posterior of their tags."""
        width = max(map(len, texts))
        ids = np.zeros((len(texts), width), np.int64)
        for row, text in enumerate(texts):
            ids[row, :len(text)] = char_ids(text)
        scores, (mask, *_) = self.emissions(ids)
        _, marginal, _ = self.posteriors(scores, mask)
        move, first = self._moves()
        best, came = first + scores[0], np.zeros(scores.shape, np.int64)
        for t in range(1, width):
            x = best[:, :, None] + move
            came[t] = np.where(mask[t][:, None], x.argmax(axis=1), np.arange(TAGS))
            best = np.where(mask[t][:, None], x.max(axis=1) + scores[t], best)
        tag = best.argmax(axis=1)
        path = np.zeros((width, len(texts)), np.int64)
        for t in range(width - 1, -1, -1):
            path[t] = tag
            tag = came[t][np.arange(len(texts)), tag]
        out = []
        for row, text in enumerate(texts):
            tags, spans, at = path[:len(text), row], [], 0
            while at < len(text):
                if tags[at] % 2 == 0:  # outside, or an inner tag that starts a window
                    at += 1
                    continue
                end = at + 1
                while end < len(text) and tags[end] == tags[at] + 1:
                    end += 1
                sure = min(marginal[t, row, tags[t]] for t in range(at, end))
                spans.append((((int(tags[at]) - 1) // 2, at, end), float(sure)))
                at = end
            out.append(spans)
        return out


def reconcile(found: list[tuple[Span, float]]) -> list[Span]:
    """Spans that do not overlap, of the largest total confidence (a span of several
    windows has that of its best one)."""
    best: dict[Span, float] = {}
    for span, sure in found:
        best[span] = max(best.get(span, 0.0), sure)
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    value: list[tuple[float, int | None]] = []  # best total up to each span, and where it goes on
    ends = [s[2] for s in spans]
    from bisect import bisect_right

    totals = [0.0]
    for n, span in enumerate(spans):
        before = bisect_right(ends, span[1], 0, n)
        taken = totals[before] + best[span] * (span[2] - span[1])
        value.append((taken, before) if taken > totals[-1] else (totals[-1], None))
        totals.append(max(totals[-1], taken))
    chosen, n = [], len(spans)
    while n:
        _, before = value[n - 1]
        if before is None:
            n -= 1
        else:
            chosen.append(spans[n - 1])
            n = before
    return chosen[::-1]


def added_spans(tagger: Tagger, texts: list[str], confidence: float = CONFIDENCE, rows: int = 256) -> list[list[Span]]:
    """For each whole text, what the model finds beside the base spans."""
    found: list[list[tuple[Span, float]]] = [[] for _ in texts]
    wide: list[tuple[int, int, int]] = [(i, a, min(a + WIDTH, len(text))) for i, text in enumerate(texts) for a in windows(text)]
    while wide:
        cut: list[tuple[int, int, int, int, int]] = []
        for part in _batches(wide, rows):
            for (i, lo, hi), spans in zip(part, tagger.decode([texts[i][lo:hi] for i, lo, hi in part])):
                for (kind, b, e), sure in spans:
                    if (b < MARGIN and lo > 0) or (lo + e > hi - MARGIN and hi < len(texts[i])):
                        cut.append((i, kind, lo + b, lo + e, hi - lo))
                    elif sure >= confidence:
                        found[i].append(((kind, lo + b, lo + e), sure))
        # a cut span that no window holds whole is decoded again in a window twice as wide around it
        wide = sorted({(i, max(0, b - width), min(len(texts[i]), e + width)) for i, kind, b, e, width in cut
                       if may_go_on(kind, texts[i][b:e]) and not any(k == kind and x < e and b < y for (k, x, y), _ in found[i])})
    out = []
    for text, spans in zip(texts, found):
        base = base_spans(text)
        fit = [(s, sure) for s, sure in spans if plausible(s[0], text[s[1]:s[2]]) and not any(b < s[2] and s[1] < e for _, b, e in base)]
        out.append(reconcile(fit))
    return out


def _batches(windows: list[tuple[int, int, int]], rows: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of like width together, ``rows`` of the usual width or fewer wider ones."""
    part: list[tuple[int, int, int]] = []
    for w in sorted(windows, key=lambda w: (w[2] - w[1], w)):
        if part and (len(part) + 1) * (w[2] - w[1]) > rows * WIDTH:
            yield part
            part = []
        part.append(w)
    if part:
        yield part


# --- training data ---

def made_windows(contexts: list[str], n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Labelled windows: personal data in the forms the rules know and in others, and
    numbers that are none, among words of ``contexts``."""
    rnd = random.Random(seed)
    words = [w for c in contexts for w in c.split() if not ANCHOR.search(w)] or ["the", "and", "of", "to", "word"]
    digits = lambda k: "".join(rnd.choices("0123456789", k=k))
    word = lambda: re.sub(r"[^A-Za-z]", "", rnd.choice(words)) or "name"

    def name() -> str:
        """A word, or letters that are none."""
        return word().lower() if rnd.random() < 0.5 else "".join(rnd.choices("abcdefghijklmnoprstuvwyz", k=rnd.randrange(3, 11)))

    def email() -> str:
        user = name() + rnd.choice(["", ".", "_", "-"]).join(["", rnd.choice([name(), digits(2)])])
        host = rnd.choice(["mail", "example", "post", name(), name()]) + rnd.choice(["", "", digits(1)])
        at, dot = rnd.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", ".")])
        more = [name() for _ in range(rnd.choice([0, 0, 0, 1, 1, 2, 3]))]
        return user + at + dot.join([host, *more, rnd.choice(["com", "org", "net", "de", "example"])])

    def ip() -> str:
        return rnd.choice([".", ".", " . ", "[dot]"]).join(str(rnd.randrange(256)) for _ in range(4))

    def card() -> str:
        body = rnd.choice("3456") + digits(rnd.choice([14, 14, 12]))
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return rnd.choice(["", " ", "-"]).join(body[i:i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        area, rest = digits(3), (digits(3), digits(4))
        lead = rnd.choice(["+1 ", "+44 ", "+49-", "", "", "1 "])
        return lead + rnd.choice([f"({area}) {rest[0]}-{rest[1]}", f"{area}-{rest[0]}-{rest[1]}", f"({area}) {rest[0]} {rest[1]}", f"{area}.{rest[0]}.{rest[1]}"])

    def none() -> str:
        return rnd.choice([
            lambda: digits(rnd.randrange(1, 9)), lambda: f"{rnd.randrange(1900, 2100)}-{rnd.randrange(1, 13):02}-{rnd.randrange(1, 29):02}",
            lambda: f"{rnd.randrange(1, 29)}/{rnd.randrange(1, 13)}/{rnd.randrange(1900, 2100)}", lambda: f"{digits(2)}.{digits(2)}", lambda: f"v{rnd.randrange(9)}.{rnd.randrange(20)}.{rnd.randrange(20)}",
            lambda: "".join(rnd.choices("0123456789abcdef", k=rnd.randrange(12, 41))), lambda: f"{digits(3)},{digits(3)}.{digits(2)}", lambda: "@" + word(), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
            lambda: f"{digits(3)}-{digits(2)}", lambda: f"#{digits(10)}", lambda: f"{digits(4)}-{digits(4)}-{digits(4)}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", lambda: f"§ {digits(3)} ({digits(1)})"])()

    out = []
    makers = [email, ip, card, phone]
    for _ in range(n):
        text, spans = " ".join(rnd.choices(words, k=rnd.randrange(0, 7))), []
        for _ in range(rnd.choice([1, 1, 2])):
            kind = rnd.randrange(6)
            text += rnd.choice([" ", " ", ": ", " (", ", ", "\n"]) if text else ""
            piece = makers[kind]() if kind < 4 else none()
            if kind < 4:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + rnd.choice([" ", ". ", ", ", ") ", "\n"]) + " ".join(rnd.choices(words, k=rnd.randrange(0, 5)))
        start = rnd.randrange(max(1, len(text) - WIDTH + 1))
        out.append((text, [(k, a - start, b - start) for k, a, b in spans]) if start == 0 else
                   (text[start:], [(k, max(0, a - start), b - start) for k, a, b in spans if b > start]))
    return [(t[:WIDTH], s) for t, s in out]


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = SAMPLE_DOCS, max_windows: int = SAMPLE_WINDOWS) -> list[str]:
    """Windows of a bounded sample: of the documents with anchors the ``max_docs`` of least
    hash, at most five windows of each, those of least hash, ``max_windows`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                mine = sorted(windows(text), key=lambda a: hashlib.md5(f"{a}".encode()).digest())[:5]
                out += [text[a:a + WIDTH] for a in mine]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["window"])

    some = docs.where(F.col(text_col).rlike(ANCHOR_SQL)).select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    sample = docs.join(F.broadcast(some), docs[id_col] == some["_id"]).where(F.col(text_col).isNotNull()).select(text_col)
    rows = sample.mapInArrow(run, "window string").orderBy(F.xxhash64("window"), "window").limit(max_windows).collect()
    return [r["window"] for r in rows]


def labelled(found: list[str], made: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    rows = [(t, base_spans(t)) for t in found] + made
    ids, tags = np.zeros((len(rows), WIDTH), np.int64), np.zeros((len(rows), WIDTH), np.int64)
    for i, (text, spans) in enumerate(rows):
        ids[i, :len(text)] = char_ids(text)
        tags[i, :len(text)] = window_tags(spans, 0, len(text))
    return ids, tags


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 10) -> Tagger:
    """A tagger from a bounded sample of ``docs`` labelled by the rules, and made windows."""
    found = training_windows(docs, id_col, text_col)
    tagger = Tagger()
    tagger.fit(*labelled(found, made_windows(found, MADE_WINDOWS)), rounds=rounds)
    return tagger


# --- operator ---

def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, base, added)`` for each row: arrays of ``(kind, start, end)`` in code
    points, ends exclusive, by kind as in ``KINDS`` and start. Null text: empty. Row-local:
    repeated rows and null ids pass through, other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p)  # some thousand numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        tagger.p = shared.value
        told = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            some = [i for i, t in enumerate(texts) if ANCHOR.search(t)]
            base, more = [[] for _ in texts], [[] for _ in texts]
            for i, spans in zip(some, added_spans(tagger, [texts[i] for i in some])):
                base[i], more[i] = told(base_spans(texts[i])), told(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(more, kind)], names=[id_col, "base", "added"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("base", T.DataType.fromDDL(spans)),
                           T.StructField("added", T.DataType.fromDDL(spans))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans)``: counts and digest of
    base spans, and all spans, written ``kind:start:end``."""

    def count(name: str):
        return F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    order = F.array(*map(F.lit, KINDS))
    placed = F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(order, s["kind"]).alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(id_col, *map(count, KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.array_sort(placed)).alias("spans"))
