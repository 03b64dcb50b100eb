"""Secret scan, in DataFrame functions alone.

Base rules find assignments, access keys and long hexadecimal runs. Beside them,
candidate strings (long runs of key characters) are scanned by a sliding window:
each step adds one character's count and takes one off, which changes the sum of
n log n by two table lookups, and so gives the window's Shannon entropy. A candidate
whose highest window is above the threshold of its character class is a span, unless
an allow-list pattern matches it or a base span already covers it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the base rules ---
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run that starts later in the same one is shorter: no match is lost
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "entropy"]
# --- end of fixed values ---

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Character classes, the first that matches counts: pattern, bits a character above which a window is no accident.
CLASSES = [(r"^[0-9a-fA-F-]+$", 3.1), (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.7), (r"^(?=.*[0-9])(?=.*[A-Za-z])", 3.7), (r"^(?=.*[a-z])(?=.*[A-Z])", 4.05)]
#: Strings that look random and are no secrets: words in one case or title case, joined words,
#: paths, UUIDs, digits alone, runs of one character, marked examples.
#: A repeated group is possessive, as Java's regex takes any other by recursion; the looks ahead make each part whole.
ALLOWED = [r"^[+/_=-]*+(?:[A-Z]?[a-z]++|[A-Z]++)(?=[+/_=-]|$)(?:[+/_=-]++(?:[A-Z]?[a-z]*+|[A-Z]++|[0-9]{1,4}+)(?=[+/_=-]|$))*+$", r"^[0-9+/_=-]+$", r"^(.)\1+$", r"(?i)example|sample|dummy|placeholder|changeme",
           r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"]

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, gate: Column, keep=None, group: int = 0) -> Column:
    """Leftmost matches that do not overlap, as ``(start, kind, end)`` in code points.
    What lies between matches is as long as their distance. ``keep`` decides by the
    match's ``group``."""
    rule = F.lit(pattern)
    found, between = F.regexp_extract_all(text, rule, F.lit(0)), F.split(text, pattern, -1)
    parts = F.regexp_extract_all(text, rule, F.lit(group)) if group else found
    zipped = F.zip_with(F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("skip"), F.length(m).alias("size"))), parts,
                        lambda p, g: F.struct(p["skip"].alias("skip"), p["size"].alias("size"), g.alias("part")))
    matches = F.slice(zipped, 1, F.size(found))

    def step(a: Column, m: Column) -> Column:
        start = a["at"] + m["skip"]
        end = start + m["size"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = F.concat(a["spans"], F.array(span))
        return F.struct(end.alias("at"), (F.when(keep(m["part"]), kept).otherwise(a["spans"]) if keep else kept).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.when(gate, F.aggregate(matches, start, step, lambda a: a["spans"])).otherwise(F.array().cast(SPAN))


def highest_entropy(text: Column, window: int = WINDOW, alphabet: str = ALPHABET) -> Column:
    """Highest Shannon entropy (bits a character) of ``text``'s windows; characters out
    of ``alphabet`` count as one. A text shorter than ``window``: null."""
    weight = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(window + 2)))
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))

    def counted(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda n, i: F.when(i == code, n + by).otherwise(n))

    def top(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            new = F.get(codes, i)
            n = F.get(a["counts"], new)
            more = counted(a["counts"], new, 1)
            sum_more = a["sum"] + F.get(weight, n + 1) - F.get(weight, n)
            old = F.get(codes, i - window)
            m = F.get(more, old)
            less = F.when(i >= window, counted(more, old, -1)).otherwise(more)
            sum_less = F.when(i >= window, sum_more + F.get(weight, m - 1) - F.get(weight, m)).otherwise(sum_more)
            top = F.when(i >= window - 1, F.greatest(a["top"], math.log2(window) - sum_less / window)).otherwise(a["top"])
            return F.struct(less.alias("counts"), sum_less.alias("sum"), top.alias("top"))

        return F.aggregate(steps, start, step, lambda a: a["top"])

    start = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("top"))
    steps = F.sequence(F.lit(0), F.length(text) - 1)
    # the codes stay out of the state, which is copied at each step
    return F.when(F.length(text) >= window, F.get(F.transform(F.array(codes), top), 0))


def _random(candidate: Column) -> Column:
    """Whether a candidate is a span."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        least = F.when(candidate.rlike(pattern), bits).otherwise(least)
    return F.when(allowed | least.isNull(), False).otherwise(highest_entropy(candidate) >= least)


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: an array of ``(start, kind, end)`` by start, then kind; the
    kinds are numbered as in ``KINDS``; places are code points, ends are exclusive. Null
    text counts as empty. Row-local: repeated rows, null ids and other columns pass
    through; a column named ``out`` is replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, 0, text.rlike(ASSIGN_GATE), lambda g: F.length(g) >= 8, 2),
                    _spans(text, ACCESS, 1, text.contains("AKIA")), _spans(text, HEX, 2, text.rlike(HEX)))
    found = docs.withColumn("_base", base).withColumn("_more", _spans(text, CANDIDATE, 3, text.rlike(CANDIDATE), _random))
    uncovered = F.filter("_more", lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.withColumn(out, F.array_sort(F.concat("_base", uncovered))).drop("_base", "_more")


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id", spans: str = "secrets") -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, base_sha256, spans)`` from ``find_secrets``;
    the counts and the digest are those of base spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] < 3)
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select(id_col, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col(spans)).alias("spans"))


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of each span of ``text_col``; spans that overlap
    count as one. A text without spans, a null one too, stays as it is."""
    found = find_secrets(docs, text_col, "_secrets")
    text = F.col(text_col)

    def step(a: Column, s: Column) -> Column:
        before = F.concat(a["text"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], before).otherwise(a["text"]).alias("text"))

    masked = F.aggregate("_secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step,
                         lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("_secrets") > 0, masked).otherwise(text)).select(docs.columns)
