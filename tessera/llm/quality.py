"""Quality filter by a character n-gram model with interpolated modified Kneser-Ney smoothing.

Training counts the n-grams of trusted texts, a bounded sample of the labelled rows of
each language, per language and over all languages together. Counts are tables sharded by
n-gram: lower orders come from them by aggregation (in how many contexts an n-gram is seen),
and discounts and context totals are joined to them to give probabilities. The model
is bounded by the sample and by the alphabet. The n-grams seen go to the executors, which
make one row of probabilities for each context seen, and a table from every context to
the row of its longest seen ending; documents are scored where they are read:
a join of all their n-grams with the counts would shuffle several times the input.

Each language has an alphabet of its own: its most frequent characters are one symbol,
all others two, so that a script of thousands of characters has all of them.

A document is judged by its perplexity, drawn towards that of trusted texts for short
ones, against a quantile of all held-out trusted texts of its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import stored

ORDER = 4
BITS = 7  # a symbol; 0 is the start of a text
SINGLE = 95  # characters of one symbol, from 1 on; the symbols after them begin a pair
PAIRS = ((1 << BITS) - 1 - SINGLE) * ((1 << BITS) - 1)
PLANE = 1 << 16
TRUSTED_DOCS = 2_000  # counted of each language, about
HELD_OUT = 4  # one trusted text in so many is kept for the thresholds
OWN_TEXTS = 20  # held-out texts that a language needs for a model of its own
QUANTILE = 0.99
SLACK = 1.15
PRIOR_CHARS = 100
ANY = "*"
SEGMENT = 400_000


@dataclass
class Alphabet:
    """``first`` and ``second`` symbol of each code point of the basic plane (0: no second
    one). Code points above it share the places of the private-use area."""

    first: np.ndarray
    second: np.ndarray

    @classmethod
    def by_rank(cls, codes: np.ndarray) -> Alphabet:
        """``codes`` from the most frequent on. Characters past the last pair, and those
        that are not among ``codes``, share pairs."""
        pair = np.arange(PLANE) * 40503 % PLANE % PAIRS
        pair[codes[SINGLE:]] = np.arange(max(len(codes) - SINGLE, 0)) % PAIRS
        low, high = pair % ((1 << BITS) - 1), pair // ((1 << BITS) - 1)
        first, second = (SINGLE + 1 + high).astype(np.uint8), (1 + low).astype(np.uint8)
        single = codes[:SINGLE]
        first[single], second[single] = np.arange(1, len(single) + 1), 0
        first[0] = second[0] = 0
        return cls(first, second)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols, and where those of each character begin (one more: the end)."""
        codes = _codes(text)
        first, second = self.first[codes], self.second[codes]
        two = second > 0
        at = np.concatenate([[0], np.cumsum(1 + two)])
        if not two.any():
            return first.astype(np.int64), at
        symbols = np.zeros(at[-1], np.int64)
        symbols[at[:-1]] = first
        symbols[at[1:][two] - 1] = second[two]
        return symbols, at


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < PLANE, codes, 0xE000 + codes % 0x1900)


def _segments(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in pieces, each after the symbols before it, about ``SEGMENT`` characters at a time."""
    start = "\0" * (ORDER - 1)
    rows, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), SEGMENT):
            rows.append(i)
            pieces.append((start + text[:SEGMENT]) if at == 0 else text[at - ORDER + 1:at + SEGMENT])
            size += len(pieces[-1])
            if size >= SEGMENT:
                yield rows, pieces
                rows, pieces, size = [], [], 0
    if rows:
        yield rows, pieces


def _keys(symbols: np.ndarray, order: int) -> np.ndarray:
    """For each position from ``order - 1`` on, the symbols up to it as one number."""
    n = len(symbols) - order + 1
    key = np.zeros(max(n, 0), np.int64)
    for k in range(order):
        key = key << BITS | symbols[k:k + max(n, 0)]
    return key


@dataclass
class Language:
    """The n-grams seen (``size``, ``gram``, ``own``, ``rest``). That is what travels; each
    process makes the two tables from it when it first needs them."""

    alphabet: Alphabet
    grams: dict[str, np.ndarray]

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Context -> row, and row x symbol -> natural log of the probability; from the
        shortest contexts to the longest."""
        symbols = 1 << BITS
        row_of = np.zeros(1, np.int32)
        rows = [np.full((1, symbols), 1 / symbols)]
        for size in range(1, ORDER + 1):
            mine = self.grams["size"] == size
            gram, own, rest = (self.grams[k][mine] for k in ("gram", "own", "rest"))
            contexts, first, place = np.unique(gram >> BITS, return_index=True, return_inverse=True)
            row_of = np.tile(row_of, symbols) if size > 1 else row_of  # the ending decides, whatever comes before it
            before = np.concatenate(rows)
            made = rest[first][:, None] * before[row_of[contexts]]
            made[place, gram & (symbols - 1)] += own
            row_of[contexts] = len(before) + np.arange(len(contexts))
            rows = [before, made]
        return row_of, np.log(np.concatenate(rows)).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def log_probability(self, texts: list[str]) -> np.ndarray:
        """Natural log of each text's probability."""
        total = np.zeros(len(texts))
        row_of, rows_of = self.tables
        for rows, pieces in _segments(texts):
            symbols, at = self.alphabet.encode("".join(pieces))
            context = _keys(symbols, ORDER - 1)[:-1]
            value = rows_of[row_of[context], symbols[ORDER - 1:]]
            ends = np.cumsum([len(p) for p in pieces])
            for row, a, b in zip(rows, [0, *ends[:-1]], ends):  # a piece's own characters follow its context
                total[row] += value[at[a + ORDER - 1] - ORDER + 1:at[b] - ORDER + 1].sum(dtype=np.float64)
        return total


@dataclass
class Limit:
    """How a language is judged: by which model, the mean of its trusted texts (natural log
    a character), the highest perplexity that stays."""

    model: str = ANY
    mean: float = 0.0
    threshold: float = float("inf")


@dataclass
class Model:
    """A language not in ``limits`` is judged as all languages together (``ANY``) are."""

    languages: dict[str, Language] = field(default_factory=dict)
    limits: dict[str, Limit] = field(default_factory=dict)

    def limit(self, lang: str | None) -> Limit:
        return self.limits.get(lang or ANY) or self.limits.get(ANY) or Limit()

    def of(self, lang: str | None) -> Language | None:
        return self.languages.get(self.limit(lang).model)

    def log_probability(self, texts: list[str], lang: str | None) -> np.ndarray:
        return self.of(lang).log_probability(texts)

    def perplexity(self, texts: list[str], lang: str | None) -> np.ndarray:
        """Per character, as if ``PRIOR_CHARS`` typical trusted ones came before."""
        n = np.array([len(t) for t in texts], float)
        return np.exp((PRIOR_CHARS * self.limit(lang).mean - self.log_probability(texts, lang)) / (n + PRIOR_CHARS))


def _by_name(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """The texts (second column) of a batch by the names in its first."""
    groups: dict[str, list[str]] = {}
    for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        groups.setdefault(name, []).append(text)
    yield from groups.items()


def _alphabets(trusted: DataFrame) -> dict[str, Alphabet]:
    """By falling count of the characters, for each language and for all together. What is
    collected has as many rows a language as there are characters of one or two symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, texts in _by_name(batch):
                code, n = np.unique(np.concatenate([_codes(t) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    seen = trusted.mapInArrow(run, "lang string, code long, n long").where("code > 0")
    counts = seen.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.unionByName(counts.where(F.col("lang") != ANY).withColumn("lang", F.lit(ANY))).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))  # 65,536 rows a language at most
    first = counts.withColumn("rank", rank).where(F.col("rank") <= SINGLE + PAIRS).orderBy("lang", "rank").toArrow()
    names, codes = np.array(first["lang"].to_pylist(), object), first["code"].to_numpy()
    return {name: Alphabet.by_rank(codes[names == name]) for name in sorted(set(names))}


def _top_counts(trusted: DataFrame, alphabets: dict[str, Alphabet]) -> DataFrame:
    """``(lang, gram, n)`` for the n-grams of full length, per language and over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_name(batch):
                for name in sorted({lang, ANY}):
                    for _, pieces in _segments(texts):
                        grams = []
                        for piece in pieces:
                            symbols, at = alphabets[name].encode(piece)
                            grams.append(_keys(symbols, ORDER)[at[ORDER - 1] - ORDER + 1:])
                        gram, n = np.unique(np.concatenate(grams), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    return trusted.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _probabilities(top: DataFrame) -> DataFrame:
    """``(lang, size, gram, own, rest)`` for n-grams of each size seen: ``own`` is the
    discounted probability of the last symbol after the others, ``rest`` the weight
    that their context leaves to the next shorter one."""
    orders, counts = [], top
    for size in range(ORDER, 0, -1):
        orders.append(counts.select("lang", F.lit(size).alias("size"), "gram", "n"))
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * (size - 1)) - 1)).alias("gram")
        counts = counts.select("lang", shorter).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    grams = orders[0]
    for other in orders[1:]:
        grams = grams.unionByName(other)
    seen = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    # where too few n-grams are seen so often, a plain discount
    plain = [k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}") for k in (1, 2, 3)]
    discount = [F.when(d.isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), d))) for k, d in enumerate(plain, 1)]
    discounts = grams.groupBy("lang", "size").agg(*seen).select("lang", "size", *(d.alias(f"d{k}") for k, d in enumerate(discount, 1)))
    context = F.shiftright("gram", BITS).alias("context")
    counted = grams.select("*", context).join(F.broadcast(discounts), ["lang", "size"])  # a row for each language and size
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    counted = counted.withColumn("taken", taken)
    totals = counted.groupBy("lang", "size", "context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("rest"))
    joined = counted.join(totals, ["lang", "size", "context"])
    return joined.select("lang", "size", "gram", ((F.col("n") - F.col("taken")) / F.col("total")).alias("own"), "rest")


def train(docs: DataFrame, labels: DataFrame, trusted: str = "quality = 1 and toxic = 0", max_docs: int = TRUSTED_DOCS,
          quantile: float = QUANTILE, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the whole texts of the labelled rows that ``trusted`` names. One in ``HELD_OUT``
    of them, by a hash of its id, is not counted but sets the thresholds, whatever their
    number: ``slack`` times the ``quantile`` of perplexity. Of the others about ``max_docs``
    of each language, by another hash, are counted, so that what is collected is bounded. A language
    with fewer than ``OWN_TEXTS`` held-out texts is judged by the model over all, against
    the quantile of its own texts under that model or that of all texts, the higher of
    both. A null language has the model over all. No trusted text: an empty model."""
    ids = labels.where(trusted).select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(lang_col, F.lit(ANY)).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.where("text <> ''").withColumn("_held", F.pmod(F.xxhash64("_doc", F.lit("fold")), F.lit(HELD_OUT)) == 0)
    known = F.col("_doc") == F.col("_id")
    free = rows.where("not _held")
    sizes = {r["lang"]: r["n"] for r in free.join(ids, known).groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return Model()
    most = F.create_map(*(F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1 << 31, max_docs * (1 << 31) // n))))[F.col("lang")]
    picked = F.pmod(F.xxhash64("_doc", F.lit("pick")), F.lit(1 << 31)) < most
    counted = stored(free.where(picked).join(ids, known).select("lang", "text"), "trusted")  # few texts: they are read twice
    alphabets = _alphabets(counted)
    table = _probabilities(_top_counts(counted, alphabets)).toArrow()  # bounded by the sample and the alphabet
    lang = np.array(table["lang"].to_pylist(), object)
    kinds = {"size": "i1", "gram": "i4", "own": "f4", "rest": "f4"}
    columns = {k: table[k].to_numpy().astype(kind) for k, kind in kinds.items()}
    models = {name: Language(alphabets[name], {k: v[lang == name] for k, v in columns.items()}) for name in sorted(set(lang))}
    if not models:
        return Model()
    held = rows.where("_held").join(ids, known).select("lang", "text")
    limits = _limits(stored(held.mapInArrow(_scores(models), "lang string, model string, sum double, n long"), "held"), quantile, slack)
    return Model({name: models[name] for name in sorted({ANY} | {x.model for x in limits.values()})}, limits)


def _scores(models: dict[str, Language]):
    """A row for each text and each model that may judge it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_name(batch):
                for name in sorted({lang, ANY} & set(models)):
                    columns = [[lang] * len(texts), [name] * len(texts), models[name].log_probability(texts), [len(t) for t in texts]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.int64()))],
                                                     names=["lang", "model", "sum", "n"])

    return run


def _limits(scored: DataFrame, quantile: float, slack: float) -> dict[str, Limit]:
    """From the sums of all held-out texts; a row a language and model is collected."""
    both = scored.unionByName(scored.where((F.col("model") == ANY) & (F.col("lang") != ANY)).withColumn("lang", F.lit(ANY)))
    means = both.groupBy("lang", "model").agg((-F.sum("sum") / F.sum("n")).alias("mean"))
    each = F.exp((PRIOR_CHARS * F.col("mean") - F.col("sum")) / (F.col("n") + PRIOR_CHARS))
    found = both.join(F.broadcast(means), ["lang", "model"]).groupBy("lang", "model").agg(
        F.first("mean").alias("mean"), F.percentile_approx(each, quantile, 100_000).alias("most"), F.count("*").alias("texts"))
    rows = {(r["lang"], r["model"]): r for r in found.collect()}
    limits = {}
    for lang in sorted({lang for lang, _ in rows}):
        own, pooled = rows.get((lang, lang)), rows[lang, ANY]
        if own is not None and own["texts"] >= OWN_TEXTS or lang == ANY:
            limits[lang] = Limit(lang, own["mean"], slack * own["most"])
        else:
            limits[lang] = Limit(ANY, pooled["mean"], slack * max(pooled["most"], rows[ANY, ANY]["most"]))
    return limits


def _by_language(langs: list[str | None], texts: list[str | None]) -> Iterator[tuple[str | None, list[int], list[str]]]:
    groups: dict[str | None, list[int]] = {}
    for i, lang in enumerate(langs):
        groups.setdefault(lang, []).append(i)
    for lang, rows in groups.items():
        yield lang, rows, [texts[i] or "" for i in rows]


def _judge(model: Model, langs: list[str | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Perplexity and threshold of each text; without a model, 1 and infinity."""
    found, most = np.ones(len(texts)), np.full(len(texts), np.inf)
    for lang, rows, own in _by_language(langs, texts):
        if model.of(lang) is not None:
            found[rows], most[rows] = model.perplexity(own, lang), model.limit(lang).threshold
    return found, most


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id_col, lang_col, length, perplexity, threshold, keep, model)`` for each row; ``model``
    is the language whose model judged, ``*`` for that over all. A null or
    empty text has the perplexity of trusted ones and is kept. A null or unknown language
    uses the model over all. Row-local: repeated rows and null ids pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found, most = _judge(shared.value, langs, texts)
            judges = pa.array([shared.value.limit(x).model for x in langs], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(found),
                                              pa.array(most), pa.array(found <= most), judges], names=names)

    names = [id_col, lang_col, "length", "perplexity", "threshold", "keep", "model"]
    kinds = [docs.schema[id_col].dataType, T.StringType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BooleanType(), T.StringType()]
    return docs.select(id_col, lang_col, text_col).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, most = _judge(shared.value, batch.column(lang_col).to_pylist(), batch.column(text_col).to_pylist())
            yield batch.filter(pa.array(found <= most))

    return docs.mapInArrow(run, docs.schema)
