"""One query for each operator, over the whole of its table.

``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds the
SQL twins, where SQL can state the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    bpe, convtrie, kdtree, mixing, packing, pii, quality, secret_scan, simhash, syncmers, tagpaths, tokenfile, whitening,
)
from tessera.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base rules, and a tagger trained on a sample."""
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find_personal_data(docs, pii.train(docs)))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: base rules and entropy windows."""
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's perplexity under a model of trusted texts, and whether it stays."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048, separator=0)


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by merge ranks, and its ids decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts written as id files in ascending order, and read back."""
    back = tokenfile.write_and_read(table(spark, sf_dir, "documents"), end=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint, against that of its edited text and of the next document."""
    return syncmers.compare_neighbours(table(spark, sf_dir, "documents"))


@query
def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log probability by word counts, and by mixed bit predictors."""
    return mixing.score(table(spark, sf_dir, "documents"))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every vector whose id is divisible by 50."""
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), queries="vec_id % 50 = 0", k=5)


ORACLE["op9_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), z -> z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs
QUALIFY rank <= 5
"""


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, fingerprints linked at two or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations, one row a node."""
    return convtrie.conversation_trie(table(spark, sf_dir, "conversations"), every=20, heads=4)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 32 whitened principal components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


@query
def op13_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return tagpaths.extract(table(spark, sf_dir, "pages"))
