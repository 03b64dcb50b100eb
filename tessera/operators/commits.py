"""Tables that change by commits: a run log and keyed stores, on plain Parquet folders.

A write puts its rows in a partition of its own (``commit=<id>``), and ends with one
manifest file that names it. Readers take what the manifest names. So a write that failed
half-way is not seen, one that was repeated is seen once, and a reader sees the table as it
was before a commit or after it, never between. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "key string, commit string, at timestamp"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _staged(df: DataFrame, path: str, table: str, commit: str, *parts: str) -> None:
    df.withColumn("commit", F.lit(commit)).write.mode("append").partitionBy("commit", *parts).parquet(f"{path}/{table}")


def _commit(spark: SparkSession, path: str, keys: list[str], commit: str) -> None:
    """One file, renamed into place by Spark's output committer: all of it is seen or nothing."""
    entries = spark.createDataFrame([(k, commit) for k in keys], "key string, commit string").coalesce(1)
    entries.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{path}/manifest")


# --- run log ------------------------------------------------------------------------

RUNS = "run_id string, skill_id long, status string, n_inputs long, created_at timestamp"
REPORTS = "run_id string, skill_id long, source_id string, kind string, missing array<string>, extra array<string>"


def record_runs(path: str, runs: DataFrame, reports: DataFrame, run_id: str | None = None, at=None) -> str:
    """Logs one run of one or many skills: ``runs(skill_id, status, n_inputs)`` and
    ``reports(skill_id, source_id, kind, missing, extra)``, a row for each input. Writing a
    ``run_id`` again changes nothing. Rows are written by the executors."""
    spark = runs.sparkSession
    path, run_id = path.rstrip("/"), run_id or uuid.uuid4().hex
    if not _manifest(spark, path).where(F.col("key") == run_id).isEmpty():
        return run_id
    commit = uuid.uuid4().hex
    created = F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()
    _staged(runs.select(F.lit(run_id).alias("run_id"), F.col("skill_id").cast("long"), "status",
                        F.col("n_inputs").cast("long"), created.alias("created_at")), path, "runs", commit)
    _staged(reports.select(F.lit(run_id).alias("run_id"), F.col("skill_id").cast("long"), "source_id", "kind", "missing", "extra"),
            path, "reports", commit)
    _commit(spark, path, [run_id], commit)
    return run_id


def _committed(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    chosen = _manifest(spark, path).groupBy("key").agg(F.min_by("commit", F.struct("at", "commit")).alias("commit"))
    try:
        rows = spark.read.schema(f"{schema}, commit string").parquet(f"{path}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.join(chosen.withColumnRenamed("key", "run_id"), ["run_id", "commit"], "left_semi").drop("commit")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return _committed(spark, path.rstrip("/"), "runs", RUNS)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return _committed(spark, path.rstrip("/"), "reports", REPORTS)


# --- keyed stores (mapping memory by fingerprint, skills by id) ------------------------

BUCKETS = 64


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _current(spark: SparkSession, path: str) -> dict[int, str]:
    """The commit that holds each bucket: one entry a bucket, 64 at most."""
    newest = _manifest(spark, path).groupBy("key").agg(F.max_by("commit", F.struct("at", "commit")).alias("commit"))
    return {int(r["key"]): r["commit"] for r in newest.collect()}


def read_keyed(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a keyed store as of its last commit; of some ``buckets`` only, if named:
    both are partition filters, so that other files are not opened."""
    path = path.rstrip("/")
    now = {b: c for b, c in _current(spark, path).items() if buckets is None or b in buckets}
    if not now:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, commit string, bucket int").parquet(f"{path}/data")
    by_commit: dict[str, list[int]] = {}
    for b, c in now.items():
        by_commit.setdefault(c, []).append(b)
    live = F.lit(False)
    for c, bs in sorted(by_commit.items()):
        live = live | ((F.col("commit") == c) & F.col("bucket").isin(sorted(bs)))
    return rows.where(live).drop("commit", "bucket")


def upsert_keyed(path: str, rows: DataFrame, key: str) -> list[int]:
    """Puts ``rows`` in the place of all rows that have one of their keys. Only the buckets
    (by hash of the key) that hold such a key are read and written anew, in one commit.
    Returns these buckets. No row: nothing is written."""
    spark, path = rows.sparkSession, path.rstrip("/")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    touched = sorted(r[0] for r in rows.select(_bucket(key)).distinct().collect())  # 64 at most
    if not touched:
        return touched
    old = read_keyed(spark, path, schema, touched).join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns)
    commit = uuid.uuid4().hex
    both = old.unionByName(rows).withColumn("bucket", _bucket(key))
    _staged(both.repartition("bucket", F.pmod(F.hash(key), F.lit(8))), path, "data", commit, "bucket")
    _commit(spark, path, [str(b) for b in touched], commit)
    return touched
