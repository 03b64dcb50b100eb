"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; each executor finds its own installed copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` written as a table of the shared folder and read back: computed
    once, lineage cut, and safe against lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: str, order: list[str], out: str = "rank", salts: int = 64, sizes: dict[int, int] | None = None,
           part_rows: int = 500_000) -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its ``group``. Places
    follow a hash bucket of ``order`` and then ``order``, so that a group of any size
    is sorted in ``salts`` parts, or, if ``sizes`` names its rows, in as many more as keep a
    part at about ``part_rows``; the parts' counts (a row each) are joined."""
    parts = {k: n // part_rows for k, n in (sizes or {}).items() if n // part_rows > salts}
    many = F.lit(salts)
    if parts:
        kind = df.schema[group].dataType
        known = F.create_map(*(x for k, n in sorted(parts.items()) for x in (F.lit(k).cast(kind), F.lit(n))))
        many = F.coalesce(known[F.col(group)], many)
    bucket = F.pmod(F.xxhash64(*order), many).alias("_bucket")
    part = df.select("*", bucket)
    place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = part.withColumn("_place", place).join(counts, [group, "_bucket"])
    return placed.withColumn(out, F.col("_place") + F.col("_before")).drop("_bucket", "_place", "_before")
