"""Stored intermediate tables and positions over a whole order.

Joins against small derived tables are plain equi-joins: with adaptive execution
the side is broadcast when its measured bytes are below
``spark.sql.autoBroadcastJoinThreshold``, and shuffled (skewed partitions split)
when they are not. Nothing is counted or collected while a plan is built.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import shared_folder


def materialize(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Compute a derived table once for several later uses: written as Parquet to
    the shared ``spark.checkpoint.dir`` and read back (lineage cut, real sizes for
    the planner), by ``spark`` if it is not the session of ``df``."""
    spark = spark or df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(frames: Iterable[DataFrame], spark: SparkSession) -> DataFrame:
    """Tables of the same columns, each computed and let go before the next, stored as one."""
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    for df in frames:
        df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. Spark takes a stored table for as
    large as its files; with repeated values in nested arrays it has a hundred times that in
    memory, and a broadcast passes through the driver."""
    return df.hint("merge")


def global_index(df: DataFrame, order_cols: list, out: str = "pos", parts: int | None = None) -> DataFrame:
    """0-based position of every row in ``order_cols`` order, without a
    single-partition sort. Rows are range-partitioned by the order key and stored
    with the number of their range, so that the rows and the counts of earlier
    ranges (one row a range) come from one and the same partitioning."""
    spark = df.sparkSession
    n = parts or spark.sparkContext.defaultParallelism
    ranged = df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id())
    ranged = materialize(ranged)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("_c"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)) - 1
    return (ranged.withColumn("_i", place).join(F.broadcast(offsets), "_pid")  # one row a range
            .withColumn(out, (F.col("_off") + F.col("_i")).cast("int"))
            .drop("_pid", "_i", "_off"))


def running_sums(df: DataFrame, key: str, order_cols: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each ``name: column`` of ``sums``, the sum of that column over
    the rows of the same ``key`` up to and with this row, in ``order_cols`` order.

    A window over ``key`` alone would sort a key's rows in one task. Here rows are
    range-partitioned by key and order together, so that a key has as many parts as
    its rows need; sums run within a part, and the totals of a key's earlier parts are
    added. Only the first key of a part can have earlier parts, so that the table of
    totals holds a row a part at most for each of these. Rows that are equal in key
    and order share a part; their places among each other are arbitrary.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    ranged = valued.repartitionByRange(parts, key, *order_cols).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged)
    within = Window.partitionBy(key, "_part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_s_{n}") for n in sums])
    cut = ranged.groupBy("_part").agg(F.min(F.struct(F.col(key))).alias("_k")).select(F.col(f"_k.{key}").alias("_cut")).distinct()
    totals = ranged.join(F.broadcast(cut), F.col(key).eqNullSafe(F.col("_cut")), "left_semi")  # one row a part
    totals = totals.groupBy(key, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("_cut"), F.col("_part").alias("_cut_part"),
                           *[F.sum(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in sums])
    before = before.where(reduce(Column.__or__, [F.col(f"_b_{n}").isNotNull() for n in sums]))
    same = F.col(key).eqNullSafe(F.col("_cut")) & (F.col("_part") == F.col("_cut_part"))
    added = [(F.col(f"_s_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums]
    return local.join(before, same, "left").select(*[c for c in df.columns if c not in sums], *added)
