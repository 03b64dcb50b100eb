"""Skill replay over a stream of arriving exports.

The per-row steps (renames, casts, date parsing, phone digits, derive, filter)
and the canonical projection are stateless, so they run unchanged on a
streaming DataFrame. ``dedupe`` needs state: on a stream it is expressed with a
watermark and ``dropDuplicatesWithinWatermark`` so state stays bounded;
without an event-time column it is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from tessera.operators.ops import StepError, apply_steps, filter_rows, validate_steps
from tessera.sources.delimited import header_names


def stream_exports(spark: SparkSession, directory: str, header: list[str], delim: str = ",") -> DataFrame:
    """All-text streaming read of delimited exports that share ``header``
    (new files in ``directory`` are picked up as they land)."""
    names = header_names(list(header))
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    raw = (
        spark.readStream.schema(schema)
        .option("header", "true").option("sep", delim).option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE").csv(directory)
    )
    return raw.select(*[F.nullif(F.col(f"_c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)],
                      F.col("_metadata.file_path").alias("source_file"))


def replay_stream(stream: DataFrame, steps: list[dict], event_time: str | None = None,
                  watermark: str = "1 day") -> DataFrame:
    """Apply a saved plan to a streaming DataFrame; one watermark serves all dedupes."""
    validate_steps(steps)
    out = apply_steps(stream, [s for s in steps if s["op"] not in ("filter", "dedupe")])
    if any(s["op"] == "dedupe" for s in steps):
        if event_time is None:
            raise StepError("dedupe on a stream needs an event-time column and a watermark")
        out = out.withWatermark(event_time, watermark)
    for s in steps:  # filters and dedupes in their own order
        if s["op"] == "filter":
            out = filter_rows(out, s["predicate"])
        elif s["op"] == "dedupe":
            keys = list(s["keys"]) + (["source_file"] if "source_file" in out.columns else [])
            out = out.dropDuplicatesWithinWatermark(keys)
    return out


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """Stream checkpoints live under the cluster's shared ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set; streams need a shared checkpoint folder")
    return f"{base.rstrip('/')}/{name}"
