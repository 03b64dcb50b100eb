"""Result sinks.

A query result is written as a table: nested cells (arrays, maps, structs) are
rendered as JSON text first, so every sink — including CSV, where NULL becomes
an empty cell — can hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def flatten_cells(df: DataFrame, as_text: bool = False) -> DataFrame:
    """Nested cells -> JSON text; with ``as_text`` every column becomes text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _NESTED):
            c = F.to_json(c)
        elif as_text:
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None, **options) -> None:
    """Write a result table. ``fmt``: any Spark file format (parquet, csv,
    json, orc, text...). CSV gets a header row and empty cells for NULL."""
    out = flatten_cells(df, as_text=(fmt == "csv"))
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true").option("nullValue", "").option("emptyValue", "")
    for k, v in options.items():
        w = w.option(k, v)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
