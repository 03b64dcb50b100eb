"""Column names from header cells: blank cells, repeats, one rule in two forms.

A header cell without text (outer ASCII blanks do not count) is ``column{place}``. A name
that is taken, whatever the case of its letters (as Spark finds columns), gets ``_k`` for the kth time that it was asked for; if
the result is taken too, the same goes for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.casts import as_col

_BLANKS = " \t\n\x0b\x0c\r"
_STATE = "struct<names:array<string>,keys:array<string>,asked:array<int>>"
_TRY = "struct<name:string,asked:array<int>,taken:boolean>"


def unique_names_py(names: list[str]) -> list[str]:
    out: list[str] = []
    asked: dict[str, int] = {}
    for name in names:
        while name.lower() in asked:
            key = name.lower()
            asked[key] += 1
            name = f"{name}_{asked[key]}"
        asked[name.lower()] = 0
        out.append(name)
    return out


def header_names_py(cells: list) -> list[str]:
    return unique_names_py([(c or "").strip(_BLANKS) or f"column{i}" for i, c in enumerate(cells)])


def unique_names(names) -> Column:
    """``unique_names_py`` of an array column: one fold whose state is the names so far,
    their lower-case forms and how often each was asked for again."""

    def take(state: Column, name: Column) -> Column:
        def again(tried: Column, _: Column) -> Column:
            at = F.array_position(state["keys"], F.lower(tried["name"])).cast("int")
            count = F.get(tried["asked"], at - 1) + 1
            asked = F.transform(tried["asked"], lambda n, i: F.when(i == at - 1, count).otherwise(n))
            more = F.struct(F.concat(tried["name"], F.lit("_"), count.cast("string")).alias("name"), asked.alias("asked"), F.lit(True).alias("taken"))
            return F.when(tried["taken"] & (at > 0), more.cast(_TRY)).otherwise(
                F.struct(tried["name"].alias("name"), tried["asked"].alias("asked"), F.lit(False).alias("taken")).cast(_TRY))

        first = F.struct(name.alias("name"), state["asked"].alias("asked"), F.lit(True).alias("taken")).cast(_TRY)
        free = ~F.array_contains(state["keys"], F.lower(name))
        found = F.when(free, first).otherwise(F.aggregate(state["keys"], first, again))  # a name taken n times over needs n tries
        return F.struct(
            F.concat(state["names"], F.array(found["name"])).alias("names"),
            F.concat(state["keys"], F.array(F.lower(found["name"]))).alias("keys"),
            F.concat(found["asked"], F.array(F.lit(0))).alias("asked")).cast(_STATE)

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("names"), none.alias("keys"), F.array().cast("array<int>").alias("asked")).cast(_STATE)
    return F.aggregate(as_col(names), start, take, lambda state: state["names"])


def header_names(cells) -> Column:
    """``header_names_py`` of an array column of header cells."""
    def text(cell: Column, i: Column) -> Column:
        trimmed = F.regexp_replace(F.coalesce(cell, F.lit("")), f"^[{_BLANKS}]+|[{_BLANKS}]+$", "")
        return F.when(trimmed == "", F.concat(F.lit("column"), i.cast("string"))).otherwise(trimmed)

    return unique_names(F.transform(as_col(cells), text))
