"""Safe text -> typed casts whose results equal the SQL engine the queries were
written for (lenient ``TRY_CAST`` semantics), built only from native Spark
expressions so they stay inside whole-stage codegen.

Differences handled here (all measured on both engines):

* DECIMAL without precision means (18,3), not Spark's (10,0).
* INTEGER/BIGINT round a fractional text (``'1200.50'`` -> 1201) and accept
  exponents (``'1e3'``); Spark's ``try_cast`` gives NULL, so go through
  ``decimal(38,10)`` and ``round``.
* Underscores between digits (``'1_000'``) are accepted; Spark-only literal
  suffixes (``'1d'``, ``'1f'``) are refused.
* DATE/TIMESTAMP: a guard regex admits only a four-digit year, one separator
  kind (``-`` or ``/``) and an optional valid ``H:MM[:SS[.f]]`` tail; Spark
  alone would read ``'2023'``, ``'2023-03'`` or ``'...T99:00'``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL_TYPE = "decimal(18,3)"

_DIGIT_UNDERSCORE = r"(?<=\d)_(?=\d)"
_SPARK_SUFFIX = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?[df]\s*$"
# Whatever may be a double, and little else: a failed cast costs an exception. No backtracking.
_MAYBE_DOUBLE = (r"(?i)^[\x00-\x20]*+[+-]?(?:[0-9_]*+(?:\.[0-9_]*+)?+(?:e[+-]?[0-9_]++)?+[df]?|nan|inf|infinity"
                 r"|0x[0-9a-f_]*+(?:\.[0-9a-f_]*+)?+(?:p[+-]?[0-9_]++)?+[df]?)[\x00-\x20]*+$")
_TIME_TAIL = r"([ T]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?)?"
# DATE tolerates outer blanks, TIMESTAMP does not (as in the oracle engine).
DATE_GUARD = r"^\s*\d{4}(-|/)\d{1,2}\1\d{1,2}" + _TIME_TAIL + r"\s*$"
TIMESTAMP_GUARD = r"^\d{4}(-|/)\d{1,2}\1\d{1,2}" + _TIME_TAIL + r"$"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c) -> Column:
    return as_col(c).cast("string")


def _numeric_text(c) -> Column:
    t = _text(c)
    return F.when(t.contains("_"), F.regexp_replace(t, _DIGIT_UNDERSCORE, "")).otherwise(t)


def try_double(c) -> Column:
    t = _text(c)
    return F.when(t.rlike(_MAYBE_DOUBLE) & ~t.rlike(_SPARK_SUFFIX), _numeric_text(t).try_cast("double"))


def try_decimal(c, precision: int = 18, scale: int = 3) -> Column:
    t = _text(c)
    return F.when(~t.rlike(_SPARK_SUFFIX), _numeric_text(t).try_cast(f"decimal({precision},{scale})"))


def _try_integral(c, target: str) -> Column:
    t = _text(c)
    wide = _numeric_text(t).try_cast("decimal(38,10)")
    return F.when(~t.rlike(_SPARK_SUFFIX), F.round(wide, 0).try_cast(target))


def try_integer(c) -> Column:
    return _try_integral(c, "int")


def try_bigint(c) -> Column:
    return _try_integral(c, "bigint")


def try_date(c) -> Column:
    t = _text(c)
    return F.when(t.rlike(DATE_GUARD), F.regexp_replace(t, "/", "-").try_cast("date"))


def try_timestamp(c) -> Column:
    t = _text(c)
    return F.when(t.rlike(TIMESTAMP_GUARD), F.regexp_replace(t, "/", "-").try_cast("timestamp_ntz"))


_CASTS = {
    "DECIMAL": try_decimal,
    "NUMERIC": try_decimal,
    "DOUBLE": try_double,
    "FLOAT8": try_double,
    "INTEGER": try_integer,
    "INT": try_integer,
    "BIGINT": try_bigint,
    "DATE": try_date,
    "TIMESTAMP": try_timestamp,
    "VARCHAR": _text,
    "TEXT": _text,
    "STRING": _text,
}

CAST_TYPES = ("DECIMAL", "DOUBLE", "INTEGER", "BIGINT", "DATE", "VARCHAR")


def safe_cast(c, type_name: str) -> Column:
    """``TRY_CAST(c AS type_name)`` with the oracle engine's semantics."""
    key = type_name.strip().upper()
    if key not in _CASTS:
        raise ValueError(f"unsupported cast type: {type_name!r}")
    return _CASTS[key](c)
