"""Read-only query guard (Q1), as a Column over SQL text and as a Python check.

Both forms apply the same rules: strip blanks, drop the trailing run of ``;``,
strip again; any remaining ``;`` is a second statement; the statement must
start with a read-only head; write/DDL words are refused anywhere in the text
(also inside identifiers and literals, on purpose).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.casts import as_col
from tessera.functions.text import strip_ws

# Accepted statement heads and refused words.
HEADS = ("select", "with", "pivot", "unpivot", "from")
FORBIDDEN_WORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "attach", "copy",
    "pragma", "call", "export", "install", "load", "set",
)
# Refusal reasons.
REASON_MULTI = "multiple statements"
REASON_HEAD = "not a SELECT/WITH/PIVOT/UNPIVOT/FROM"
REASON_WRITE = "contains a write/DDL keyword"

_HEAD_RE = r"(?i)^(" + "|".join(HEADS) + r")\b"
_FORBIDDEN_RE = r"(?i)\b(" + "|".join(FORBIDDEN_WORDS) + r")\b"


# One rule table for both forms: a text is refused where the pattern's presence is
# as the last column says.
RULES = ((REASON_MULTI, ";", True), (REASON_HEAD, _HEAD_RE, False), (REASON_WRITE, _FORBIDDEN_RE, True))


class SqlRejected(Exception):
    pass


def _strip(c: Column) -> Column:
    return strip_ws(c)


def normalized_sql(c) -> Column:
    return _strip(F.regexp_replace(_strip(as_col(c)), ";+$", ""))


def guard_reason(c) -> Column:
    """NULL when accepted, else the refusal reason."""
    s = normalized_sql(c)
    return F.coalesce(*(F.when(s.rlike(pattern) == F.lit(refused), F.lit(reason)) for reason, pattern, refused in RULES))


def guard_accepts(c) -> Column:
    return guard_reason(c).isNull()


def validate_select(sql: str) -> str:
    """The rule table for one statement; returns the normalized text or raises
    ``SqlRejected``."""
    text = re.sub(r"\s*;*\s*$", "", sql.strip(), count=1)
    for reason, pattern, refused in RULES:
        if (re.search(pattern, text) is not None) is refused:
            raise SqlRejected(reason)
    return text
