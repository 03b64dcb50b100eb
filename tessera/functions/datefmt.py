"""strptime/strftime directives -> Spark datetime patterns.

Step plans and query authors write C-style formats (``%Y-%m-%d``); Spark wants
``yyyy-MM-dd``. Literal text is quoted so letters in it are not read as pattern
letters. Numeric fields use the variable-width letters (``M``, ``d``, ``H``)
so that ``2023-3-5`` parses under ``%Y-%m-%d`` as it does in C ``strptime``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.casts import as_col

# Directive -> Spark pattern letters, parsing side.
PARSE_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m",
    "S": "s", "f": "SSSSSS", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "p": "a", "j": "D", "z": "Z",
}
# Formatting side: zero-padded widths, as strftime prints them.
FORMAT_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm",
    "S": "ss", "f": "SSSSSS", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "p": "a", "j": "DDD", "z": "Z",
}


def _translate(fmt: str, table: dict) -> str:
    out: list[str] = []
    literal: list[str] = []

    def flush():
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(f"'{text}'")
            literal.clear()

    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            d = fmt[i + 1]
            if d == "%":
                literal.append("%")
            elif d in table:
                flush()
                out.append(table[d])
            else:
                raise ValueError(f"unsupported directive %{d} in {fmt!r}")
            i += 2
            continue
        literal.append(ch)
        i += 1
    flush()
    return "".join(out)


def strptime_to_spark(fmt: str) -> str:
    return _translate(fmt, PARSE_DIRECTIVES)


def strftime_to_spark(fmt: str) -> str:
    return _translate(fmt, FORMAT_DIRECTIVES)


def try_strptime(c, fmt: str) -> Column:
    """``try_strptime(c, fmt)``: NULL when the text does not match."""
    return F.try_to_timestamp(as_col(c).cast("string"), F.lit(strptime_to_spark(fmt)))


def strftime(c, fmt: str) -> Column:
    return F.date_format(as_col(c), strftime_to_spark(fmt))
