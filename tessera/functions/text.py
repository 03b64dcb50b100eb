"""Column functions over header and cell text (all native expressions)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.casts import as_col, try_double

# The normalized-name alphabet (ASCII digits, lower-case ASCII
# letters, CJK unified ideographs U+4E00..U+9FFF); everything else collapses to
# one underscore.
_NON_WORD = "[^0-9a-z一-鿿]+"
# White space of text cells (beyond ASCII: next line, no-break and
# typographic spaces, ideographic space).
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = "".join(chr(i) for i in range(1 << 16) if re.match(WS, chr(i)))
# Header words that mark a date column, and the year token of a
# monthly file name.
DATE_COLUMN_HINT = "(?i)date|日期|time|时间"
YEAR_HINT = r"(\d{4})年"
# Leading run of a file name that names the data source.
SOURCE_PREFIX = r"^[^0-9.]+"


def norm_name_py(name: str) -> str:
    """Python twin of ``normalize_name`` for one header (plan-building only)."""
    return re.sub(_NON_WORD, "_", name.strip().lower()).strip("_")


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace of every kind (Spark's trim strips spaces only)."""
    return F.btrim(as_col(c), F.lit(WS_CHARS))


def _decimal_digits() -> tuple[str, str]:
    """Decimal digits of the basic plane beyond ASCII, and the ASCII digits they mean."""
    found = [(chr(i), str(unicodedata.decimal(chr(i)))) for i in range(128, 1 << 16) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


OTHER_DIGITS, THEIR_DIGITS = _decimal_digits()


def fold_digits(c) -> Column:
    """Decimal digits of other scripts (full-width ones too) as ASCII digits."""
    s = as_col(c)
    return F.when(F.octet_length(s) > F.length(s), F.translate(s, OTHER_DIGITS, THEIR_DIGITS)).otherwise(s)


def normalize_name(c) -> Column:
    """lower-case, runs outside [0-9a-z CJK] -> '_', outer '_' stripped.

    Leading/trailing blanks need no separate strip: they become an outer
    underscore run and are removed with it.
    """
    low = F.lower(as_col(c))
    return F.regexp_replace(F.regexp_replace(low, _NON_WORD, "_"), "^_+|_+$", "")


def is_numeric_text(c) -> Column:
    """True when the trimmed text with ',' removed parses as a float."""
    return stripped_is_numeric(strip_ws(c))


def stripped_is_numeric(c) -> Column:
    """``is_numeric_text`` of a text without outer white space."""
    def test(t: Column) -> Column:
        return (t != "") & try_double(fold_digits(t)).isNotNull()

    return bound(F.replace(as_col(c), F.lit(","), F.lit("")), test)


def is_date_column(c) -> Column:
    return F.coalesce(as_col(c).rlike(DATE_COLUMN_HINT), F.lit(False))


def year_hint(c) -> Column:
    """First four digits before '年' in a file name, as int; NULL when absent."""
    y = F.regexp_extract(fold_digits(c), YEAR_HINT, 1)
    return F.when(y != "", y.try_cast("int"))


def source_prefix(c) -> Column:
    return F.regexp_extract(as_col(c), SOURCE_PREFIX, 0)


def normalize_phone(c) -> Column:
    return F.regexp_replace(as_col(c).cast("string"), "[^0-9]", "")


def content_hash(c) -> Column:
    """First 16 hex digits of the SHA-256 of the value (text is hashed as UTF-8)."""
    return F.substring(F.sha2(as_col(c), 256), 1, 16)


# --- date-shaped text -> ISO ------------------------------------------------

_ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss"
# Accepted date-shaped texts. Y-M-D with '-', '/' or '.' (mixed
# allowed) and an optional [ T]H:MM[:SS] tail; Y年M月D日; and, only with a year
# hint and inside a date column, M.D / M-D / M/D.
DATE_SEP = rf"^{WS}*(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[ T](\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?)?{WS}*$"
DATE_ZH = rf"^{WS}*(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日{WS}*$"
DATE_NO_YEAR = rf"^{WS}*(\d{{1,2}})[./-](\d{{1,2}}){WS}*$"


# Most cells begin with no digit: the first look. The numbers of a date text, all at once.
_LOOK = rf"^{WS}*\p{{Nd}}"
_NUMBERS = r"[0-9]+"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _iso(y: Column, mo: Column, d: Column, hh: Column | None = None, mi: Column | None = None, ss: Column | None = None) -> Column:
    """Validated datetime -> ISO text; NULL for impossible dates or times."""
    hh, mi, ss = (F.lit(0) if x is None else F.coalesce(x, F.lit(0)) for x in (hh, mi, ss))
    ok = (y >= 1) & (hh < 24) & (mi < 60) & (ss < 60)
    ts = F.try_make_timestamp_ntz(years=y, months=mo, days=d, hours=hh, mins=mi, secs=ss.cast("decimal(8,6)"))
    return F.when(ok, F.date_format(ts, _ISO_FMT))


def maybe_iso_date(c, year_hint_col=None) -> Column:
    """ISO text for a date-shaped text, else NULL.

    ``year_hint_col`` (int) enables the year-less M.D form; callers gate it on
    the column being a date column.
    """
    def numbers(s: Column, f: Callable[[list[Column]], Column], count: int) -> Column:
        found = F.transform(F.regexp_extract_all(s, F.lit(_NUMBERS), F.lit(0)), lambda n: n.try_cast("int"))
        return bound(found, lambda n: f([F.get(n, F.lit(i)) for i in range(count)]))

    def dated(s: Column) -> Column:
        out = F.when(s.rlike(f"{DATE_SEP}|{DATE_ZH}"), numbers(s, lambda n: _iso(*n), 6))
        if year_hint_col is not None:
            yearless = numbers(s, lambda n: F.when(n[0].between(1, 12) & n[1].between(1, 31), _iso(year_hint_col, *n)), 2)
            out = out.when(year_hint_col.isNotNull() & s.rlike(DATE_NO_YEAR), yearless)
        return out

    raw = as_col(c)
    return F.when(raw.rlike(_LOOK), bound(fold_digits(raw), dated))


def iso_date_text(c, year_hint_col=None) -> Column:
    """Date-shaped text rewritten to ``yyyy-MM-ddTHH:mm:ss``; anything else unchanged."""
    s = as_col(c)
    return F.coalesce(maybe_iso_date(s, year_hint_col), s)
