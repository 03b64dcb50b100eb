"""Safe casts reproduce the lenient TRY_CAST semantics (values measured on the
oracle engine)."""

import datetime as dt
from decimal import Decimal

import pytest

from tessera.functions.casts import safe_cast
from tessera.functions.datefmt import strftime_to_spark, strptime_to_spark

NUM = ["", " ", "n/a", " 12.5 ", "1e3", "1200.50", "1200.505", "1200.5049", "-2.5", "1,200", "2.5", "0.5", "+1",
       ".5", "5.", "1_000", "-0.0005", "99999999999999999999", "1d", "7F"]
EXPECT = {
    "DECIMAL": [None, None, None, "12.500", "1000.000", "1200.500", "1200.505", "1200.505", "-2.500", None, "2.500",
                "0.500", "1.000", "0.500", "5.000", "1000.000", "-0.001", None, None, None],
    "INTEGER": [None, None, None, 13, 1000, 1201, 1201, 1201, -3, None, 3, 1, 1, 1, 5, 1000, 0, None, None, None],
    "BIGINT": [None, None, None, 13, 1000, 1201, 1201, 1201, -3, None, 3, 1, 1, 1, 5, 1000, 0, None, None, None],
    "DOUBLE": [None, None, None, 12.5, 1000.0, 1200.5, 1200.505, 1200.5049, -2.5, None, 2.5, 0.5, 1.0, 0.5, 5.0,
               1000.0, -0.0005, 1e20, None, None],
}


@pytest.mark.parametrize("type_name", sorted(EXPECT))
def test_numeric(spark, type_name):
    df = spark.createDataFrame([(v,) for v in NUM], "s string")
    got = [r[0] for r in df.select(safe_cast("s", type_name)).collect()]
    if type_name == "DECIMAL":
        got = [None if g is None else str(g) for g in got]
    assert got == EXPECT[type_name]


DATES = ["2023-3-5", "2023/3/15", "2023-02-30", "20230105", "2023-01-05 10:00:00", "2023-01-05T00:00:00",
         " 2023-01-05 ", "2023-03", "xyz", "2023-01-05 3:04", "2023/1/5 3:04", "2023-01-05 10:00:00.123",
         "2023.01.05", "2023-01-05 25:00:00", "2023-03-15 xyz", "2023", "44197", "2023-01/05"]
D = dt.date
DATE_EXPECT = [D(2023, 3, 5), D(2023, 3, 15), None, None, D(2023, 1, 5), D(2023, 1, 5), D(2023, 1, 5), None, None,
               D(2023, 1, 5), D(2023, 1, 5), D(2023, 1, 5), None, None, None, None, None, None]


def test_date(spark):
    df = spark.createDataFrame([(v,) for v in DATES], "s string")
    assert [r[0] for r in df.select(safe_cast("s", "DATE")).collect()] == DATE_EXPECT


def test_timestamp(spark):
    df = spark.createDataFrame([(v,) for v in ["2023/1/5 3:04", " 2023-01-05 ", "2023", "2023-1-5T9:05:07"]], "s string")
    got = [r[0] for r in df.select(safe_cast("s", "TIMESTAMP")).collect()]
    assert got == [dt.datetime(2023, 1, 5, 3, 4), None, None, dt.datetime(2023, 1, 5, 9, 5, 7)]


def test_unknown_type(spark):
    with pytest.raises(ValueError):
        safe_cast("s", "BLOB")


def test_patterns():
    assert strptime_to_spark("%Y-%m-%d") == "yyyy'-'M'-'d"
    assert strftime_to_spark("%Y年%m月") == "yyyy'年'MM'月'"
    assert strftime_to_spark("%d.%m.%Y %H:%M") == "dd'.'MM'.'yyyy' 'HH':'mm"


def test_decimal_is_18_3(spark):
    df = spark.createDataFrame([("1200.5",)], "s string").select(safe_cast("s", "DECIMAL").alias("d"))
    assert df.schema["d"].dataType.simpleString() == "decimal(18,3)"
    assert df.first()["d"] == Decimal("1200.500")


def test_only_what_may_be_a_double_is_cast(spark):
    """A failed cast costs an exception, so texts are looked at first; nothing that casts is lost."""
    import itertools

    from pyspark.sql import functions as F

    from tessera.functions import casts

    texts = ["", " ", "O", "1-URGENT", "Total", "2023-01-05T00:00:00", "1.2.3", "1e", "e5", "_1", "1_", "1__0", "1_000", "1_0d", "12d", "1.5f", "0x1p3", "0X1.8P-1d", "0x_1p3",
             "0x1_0p1_0", "0x1", "0xep1", "0x.8p0", "nan", "NaN", "+nan", "-NaN", "inf", "-Inf", "+INFINITY", "Infinity", "infinit", "- 1", "+-1", "\x001\x1f", "\t-1\n", "1\n\n", "1 ",
             " 1", "١", "１", "1e5", "1E+0_5", "1e-5 ", ".5", "5.", ".", "-.e1", "9" * 400, "1" * 3000 + "x", "nıf", "K", "1 2", "1e5e5", "1d5"]
    texts += ["".join(p) for k in (1, 2, 3, 4) for p in itertools.product("1_.e-dx", repeat=k)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.when(~F.col("t").rlike(casts._SPARK_SUFFIX), F.regexp_replace("t", casts._DIGIT_UNDERSCORE, "").try_cast("double"))
    for r in df.select("t", casts.try_double("t").alias("a"), plain.alias("b"), F.col("t").rlike(casts._MAYBE_DOUBLE).alias("looked")).collect():
        assert repr(r.a) == repr(r.b), r
        assert not r.looked or r.t not in ("O", "1-URGENT", "Total", "2023-01-05T00:00:00", "1.2.3")
