"""Sheet-grid cleaning (G1-G12) on small grids."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import iso_date_text, year_hint
from tessera.operators import grid as gd

SCHEMA = "source_file string, row_no long, cells array<string>"


def grid(spark, name, rows):
    return spark.createDataFrame([(name, i, r) for i, r in enumerate(rows)], SCHEMA)


def clean(spark, name, rows):
    body, heads = gd.clean_sheets(grid(spark, name, rows))
    h = heads.collect()
    return (list(h[0]["header"]) if h else None), [list(r["cells"]) for r in body.orderBy("row_no").collect()]


def test_plain(spark):
    h, rows = clean(spark, "plain.csv", [["id", "amount"], ["1", "10.5"], ["2", "20"]])
    assert h == ["id", "amount"] and rows == [["1", "10.5"], ["2", "20"]]


def test_titled_with_year_hint(spark):
    name = "运费(2023年1月).csv"
    h, rows = clean(spark, name, [["华东仓储月度明细(2023.1月)"], ["日期", "客户", "运费"], ["2.09", "一汽", "5.60"],
                                  ["1.31", "二汽", "7"]])
    assert h == ["日期", "客户", "运费"]
    assert rows == [["2023-02-09T00:00:00", "一汽", "5.60"], ["2023-01-31T00:00:00", "二汽", "7"]]
    assert spark.range(1).select(year_hint(F.lit(name))).first()[0] == 2023


def test_totals(spark):
    rows = [["客户", "日期", "运费合计"], ["一汽", "2023-01-02", "1449.40"], ["一汽 汇总", "", "1449.40"],
            ["总计", "3563.60"], ["Total", "9"], ["二汽", "2023-01-03", "2114.20"]]
    h, out = clean(spark, "totals.csv", rows)
    assert h == ["客户", "日期", "运费合计"]
    assert [r[0] for r in out] == ["一汽", "二汽"]


def test_ragged_and_blank(spark):
    rows = [["a", "b", "c"], ["1", "2"], ["3", "4", "5", "6"], ["", "", ""], [" ", ""]]
    h, out = clean(spark, "ragged.csv", rows)
    assert out == [["1", "2", ""], ["3", "4", "5"]]


def test_dates(spark):
    df = spark.createDataFrame([(v,) for v in ["2023/3/15", "2023.03.15 10:20", "2023年3月5日", "2023-02-30",
                                               "5.60", "hello", "2023-3-5T7:08:09"]], "s string")
    got = [r[0] for r in df.select(iso_date_text("s")).collect()]
    assert got == ["2023-03-15T00:00:00", "2023-03-15T10:20:00", "2023-03-05T00:00:00", "2023-02-30", "5.60",
                   "hello", "2023-03-05T07:08:09"]


def test_yearless_only_in_date_columns(spark):
    h, rows = clean(spark, "海运台账2023年2月.csv", [["日期", "运费"], ["2.30", "5.60"], ["2.09", "2.10"]])
    assert rows == [["2.30", "5.60"], ["2023-02-09T00:00:00", "2.10"]]
    h, rows = clean(spark, "no-hint.csv", [["日期", "运费"], ["2.09", "5.60"], ["3.01", "1"]])
    assert rows[0][0] == "2.09"


def test_tie_earliest_wins(spark):
    h, _ = clean(spark, "tie.csv", [["a", "b"], ["c", "d"], ["e", "f"]])
    assert h == ["a", "b"]


def test_empty(spark):
    h, rows = clean(spark, "empty.csv", [])
    assert h is None and rows == []


def test_cell_text(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2023, 1, 5, 10, 0), dt.date(2023, 1, 5), True, 3.0, 2.5, "2023/1/5", None)],
        "ts timestamp_ntz, d date, b boolean, x double, y double, s string, n string")
    types = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(*[gd.cell_text(F.col(c), types[c]) for c in df.columns]).first()
    assert list(got) == ["2023-01-05T10:00:00", "2023-01-05", "TRUE", "3", "2.5", "2023-01-05T00:00:00", ""]
    assert isinstance(types["n"], T.StringType)


def test_header_rows_limited_per_file(spark):
    """Header detection only ever sees the first rows of each file."""
    g = grid(spark, "big.csv", [["h1", "h2"]] + [[str(i), str(i * 2)] for i in range(500)])
    heads = gd.detect_header_row(g).collect()
    assert heads[0]["header_idx"] == 0
    assert gd.head_rows(g).count() == 21


def test_dense_rows_same_header(spark, tmp_path):
    from conftest import write_text
    from tessera.sources.delimited import read_grid

    p = write_text(tmp_path, "运费2023年.csv", "运费报表\n日期,客户,运费\n2.09,一汽,5.60\n小计,5.60\n\n3.1,二汽,7\n")
    g = read_grid(spark, p)
    a, ha = gd.clean_sheets(g)
    b, hb = gd.clean_sheets(g, dense_rows=True)
    rows = lambda d: sorted((r["row_no"], tuple(r["cells"])) for r in d.collect())
    assert rows(a) == rows(b)
    assert [tuple(r["cells"]) for r in a.orderBy("row_no").collect()] == [
        ("2023-02-09T00:00:00", "一汽", "5.60"), ("2023-03-01T00:00:00", "二汽", "7")]
    assert list(ha.first()["header"]) == list(hb.first()["header"]) == ["日期", "客户", "运费"]


UNICODE_CELLS = ["　", "\xa0  ", "total\xa0", "　合计 ", "２０２３-０１-０５", "　2023/1/5\xa0", "１２.５", " 1,2 ", "٣", "x\x1c", "", "\t\n", "2023年１月2日", "１.５"]


def test_blanks_and_digits_of_all_scripts(spark):
    import re

    from pyspark.sql import functions as F

    from tessera.functions.text import fold_digits, is_numeric_text, iso_date_text, strip_ws
    from tessera.operators import grid as gd

    def number(text):
        t = text.strip().replace(",", "")
        try:
            return bool(t) and float(t) is not None
        except ValueError:
            return False

    def iso(text):
        m = re.match(r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\s*$", text) or re.match(r"^\s*(\d{4})年(\d{1,2})月(\d{1,2})日\s*$", text)
        return "{:04d}-{:02d}-{:02d}T00:00:00".format(*map(int, m.groups())) if m else text

    df = spark.createDataFrame([(c,) for c in UNICODE_CELLS], "c string")
    one = F.array("c")
    for r in df.select("c", strip_ws("c").alias("s"), is_numeric_text("c").alias("n"), iso_date_text("c").alias("d"), gd.is_blank_row(one).alias("b"),
                       gd.is_total_row(one).alias("t"), fold_digits("c").alias("f")).collect():
        assert r.s == r.c.strip() and r.n == number(r.c) and r.d == iso(r.c) and r.b == (not r.c.strip()), r
        assert r.t == (r.c.strip().lower() in gd.TOTAL_MARKERS_EN or any(z in r.c for z in gd.TOTAL_MARKERS_ZH)), r
        assert r.f == "".join(str(int(x)) if x.isdecimal() else x for x in r.c)


def test_each_cell_is_stripped_once_for_the_score(spark):
    """The score's plan strips a cell once, whatever it asks of it; rows score as by hand."""
    g = grid(spark, "a.csv", [["Report", None, " "], [" No ", "Date", "Amount"], ["1", "1,234.5", "٢"], ["", None, "x"]])
    s = gd.score_head(g)
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2  # one of the cell's strip, one of the number's underscores
    got = {r["idx"]: r["score"] for r in s.collect()}
    assert got == {0: round(2 / 3 - 2 + 1.5 + 1, 9), 1: 2 + 1.5 + 1 + 1, 2: 2 + 1.5 - 2 + 1, 3: round(2 / 3 - 2 + 1.5 + 1, 9)}


def test_queries_that_return_filtered_cells_render_once(spark, tmp_path):
    from tessera.plans.registry import QUERIES
    import tessera.plans.grid_queries  # noqa: F401  (registers)

    spark.createDataFrame([(1, "Customer#1"), (2, "Customer#2")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, 1 + k % 2, dt.datetime(2023, 3, 1 + k), 10.5 * k, "O", "1-URGENT") for k in range(1, 9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderstatus string, "
                                  "o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("g6_rectangularize", "g10_promote_yearless_dates", "g11_drop_blank_rows"):
        df = QUERIES[name](spark, str(tmp_path))
        assert "o_orderdate" not in df._jdf.queryExecution().optimizedPlan().toString(), name
    got = {r.row_no: r.cells.split("|") for r in QUERIES["g6_rectangularize"](spark, str(tmp_path)).collect()}
    assert got[10 + 3 * 4][1] == "2023-03-05T00:00:00" and got[10 + 3 * 5][1] == "2023-03-06T00:00:00"
    assert 10 + 3 * 5 + 1 not in got  # a subtotal


def test_stripping_and_digits_go_without_patterns(spark):
    """A pattern looked at every place of every cell for blanks, and at every character for other digits."""
    from pyspark.sql import functions as F

    from tessera.functions.text import WS, fold_digits, strip_ws

    blanks = [chr(i) for i in range(1 << 16) if not 0xD800 <= i < 0xE000 and (chr(i).isspace() or i in (0x200B, 0x180E, 0x85, 0x1F, 0x7F))]
    texts = [f"{b}{b} a{b}b \n{b}" for b in blanks] + blanks + ["", "\x85\u3000", "\U0001d7d8 x ", "a\r\n", "٣\u3000", "é "]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "c string")
    out = df.select("c", strip_ws("c").alias("s"), F.regexp_replace("c", f"^{WS}+|{WS}+$", "").alias("p"), fold_digits("c").alias("f"))
    for r in out.collect():
        assert r.s == r.p, r
        assert r.f == (r.c if r.c is None else "".join(str(int(x)) if x.isdecimal() and x < "\uffff" else x for x in r.c)), r
    plan = df.select(strip_ws("c"), fold_digits("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()
