"""Lenient delimited scans (S1-S3), content hashes (C4) and the sink."""

import glob
import os
import csv
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from conftest import SALES_FEB_ZH, SALES_JAN, write_text
from tessera.sources.delimited import (
    UnsupportedSource, cells_of, delimiter_for, file_content_hashes, header_names, read_delimited, read_grid, read_shape, read_sources,
    route_sources, unify_routed,
)
from tessera.sources.sinks import write_result
from tessera.operators.unify import unify
from tessera.operators.sizing import materialize
from tessera.plans import scan_queries
from tessera.session import shared_folder
from tessera.sources import delimited

EDGE = 'a,b,,A\n1,2\n"",x,"q""q",4\n\n5,6,7,8,9\n 7 ,,x,y\n'


def test_header_names():
    assert header_names(["a", "b", "", "A", None]) == ["a", "b", "column2", "A_1", "column4"]
    assert header_names(["x", "X", "x"]) == ["x", "X_1", "x_2"]


def test_extensions():
    assert delimiter_for("a.CSV") == "," and delimiter_for("b.tsv") == "\t" and delimiter_for("c.TxT") == ","
    with pytest.raises(UnsupportedSource):
        delimiter_for("d.xlsx")


def test_edge_file(spark, tmp_path):
    p = write_text(tmp_path, "edge.csv", EDGE)
    df = read_delimited(spark, p)
    assert df.columns == ["a", "b", "column2", "A_1", "column4", "source_file"]
    rows = sorted([tuple(r)[:5] for r in df.collect()], key=lambda r: str(r))
    assert sorted(rows, key=str) == sorted([
        ("1", "2", None, None, None),
        (None, "x", 'q"q', "4", None),
        ("5", "6", "7", "8", "9"),
        (" 7 ", None, "x", "y", None),
    ], key=str)


def test_tsv(spark, tmp_path):
    p = write_text(tmp_path, "t.tsv", "k\tv\n1\t a \n2\t\n")
    rows = sorted(tuple(r)[:2] for r in read_delimited(spark, p).collect())
    assert rows == [("1", " a "), ("2", None)]


def test_grid_keeps_row_shape(spark, tmp_path):
    p = write_text(tmp_path, "g.csv", "title\nh1,h2,h3\n1,,3\n\n4\n")
    g = read_grid(spark, p).orderBy("row_no").collect()
    assert [list(r["cells"]) for r in g] == [["title"], ["h1", "h2", "h3"], ["1", "", "3"], ["4"]]
    assert [r["row_no"] for r in g] == [0, 1, 2, 3]


def test_read_sources_groups_by_header(spark, tmp_path):
    a = write_text(tmp_path, "jan_a.csv", SALES_JAN)
    b = write_text(tmp_path, "jan_b.csv", SALES_JAN)
    c = write_text(tmp_path, "feb.csv", SALES_FEB_ZH)
    groups = read_sources(spark, [a, b, c])
    assert len(groups) == 2
    sizes = sorted((len(files), df.count()) for _, files, df in groups)
    assert sizes == [(1, 5), (2, 10)]


def test_content_hash(spark, tmp_path):
    p = write_text(tmp_path, "h.csv", SALES_JAN)
    got = file_content_hashes(spark, p).first()["content_hash"]
    assert got == hashlib.sha256(SALES_JAN.encode("utf-8")).hexdigest()[:16]


def test_write_result_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "k int, arr array<string>, s string")
    out = str(tmp_path / "out")
    write_result(df, out, "csv")
    back = spark.read.option("header", "true").csv(out).first()
    assert back["k"] == "1" and back["arr"] == '["a","b"]' and back["s"] is None
    write_result(df, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).select(F.col("arr")).first()[0] == '["a","b"]'


def test_mixed_delimiters(spark, tmp_path):
    a = write_text(tmp_path, "a.csv", "k,v\n1,x\n")
    b = write_text(tmp_path, "b.tsv", "k\tv\n2\ty\n3\tz\n")
    shapes = read_sources(spark, [a, b])
    assert sorted(df.count() for _, _, df in shapes) == [1, 2]
    assert all(list(h) == ["k", "v"] for h, _, _ in shapes)
    with pytest.raises(UnsupportedSource):
        read_delimited(spark, [a, b])


def test_wide_rows_and_own_empty_cells_stay(spark, tmp_path):
    wide = ",".join(f"v{i}" for i in range(20))
    p = write_text(tmp_path, "wide.csv", f"name,amt,\nx,1,note1\n{wide}\n,,\n")
    cells = [r["cells"] for r in read_grid(spark, p).orderBy("row_no").collect()]
    assert cells == [["name", "amt", ""], ["x", "1", "note1"], wide.split(","), ["", "", ""]]
    df = read_delimited(spark, p)
    assert df.columns[:4] == ["name", "amt", "column2", "column3"] and len(df.columns) == 21
    assert df.where("name = 'x'").first()["column2"] == "note1"


def test_lines_of_any_length_are_rows(spark, tmp_path):
    long = "x" * 11_000_000
    p = write_text(tmp_path, "long.csv", f"a,b\n1,2\n{long},3\n4,5\n")
    rows = sorted((r["a"], r["b"]) for r in read_delimited(spark, p).collect())
    assert rows == [("1", "2"), ("4", "5"), (long, "3")]
    q = write_text(tmp_path, "first.csv", f'{long},b\n1,"{long},"\n')  # a long first line is the header
    df = read_delimited(spark, q)
    assert df.columns == [long, "b", "source_file"] and [len(r["b"]) for r in df.collect()] == [11_000_001]


RECORDS = ['a,b', '', ',', '"a"', '"a""b",c', '"a,b",c', 'x"y,z', '"open,to the end', '"a"junk,b', '"a"b"c,d', '""', '"",""', '" a ", b ', '"""",x', 'ü,"日""本"', '"a,"",b",c', ',,,', '"a"",b']


def test_cells_equal_those_of_a_csv_parser(spark):
    rnd = random.Random(3)
    lines = RECORDS + ["".join(rnd.choice('ab,, "') for _ in range(rnd.randint(1, 14))) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", cells_of("line", ",").alias("c")).collect()
    for r in got:
        assert r["c"] == (next(csv.reader([r["line"]])) if r["line"] else [""]), r["line"]
    tabs = spark.createDataFrame([('a\t"b\tc"\t',)], "line string").select(cells_of("line", "\t")).first()[0]
    assert tabs == ["a", "b\tc", ""]
    many = '"' + '""x' * 200_000 + '",' + "," * 1000  # long cells and many cells: no recursion
    assert len(spark.createDataFrame([(many,)], "line string").select(cells_of("line", ",")).first()[0]) == 1002


@pytest.mark.parametrize("size", ["40", "333", "128m"])
def test_records_over_line_breaks_at_any_split_size(spark, tmp_path, size):
    rnd = random.Random(int(size.strip("m")))
    files = {}
    for k in range(3):
        rows = [[rnd.choice(["1", "", 'say ""hi""', "two\nlines", "a\n\n\nb, c", "x" * 60, "\n", "end\r\nin"]) for _ in range(3)] for _ in range(60)]
        text = "h1,h2,h3\n" + "".join(",".join(f'"{c}"' if rnd.random() < 0.4 or set(c) & set('\n",') else c for c in r) + rnd.choice(["\n", "\r\n", "\n\n"]) for r in rows)
        path = tmp_path / f"m{k}.csv"
        path.write_bytes(text.encode())
        files[path.name] = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    (tmp_path / "plain.csv").write_bytes(b"h1,h2,h3\r\n1,2,3\r\n\r\n4,,6")
    files["plain.csv"] = [["h1", "h2", "h3"], ["1", "2", "3"], ["4", "", "6"]]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = read_grid(spark, [str(tmp_path / f) for f in files], multiline=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    got = {}
    for r in sorted(rows, key=lambda r: (r["source_file"], r["row_no"])):
        got.setdefault(r["source_file"].rsplit("/", 1)[1], []).append(r)
    assert {f: [r["cells"] for r in rs] for f, rs in got.items()} == files
    assert all([r["row_no"] for r in rs] == list(range(len(rs))) for rs in got.values())


def test_route_many_shapes(spark, tmp_path):
    rnd = random.Random(1)
    want, paths = [], []
    for k in range(1000):
        names = [f"c{k}", "Amount" if k % 2 else "金额", "note", "note"][: 2 + k % 3]
        rows = [[str(rnd.randint(0, 99)), rnd.choice(["", "5", "7.5"]), "n", "m"][: len(names)] for _ in range(k % 4)]
        paths.append(write_text(tmp_path, f"f{k}.csv", "\n".join(",".join(r) for r in [names, *rows]) + "\n"))
        want += [(r[1] or None, r[3] if len(r) > 3 else None, f"f{k}.csv") for r in rows]
    out = f"{tmp_path}/routed"
    route_sources(spark, paths, out)
    assert spark.read.parquet(f"{out}/shapes").count() == spark.read.parquet(f"{out}/files").count() == 1000
    mapping = spark.createDataFrame([("Amount", "revenue", 0), ("金额", "revenue", 1), ("note_1", "second", 2)], "source_col string, to string, ord int")
    table = unify_routed(spark, out, mapping)
    assert table.columns == ["revenue", "second", "source_file"]
    assert sorted(((r[0], r[1], r[2].rsplit("/", 1)[1]) for r in table.collect()), key=str) == sorted(want, key=str)
    shape = spark.read.parquet(f"{out}/files").where(F.col("source_file").endswith("/f11.csv")).first()["shape"]
    one = read_shape(spark, out, shape)
    assert one.columns == ["c11", "Amount", "note", "note_1", "source_file"] and one.count() == 3


def test_routed_shapes_equal_unify(spark, tmp_path):
    files = {"jan.csv": SALES_JAN, "feb.csv": SALES_FEB_ZH, "dup.csv": "Cust Name,,cust name,Amount USD\nA,x,B,1\nC,,,\n", "wide.csv": "Cust Name\nA,b,c\n"}
    paths = [write_text(tmp_path, n, t) for n, t in files.items()]
    pairs = [("Cust Name", "customer_name"), ("客户名称", "customer_name"), ("Amount USD", "revenue"), ("金额", "revenue"), ("column1", "extra"), ("cust name_1", "other")]
    shapes = read_sources(spark, paths)
    single = unify([(str(i), df) for i, (_, _, df) in enumerate(shapes)], pairs)
    route_sources(spark, paths, f"{tmp_path}/routed")
    mapping = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(pairs)], "source_col string, to string, ord int")
    routed = unify_routed(spark, f"{tmp_path}/routed", mapping)
    assert routed.columns == single.columns
    assert sorted(map(tuple, routed.collect()), key=str) == sorted(map(tuple, single.collect()), key=str)


@pytest.mark.parametrize("data", [b"", b"a", b"a\n", b"\n", b"\n\n", b"a\r\nb\r", b"\xef\xbb\xbfa,b\n1", b"\xef\xbb\xbfa\n", b"\xff\x00\n\x80\xfe", b"\xef\xbb\xbf", b"x" * 70_000 + b"\n" * 50_000])
def test_content_hash_of_any_bytes(spark, tmp_path, data):
    (tmp_path / "f.csv").write_bytes(data)  # Spark lists no file of no bytes
    (tmp_path / "g.csv").write_bytes(data + b"!")
    got = {r["source_file"].rsplit("/", 1)[1]: r["content_hash"] for r in file_content_hashes(spark, str(tmp_path / "*.csv")).collect()}
    assert got == ({"f.csv": hashlib.sha256(data).hexdigest()[:16]} if data else {}) | {"g.csv": hashlib.sha256(data + b"!").hexdigest()[:16]}


def test_different_headers_in_one_read_are_refused(spark, tmp_path):
    a = write_text(tmp_path, "a.csv", "name,amt\nx,1\n")
    b = write_text(tmp_path, "b.csv", "amt,name\n2,y\n")
    with pytest.raises(UnsupportedSource):
        read_delimited(spark, [a, b])
    rows = [r for _, _, df in read_sources(spark, [a, b]) for r in df.select("name", "amt").collect()]
    assert sorted(map(tuple, rows)) == [("x", "1"), ("y", "2")]


def test_no_row_is_lost_when_splits_change(spark, tmp_path):
    p = write_text(tmp_path, "many.csv", "k,v\n" + "".join(f"{i},{i * 7}\n" for i in range(200_000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
        grid = read_grid(spark, p)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "90k")
        rows = grid.orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len({r["row_no"] for r in rows}) == len(rows) == 200_001
    assert [r["cells"][0] for r in rows] == ["k", *map(str, range(200_000))]


def test_multiline_cells(spark, tmp_path):
    p = write_text(tmp_path, "m.csv", 'a,b\n"x\ny,z,w",2\n3,4\n')
    df = read_delimited(spark, p, multiline=True)
    assert df.columns == ["a", "b", "source_file"]
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [("3", "4"), ("x\ny,z,w", "2")]


def test_many_small_files_share_tasks(spark, tmp_path, monkeypatch):
    """A task has many small files, a file of any size is one task's."""
    texts = {f"f{i}.csv": f"a,b\n{i},x\n" for i in range(60)} | {"large.csv": "k,v\n" + "1,some words\n" * 20000}
    for name, text in texts.items():
        write_text(tmp_path, name, text)
    parts = []

    def stored(df, session=None):
        parts.append(df.rdd.getNumPartitions())
        return materialize(df, session)

    monkeypatch.setattr(delimited, "materialize", stored)
    got = delimited.file_content_hashes(spark, f"{tmp_path}/*.csv").collect()
    assert {os.path.basename(r.source_file): r.content_hash for r in got} == {n: hashlib.sha256(t.encode()).hexdigest()[:16] for n, t in texts.items()}
    grid = delimited.read_grid(spark, f"{tmp_path}/*.csv")
    assert grid.groupBy("source_file").count().where("count = 2").count() == 60
    assert max(parts) <= 4 * spark.sparkContext.defaultParallelism


def test_documents_are_written_by_as_many_tasks_as_read_them(spark, tmp_path):
    rows = [(i, "en", f"line {i}\nand, \"more\"") for i in range(64)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{shared_folder(spark)}/tessera-exports/texts-*"))
    got = scan_queries.s1_multiline_cells(spark, str(tmp_path)).collect()
    assert sorted((int(r.doc_id), r.lang, r.text) for r in got) == rows
    (path,) = set(glob.glob(f"{shared_folder(spark)}/tessera-exports/texts-*")) - before
    assert len(glob.glob(f"{path}/*.csv")) > 3


def test_sheets_are_plain_files_in_a_few_folders(spark):
    """Every sheet is one file under its name, with no file of checksums and no folder of its own, and paths sort as names do."""
    names = ["b/1.csv", "a+b.csv", "客户 #2.csv", None, "z.csv", "c%d.csv"]
    rows = [(n, r, [str(r), "x,y"]) for n in names for r in (2, 1)] + [("long.csv", r, ["word", str(r)]) for r in range(25000)]
    grid = spark.createDataFrame(rows, "source_file string, row_no long, cells array<string>").repartition(3)
    path = scan_queries.export_dir(spark, "plain")
    pattern = scan_queries.write_grid_export(grid, path)
    found = sorted(os.path.join(d, f) for d, _, files in os.walk(path) for f in files)
    assert len(found) == len(names) + 1 and all(f.endswith(".txt") for f in found)
    assert len({os.path.dirname(f) for f in found}) <= 4 * spark.sparkContext.defaultParallelism
    assert [os.path.basename(f) for f in found] == sorted(os.path.basename(f) for f in found)
    read = delimited.read_grid(spark, pattern).withColumn("source_file", scan_queries._sheet_name("source_file"))
    got = {}
    for r in sorted(read.collect(), key=lambda r: (r.source_file, r.row_no)):
        got.setdefault(r.source_file, []).append(r.cells)
    assert len(got.pop("long.csv")) == 25000
    # names come back as from a partition's folder: escaped characters stay so, a plus is a blank
    assert set(got) == {"b%2F1.csv", "a b.csv", "客户 %232.csv", "__HIVE_DEFAULT_PARTITION__", "z.csv", "c%25d.csv"}
    assert all(cells == [["1", "x,y"], ["2", "x,y"]] for cells in got.values())


ODD_FILES = {"mark.csv": "\ufeffa,b\n\ufeff1,2\n", "marks.csv": "\ufeff\ufeffa\n", "ends.csv": "a,b\r\n1,2\r\r\n\n3,4", "quotes.csv": EDGE,
             "blank.csv": "\n\r\n", "one.txt": "x", "bytes.csv": b"a,\xff\xe5\n\xe5\xae,b\n", "none.csv": ""}


def _odd_folder(tmp_path):
    for i, (name, text) in enumerate(ODD_FILES.items()):
        folder = tmp_path / f"{i % 3}.csv"
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"{tmp_path}/*.csv"


def test_small_files_have_the_line_readers_rows(spark, tmp_path, monkeypatch):
    path = _odd_folder(tmp_path)

    def grid():
        rows = sorted((os.path.basename(r.source_file), r.row_no, r.cells) for r in delimited.read_grid(spark, path, ",").collect())
        return rows

    small = grid()
    assert ("ends.csv", 2, ["3", "4"]) in small and ("mark.csv", 1, ["1", "2"]) in small and ("marks.csv", 0, ["a"]) in small
    monkeypatch.setattr(delimited, "SMALL", 4)
    assert grid() == small  # some are read as a value, others by the line reader
    monkeypatch.setattr(delimited, "SMALL", -1)
    assert grid() == small
    whole = {n: t if isinstance(t, bytes) else t.encode() for n, t in ODD_FILES.items() if n not in ("none.csv", "mark.csv", "marks.csv")}
    for size in (4, 1 << 20):
        monkeypatch.setattr(delimited, "SMALL", size)
        got = {os.path.basename(r.source_file): r.content_hash for r in delimited.file_content_hashes(spark, path).collect()}
        assert {n: got[n] for n in whole} == {n: hashlib.sha256(t).hexdigest()[:16] for n, t in whole.items()}
        assert len(got) == len(ODD_FILES) - 1


def test_folders_are_listed_in_groups(spark, tmp_path, monkeypatch):
    path = _odd_folder(tmp_path)
    whole = sorted(delimited.read_grid(spark, path, ",").collect())
    monkeypatch.setattr(delimited, "LISTED", 4)
    groups = list(delimited._groups(spark, [path]))
    assert len(groups) == 3 and sum(map(len, groups)) == 3
    assert sorted(delimited.read_grid(spark, path, ",").collect()) == whole
    assert delimited.file_content_hashes(spark, path).count() == len(ODD_FILES) - 1
    assert list(delimited._groups(spark, [f"{tmp_path}/*/*.csv", f"{tmp_path}/none"])) == [[f"{tmp_path}/*/*.csv", f"{tmp_path}/none"]]


def test_multiline_records_over_many_splits(spark, tmp_path, monkeypatch):
    """Records that begin, end and go on through splits of a few bytes; lines are stored once, as records."""
    cells = [["id", "text"]] + [[str(i), "\n".join(["", f'say "{i}"', "\r", "word " * (i % 7)] * (i % 5))] for i in range(120)] + [["long", "x\n" * 400], ["end", ""]]
    for name, rows in (("a.csv", cells), ("plain.csv", [["a", "b"]] + [[str(i), "v"] for i in range(300)])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\n\n").writerows(rows)
    whole = sorted(map(str, delimited.read_grid(spark, f"{tmp_path}/*.csv", multiline=True).collect()))
    assert len(whole) == len(cells) + 301
    reader = delimited._reader
    monkeypatch.setattr(delimited, "_reader", lambda s, **conf: reader(s, **conf | {"spark.sql.files.maxPartitionBytes": 97, "spark.sql.files.openCostInBytes": 1}))
    stored = []
    monkeypatch.setattr(delimited, "materialize", lambda df, session=None: (stored.append(df.columns), materialize(df, session))[1])
    assert sorted(map(str, delimited.read_grid(spark, f"{tmp_path}/*.csv", multiline=True).collect())) == whole
    assert sum("text" in c or "value" in c or "cells" in c for c in stored) == 1
    got = {r.cells[0]: r.cells[1] for r in delimited.read_grid(spark, f"{tmp_path}/a.csv", multiline=True).collect()}
    assert got == dict(cells)
