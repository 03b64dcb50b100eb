"""Header names: both forms, and the naming of a real CSV reader."""

import random

import duckdb
import pytest

from tessera.functions.names import header_names, header_names_py, unique_names, unique_names_py

CASES = [
    ["a", "b", "", "A", None], ["x", "x", "x"], ["a", "a_1", "a"], ["a", "A", "a_1"], ["a", "a", "a_1", "a"], ["column1", "", "b"],
    ["a", " a ", "A"], ["_", "_", "_1"], [], ["", "", ""], ["é", "É", "日期", "日期"], ["a_1", "a", "a", "a_1_1", "A_1"],
]


def test_both_forms_agree(spark):
    rnd = random.Random(4)
    cases = CASES + [[rnd.choice(["a", "A", "a_1", "a_1_1", "", None, " b", "b", "B_2", "column2"]) for _ in range(rnd.randint(0, 9))] for _ in range(200)]
    df = spark.createDataFrame([(c,) for c in cases], "cells array<string>")
    got = df.select(header_names("cells").alias("h")).collect()
    assert [r.h for r in got] == [header_names_py(c) for c in cases]
    plain = [[x or "" for x in c] for c in cases]
    got = spark.createDataFrame([(c,) for c in plain], "cells array<string>").select(unique_names("cells").alias("u")).collect()
    assert [r.u for r in got] == [unique_names_py(c) for c in plain]
    assert all(len({n.lower() for n in header_names_py(c)}) == len(c) for c in cases)


# (that reader compares ASCII letters only; Spark finds columns by any letter's lower case)
@pytest.mark.parametrize("cells", [c for c in CASES if len(c) > 1 and any(c) and "É" not in c])
def test_names_equal_those_of_a_csv_reader(tmp_path, cells):
    path = tmp_path / "h.csv"
    path.write_text(",".join(c or "" for c in cells) + "\n" + ",".join("1" * len(cells)) + "\n")
    read = duckdb.sql(f"SELECT * FROM read_csv('{path}', header=true, all_varchar=true, null_padding=true)")
    assert [d[0] for d in read.description] == header_names_py(cells)
