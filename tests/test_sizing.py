"""Running sums within a key that is split over many tasks; shared folder rule."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog as cat
from tessera.operators.sizing import running_sums
from tessera.session import shared_folder


def plain(rows):
    out, at = [], {}
    for k, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        at[k] = at.get(k, 0) + v
        out.append((k, o, at[k]))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys", [[7], [1, 7, 7, 7, None], list(range(300)), [None]])
def test_running_sums_equal_a_plain_loop(spark, keys):
    rnd = random.Random(len(keys))
    rows = [(rnd.choice(keys), o, rnd.randint(-5, 9)) for o in range(2000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(5)
    got = running_sums(df, "k", ["o"], {"s": F.col("v")}).select("k", "o", "s").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_running_sums_of_nothing(spark):
    df = spark.createDataFrame([], "k int, o int")
    assert running_sums(df, "k", ["o"], {"n": F.lit(1)}).collect() == []


def test_hot_name_is_versioned_in_many_tasks(spark):
    new = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 50)).alias("name"))
    existing = spark.createDataFrame([("hot", 4), ("hot", 2), ("n1", 7)], "name string, version int")
    got = {r["id"]: r["version"] for r in cat.append_versions(existing, new).collect()}
    assert [got[i] for i in range(0, 9000, 3)] == list(range(5, 3005))
    assert len(got) == 9000 and got[1] == 8 and got[2] == 1
    placed = running_sums(new, "name", ["id"], {"n": F.lit(1)})
    parts = placed.where("name = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_shared_folder_is_the_clusters_own(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(Session(spark_master=master))
    own = Session(spark_master="local[2]")
    assert shared_folder(own) == own.conf["spark.checkpoint.dir"]
