"""Stateless replay on a stream of arriving exports."""

import uuid

import pytest

from conftest import SALES_JAN, write_text
from tessera.operators.ops import StepError
from tessera.streaming.replay import checkpoint_location, replay_stream, stream_exports

STEPS = [{"op": "map_column", "from": "Cust Name", "to": "customer_name"},
         {"op": "map_column", "from": "Amount USD", "to": "revenue"},
         {"op": "cast", "column": "revenue", "type": "DECIMAL"},
         {"op": "filter", "predicate": "revenue > 1000"}]


def test_stream_replay(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write_text(d, "jan.csv", SALES_JAN)
    header = SALES_JAN.splitlines()[0].split(",")
    out = replay_stream(stream_exports(spark, str(d), header), STEPS)
    q = (out.writeStream.format("memory").queryName("replayed")
         .option("checkpointLocation", checkpoint_location(spark, f"replay-{uuid.uuid4().hex}")).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select customer_name, revenue from replayed").collect()
    assert sorted(r["customer_name"] for r in rows) == ["Acme Corp", "Acme Corp", "Initech"]


def test_stream_dedupe_needs_event_time(spark, tmp_path):
    d = tmp_path / "in2"
    d.mkdir()
    write_text(d, "jan.csv", SALES_JAN)
    s = stream_exports(spark, str(d), SALES_JAN.splitlines()[0].split(","))
    with pytest.raises(StepError):
        replay_stream(s, STEPS + [{"op": "dedupe", "keys": ["customer_name"]}])


def test_stream_dedupe_with_watermark(spark, tmp_path):
    d = tmp_path / "in3"
    d.mkdir()
    write_text(d, "jan.csv", SALES_JAN)
    steps = [{"op": "map_column", "from": "Cust Name", "to": "customer_name"},
             {"op": "map_column", "from": "Date Purchased", "to": "order_date"},
             {"op": "parse_date", "column": "order_date", "to": "order_date", "format": "auto"},
             {"op": "derive", "expr": "CAST(order_date AS TIMESTAMP)", "to": "ts"},
             {"op": "dedupe", "keys": ["customer_name", "order_date"]}]
    s = stream_exports(spark, str(d), SALES_JAN.splitlines()[0].split(","))
    out = replay_stream(s, steps, event_time="ts", watermark="7 days")
    q = (out.writeStream.format("memory").queryName("deduped").outputMode("append")
         .option("checkpointLocation", checkpoint_location(spark, f"dedupe-{uuid.uuid4().hex}")).start())
    q.processAllAvailable()
    q.stop()
    names = sorted(r["customer_name"] for r in spark.sql("select customer_name from deduped").collect())
    assert names == ["Acme Corp", "Globex", "Initech", "Umbrella"]
