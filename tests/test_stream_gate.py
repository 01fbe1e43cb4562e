"""Streams in several batches: the gate's decisions and the totals are those of the whole table, and late rows are left out."""

import random
from datetime import datetime, timedelta

from quayside.streaming import gate, windows

SCHEMA = "key string, ts timestamp, id bigint, a double, b double"
PARTS = ["a", "b"]


def rows_of(seed, hours, alike):
    rng, out = random.Random(seed), []
    for k in range(hours * 12):
        ts = datetime(2024, 5, 1) + timedelta(minutes=5 * k + rng.random())
        side = (k // 6) % 2 if alike else k % 2
        out.append(("runs" if alike else "turns", ts, k, 1.0 + 9 * side + rng.random(), 10.0 - 9 * side + rng.random()))
    return out


def test_batches_give_the_decisions_of_the_whole_table(spark, tmp_path):
    rows = rows_of(1, 30, True) + rows_of(2, 30, False) + [(None, datetime(2024, 5, 1, 2), 9000 + k, 1.0, float(k)) for k in range(3)]
    rows += [("runs", datetime(2024, 5, 1, 1), 7000, None, None), ("lone", datetime(2024, 5, 1, 1), 7001, 1.0, 1.0)]
    whole = spark.createDataFrame(rows, SCHEMA)
    late = [("runs", datetime(2024, 5, 1, 0, 30), 8000 + k, 50.0, 1.0) for k in range(4)]
    # in order of time, then the late ones, then one that moves the watermark to the end
    batches = [rows, late, [("end", datetime(2024, 5, 9), 1, 1.0, 1.0)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found, dropped = gate.drained(spark, gate.rolling_gate(stream, PARTS, seconds=3600, lateness="10 minutes"))
    assert dropped == len(late)
    want = gate.gate_by_window(whole, PARTS, seconds=3600)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, want.collect())))
    mean = {r["key"]: r["m"] for r in found.groupBy("key").avg("gate_score").withColumnRenamed("avg(gate_score)", "m").collect()}
    assert mean["runs"] > 0.1 > 0 > mean["turns"]
    assert found.where("key = 'lone'").count() == 0 and found.where("key IS NULL").count() == 1


def test_an_empty_table_decides_nothing(spark):
    assert gate.gate_by_window(spark.createDataFrame([], SCHEMA), PARTS).count() == 0


def test_totals_change_until_the_watermark_closes_their_window(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    at = lambda hour, minute=0: datetime(2024, 5, 1, hour, minute)
    batches = [
        [(at(1), "a", 1.5), (at(1, 30), "a", 2.0), (at(2), "b", 1.0)], [(at(1, 45), "a", 0.25), (at(5), "b", 4.0)],
        [(at(5, 10), "b", 1.0)], [(at(1, 50), "a", 100.0), (at(5, 59), None, 7.0)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["event_type"], r["window_start"]): (r["n"], r["value_milli"]) for r in windows.merged(spark, windows.windowed(stream)).collect()}
    base = int((datetime(2024, 5, 1) - datetime(1970, 1, 1)) / timedelta(seconds=1))
    # the row of 1:50 comes after the batch whose watermark closed its window
    assert got == {("a", base + 3600): (3, 3750), ("b", base + 7200): (1, 1000), ("b", base + 18000): (2, 5000), (None, base + 18000): (1, 7000)}
