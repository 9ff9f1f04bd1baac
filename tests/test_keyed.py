"""Streams with a state for each key, against what the batch forms give on the same rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.operators.rates import rate_audit
from millrace.streaming import jobs as T
from millrace.streaming import keyed as K

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
EVENTS = "who string, ts timestamp"


def test_rates_equal_the_audit_of_closed_times(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rng, rows, now = random.Random(3), [], 0
    batches = []
    for _ in range(4):
        batch = []
        for _ in range(150):
            now += rng.choice([0, 0, 137, 400_000, 2_500_000, 9_000_001])
            batch.append((rng.choice(["a", "a", "b", None]), START + dt.timedelta(microseconds=now)))
        rng.shuffle(batch)
        batches.append(batch)
        rows += batch
        now += 30_000_000
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = T.read_files(spark, src, spark.createDataFrame([], EVENTS).schema)
        K.write_exact_rates(stream, 4, 10, ["who"], out, state, watermark="20 seconds").awaitTermination()
    last = max(t for _, t in rows)
    closed = last.replace(microsecond=last.microsecond // 1000 * 1000) - dt.timedelta(seconds=20)
    want = rate_audit(spark.createDataFrame(rows, EVENTS), 4, 10, ["who"]).filter(F.col("at") <= F.lit(closed)).select(
        "who", F.unix_micros("at"), "at_time", "in_window")
    got = spark.read.parquet(out).select("who", "at_us", "at_time", "in_window")
    expected = sorted(map(tuple, want.collect()), key=repr)
    assert expected and sorted(map(tuple, got.collect()), key=repr) == expected


def test_settings_of_the_session_stay(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with K.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before
