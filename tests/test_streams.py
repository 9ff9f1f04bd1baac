"""Streaming forms: replay, order inside a batch, compaction, late rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.streaming import jobs as T

KIND = "id long, v string, at int, op string"


def feed(spark, folder, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


def test_upsert_over_batches_with_delete_and_compaction(spark, tmp_path, rows):
    src, root, state = (str(tmp_path / n) for n in ("src", "root", "state"))
    schema = spark.createDataFrame([], KIND).schema

    def run():
        T.upsert_changes(T.read_files(spark, src, schema), root, ["id"], ["at"], state, seconds=None).awaitTermination()

    now = lambda: rows(T.current_rows(spark, root, ["id"], ["at"]), "id", "v")
    feed(spark, src, [(1, "a", 1, "upsert"), (1, "b", 2, "upsert"), (2, "c", 1, "upsert")])
    run()
    assert now() == [(1, "b"), (2, "c")]
    feed(spark, src, [(2, "c", 5, "delete"), (3, "d", 1, "upsert")])
    run()
    assert now() == [(1, "b"), (3, "d")]
    assert T.compact(spark, root, ["id"], ["at"]) == 1
    assert now() == [(1, "b"), (3, "d")]
    feed(spark, src, [(2, "again", 1, "upsert"), (1, "z", 1, "upsert")])
    run()
    assert now() == [(1, "z"), (2, "again"), (3, "d")]
    run()  # nothing new
    assert now() == [(1, "z"), (2, "again"), (3, "d")]
    # A new checkpoint counts its batches from 0 again and reads all files anew.
    feed(spark, src, [(3, "e", 9, "upsert"), (4, "f", 1, "upsert")])
    state = str(tmp_path / "other")
    run()
    assert (3, "e") in now() and (4, "f") in now()
    assert T.compact(spark, root, ["id"], ["at"]) == T.compact(spark, root, ["id"], ["at"])
    feed(spark, src, [(4, "g", 2, "upsert"), (5, "h", 1, "upsert")])
    run()
    assert (4, "g") in now() and (5, "h") in now() and (3, "e") in now()
    # A base that isn't published is not read.
    spark.createDataFrame([(99, "x", 1, "upsert")], KIND).write.parquet(f"{root}/base/half")
    assert all(r[0] != 99 for r in now())


def test_what_cannot_be_read_is_not_taken_for_empty(spark, tmp_path):
    root = tmp_path / "root"
    (root / "changes").mkdir(parents=True)
    (root / "changes" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|schema|footer"):
        T.current_rows(spark, str(root), ["id"], ["at"]).count()


def test_tail_keeps_rows_that_share_a_time(spark, tmp_path):
    kind = "id long, log_ts timestamp, level string, tag string, job_id string, message string, payload_json string"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    at = datetime(2024, 1, 1)
    for i in range(3):
        spark.createDataFrame([(i, at, "ERROR", "A:B", "j", "m", None)], kind).write.mode("append").parquet(src)
        stream = T.tail(T.read_files(spark, src, spark.createDataFrame([], kind).schema), level="ERROR", tag="A")
        T.write_rows(stream, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_late_rows_are_dropped(spark, tmp_path):
    kind = "level string, log_ts timestamp"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = spark.createDataFrame([], kind).schema
    for hour, day in ((0, 1), (5, 1), (0, 1), (9, 1)):
        spark.createDataFrame([("ERROR", datetime(2024, 1, day, hour, 30))], kind).write.mode("append").parquet(src)
        T.write_rows(T.live_stats(T.read_files(spark, src, schema)), out, state).awaitTermination()
    got = {(r.window_start.hour, r.entries, r.errors) for r in spark.read.parquet(out).collect()}
    assert got == {(0, 1, 1), (5, 1, 1)}


def test_links_seen_before_are_dropped(spark, tmp_path):
    kind = "url string, at timestamp"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    at = datetime(2024, 1, 1)
    known = spark.createDataFrame([("k",)], "url string")
    for urls in (["a", "k", "a"], ["a", "b"]):
        spark.createDataFrame([(u, at) for u in urls], kind).write.mode("append").parquet(src)
        stream = T.new_links(T.read_files(spark, src, spark.createDataFrame([], kind).schema), known, "at")
        T.write_rows(stream, out, state).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_dead_letters_in_the_same_batch(spark, tmp_path):
    src, good, bad, state = (str(tmp_path / n) for n in ("src", "good", "bad", "state"))
    feed(spark, src, [(1, "ok", 1, "upsert"), (2, None, 1, "upsert")])
    stream = T.read_files(spark, src, spark.createDataFrame([], KIND).schema)
    T.with_dead_letters(stream, F.when(F.col("v").isNull(), "no value"), "t", ["id"], good, bad, state, seconds=None).awaitTermination()
    assert [r.id for r in spark.read.parquet(good).collect()] == [1]
    assert [(r.row_id, r.error_message) for r in spark.read.parquet(bad).collect()] == [("2", "no value")]
    feed(spark, src, [(3, "ok", 1, "upsert")])
    stream = T.read_files(spark, src, spark.createDataFrame([], KIND).schema)
    again = str(tmp_path / "again")
    T.with_dead_letters(stream, F.when(F.col("v").isNull(), "no value"), "t", ["id"], good, bad, again, seconds=None).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(good).collect()) == [1, 1, 3]
