"""Values on which a query once differed from its SQL."""

import html
import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.functions.html import unescape
from millrace.functions.text import clean_bullet


def test_a_ticker_without_stored_prices_gives_nothing(spark, rows):
    from millrace.queries.market import fin_incremental

    prices = spark.createDataFrame(
        [("a", date(2024, 1, 1), 9e4), ("a", date(2024, 1, 5), 2e5), ("b", date(2024, 1, 2), 2e5)], "ticker string, price_date date, close double")
    assert rows(fin_incremental(lambda _: prices), "ticker", "price_date") == [("a", date(2024, 1, 1)), ("a", date(2024, 1, 5))]


def test_halves_of_a_level_go_to_the_even_number(spark, rows):
    from millrace.queries.notes import note_fill

    tidy = spark.createDataFrame([("x", "3050000", True), ("y", "3150000", True)], "detail_id string, value string, abstract boolean")
    assert rows(note_fill(lambda _: tidy), "detail_id", "small_level") == [("x", 30), ("y", 32)]


@pytest.mark.parametrize("parts", [0, 3])
def test_a_stream_reads_a_table_of_one_file_or_of_many(spark, data_dir, tmp_path, parts):
    from millrace.queries import QUERIES

    for name in ("pages", "documents", "orders"):
        if parts:
            spark.read.parquet(f"{data_dir}/{name}.parquet").repartition(parts).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            shutil.copy(f"{data_dir}/{name}.parquet", tmp_path)
    where = str(tmp_path)
    for name, table in (("stream_redact", "documents"), ("stream_pending", "orders")):
        assert QUERIES[name](spark, where).count() == spark.read.parquet(f"{where}/{table}.parquet").count()
    urls = [r.url for r in QUERIES["stream_links"](spark, where).collect()]
    assert urls and len(urls) == len(set(urls))


def test_a_capital_is_one_letter(spark):
    texts = ["ßa", "ŉa", "ﬁa", "ᾳa", "éa", "aß", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.b for r in df.select("i", clean_bullet(F.col("t")).alias("b")).orderBy("i").collect()] == ["ẞa", "ŉa", "ﬁa", "ᾼa", "Éa", "Aß", ""]


def test_references_are_read_as_the_html_module_reads_those_with_a_semicolon(spark):
    texts = ["a &amp; b", "&amp;amp;", "&lt;p&gt;&quot;", "&eacute;&fjlig;&NotEqualTilde;", "&#233;&#xE9;&#0065;&#x1F600;", "&#0;&#128;&#129;&#x110000;&#xD800;",
             "&#99999999999999;", "&#1;&#xfffe;", "&nosuch;", "&;&&", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "a &amp b", "&lt"])], "i int, t string")
    got = [r.u for r in df.select("i", unescape(F.col("t")).alias("u")).orderBy("i").collect()]
    assert got == [html.unescape(t) if t else t for t in texts] + ["a &amp b", "&lt"]
    assert "Python" not in df.select(unescape(F.col("t")))._jdf.queryExecution().toString()


def test_words_are_counted_without_a_shuffle(spark, rows):
    from millrace.operators import retrieval as R

    docs = spark.createDataFrame([(1, "b a, B a-a"), (2, " -"), (3, None), (4, "Ä a"), (None, "a")], "id long, title string")
    assert rows(R.postings(docs, ["title"])) == sorted([("a", 1, 5, 3), ("b", 1, 5, 2), ("ä", 4, 2, 1), ("a", 4, 2, 1)], key=repr)
    plan = R.postings(docs, ["title"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan


def test_a_segment_keeps_how_often_a_document_has_a_word(spark, tmp_path):
    from millrace.operators import textindex as X

    docs = spark.createDataFrame([(1, "b a, B a-a"), (2, " -"), (3, None)], "id long, title string")
    made = X.update(spark, str(tmp_path), docs, ["title"])
    kept = spark.read.parquet(f"{tmp_path}/{made.folder}/docs").orderBy("id").collect()
    assert [(r.id, r.length, r.words, r.times) for r in kept] == [(1, 5, ["a", "b"], [3, 2]), (2, 0, [], []), (3, 0, [], [])]


def test_a_merge_leaves_sides_where_their_keys_are(spark, rows, data_dir):
    from millrace.operators import sync as S
    from millrace.queries import QUERIES

    target = spark.createDataFrame([(1, "a", "x", 1), (None, "b", None, 2), (None, "c", "y", 3), (4, "d", "z", 4)], "id long, v string, made string, own int")
    source = spark.createDataFrame([(1, None, "n", 5), (None, "new", "n", 5), (None, "old", "n", 4), (7, "e", "n", 1)], "id long, v string, made string, updated_at int")
    want = [(1, None, "x", 1), (None, "new", "n", 2), (None, "new", "y", 3), (4, "d", "z", 4), (7, "e", "n", None)]
    assert rows(S.merge(target, source, ["id"], keep=["made"])) == sorted(want, key=repr)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["note_upsert"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # One for the rows of each id, made once for both sides, and one for the other ids of the new rows.
    dealt = [line for line in plan.splitlines() if "- Exchange hashpartitioning(" in line and "detail_id" in line]
    assert len(dealt) == 2 and plan.count("- ReusedExchange") == 1
