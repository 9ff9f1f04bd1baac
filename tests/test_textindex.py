"""The index in segments against one made anew, and what a search leaves unread."""

import os
import random

from millrace.operators import retrieval as R
from millrace.operators import textindex as X

SCHEMA = "id long, title string, body string"
WORDS = [f"w{i}" for i in range(40)]


def text(rng, n):
    return " ".join(WORDS[min(int(rng.expovariate(0.15)), 39)] for _ in range(n))


def some(rng, ids):
    return [(i, rng.choice([text(rng, 3), None, ""]), text(rng, int(rng.expovariate(0.03)))) for i in ids]


QUERIES = [(1, "w0"), (2, "w0 w1"), (3, "W2, w3 w4"), (4, "w20"), (5, "w39 w0"), (6, "nowhere w0"), (7, "")]


def ranks(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_updates_and_merges_equal_an_index_made_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_DOCS", 8)
    rng = random.Random(5)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    root, held = str(tmp_path / "index"), {}
    steps = [(range(150), []), (range(140, 170), [3, 4]), ([3, 200, *range(20)], [140, 999]), ([], [200])]
    for step, (ids, gone) in enumerate(steps):
        rows = some(rng, ids)
        X.update(spark, root, frame([*rows, (None, "w0", "w0")]), ["title", "body"], spark.createDataFrame([(i,) for i in gone], "id long"))
        for i in gone:
            held.pop(i, None)
        held.update({r[0]: r for r in rows})
        want = ranks(R.bm25(frame(list(held.values())), ["title", "body"], queries, 7))
        if step == 3:
            assert ranks(X.search(spark, root, queries, 7, waves=(1, 3))) == want
    assert len(X.segments(spark, root)) == len(steps)
    assert X.merge(spark, root, 3) == 0  # no three of a size
    assert X.merge(spark, root, 2) >= 1 and len(X.segments(spark, root)) < len(steps)
    assert ranks(X.search(spark, root, queries, 7)) == want
    allowed = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "id long")
    assert ranks(X.search(spark, root, queries, 4, allowed=allowed)) == ranks(
        R.bm25(frame(list(held.values())), ["title", "body"], queries, 4, allowed=allowed))


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_DOCS", 16)
    rng = random.Random(8)
    docs = spark.createDataFrame(some(rng, range(3000)), SCHEMA)
    queries = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    X.update(spark, str(tmp_path / "i"), docs, ["title", "body"])
    found, work = X.search(spark, str(tmp_path / "i"), queries, 5, report=True)
    assert ranks(found) == ranks(R.bm25(docs, ["title", "body"], queries, 5))
    by_query = {r["query_id"]: r for r in work.collect()}
    # The commonest word is in most documents: of its blocks less than a quarter is unpacked.
    assert by_query[1]["buckets"] > 100 and by_query[1]["scored"] < by_query[1]["buckets"] / 4
    assert by_query[1]["unpacked"] < by_query[1]["postings"] / 4 and by_query[2]["scored"] < by_query[2]["buckets"]


def test_an_update_writes_what_changed(spark, tmp_path):
    rng = random.Random(9)
    root = str(tmp_path / "i")
    first = X.update(spark, root, spark.createDataFrame(some(rng, range(3000)), SCHEMA), ["title", "body"])
    second = X.update(spark, root, spark.createDataFrame(some(rng, range(30)), SCHEMA), ["title", "body"])
    rows = lambda s, t: spark.read.parquet(f"{root}/{s.folder}/{t}").count()
    assert rows(second, "docs") == 30 and rows(second, "dead") == 30 and rows(second, "stats") <= 41
    size = lambda s: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/{s.folder}/blocks") for f in fs)
    assert size(second) < size(first) / 5


def test_nothing_indexed(spark, tmp_path):
    X.update(spark, str(tmp_path / "i"), spark.createDataFrame([], SCHEMA), ["title", "body"])
    queries = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    assert X.search(spark, str(tmp_path / "i"), queries, 5).count() == 0
    assert X.segments(spark, str(tmp_path / "none")) == []
