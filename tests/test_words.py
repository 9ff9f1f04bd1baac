"""Words cut in Arrow batches against the session's own regular expression, and what is made of them."""

import random

from pyspark.sql import functions as F

from millrace.functions import words as W
from millrace.operators import retrieval as R
from millrace.operators import textindex as X


def test_words_are_those_of_the_sessions_pattern(spark, monkeypatch):
    rng = random.Random(3)
    letters = "aB é,.\n漢字𝒜😀1２٣ -ßİ_'́ǅⅣ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, None if i % 7 else "Z z") for i, t in enumerate([*texts, "", " ", "é", None])], "id long, a string, b string")
    found = F.filter("_c", lambda c: c["token"] != "")
    plain = R._counted_rows(R._split_docs(docs, ["a", "b"]), F.col("_p")).select("id", "length", found.alias("_c"))
    want = sorted((r.id, r.length, [c.token for c in r._c], [c.tf for c in r._c]) for r in plain.collect())
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(W, "CUT_BYTES", size)
        table = W.word_letters(spark, R._WORD_GAP)
        lower = docs.select("id", F.lower(F.concat_ws(" ", "a", "b")).alias("t")).toArrow()
        got = [r for b in W.count_words(lower.to_batches(), table) for r in b.to_pylist()]
        assert sorted((r["id"], r["length"], r["words"], r["times"]) for r in got) == want
    assert sorted((r.id, r.length, list(r.words), list(r.times)) for r in X._words(docs, ["a", "b"]).collect()) == want


def test_bytes_that_are_no_text_part_words(spark):
    table = W.word_letters(spark, R._WORD_GAP)
    docs = spark.createDataFrame([(1, bytearray(b"ab\xffcd \xc3\xa9\xc3"))], "id long, raw binary").select("id", F.lower(F.col("raw").cast("string")).alias("t"))
    batch = docs.mapInArrow(lambda batches: W.count_words(batches, table), "id long, length int, words array<string>, times array<long>").first()
    assert (batch.length, batch.words, batch.times) == (3, ["ab", "cd", "é"], [1, 1, 1])


def test_a_bucket_has_a_bound_of_words_and_blocks_are_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_WORDS", 100)
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(20))) for i in range(200)]
    made = X.update(spark, str(tmp_path), spark.createDataFrame(rows, "id long, title string"), ["title"])
    blocks = spark.read.parquet(f"{tmp_path}/{made.folder}/blocks")
    words = blocks.select("bucket", F.explode("postings").alias("p")).groupBy("bucket").agg(F.sum("p.tf").alias("n")).collect()
    assert sum(r.n for r in words) == 4000 and len(words) > 20 and max(r.n for r in words) < 400
    for r in blocks.collect():
        ids = [p.id for p in r.postings]
        assert ids == sorted(ids) and r.n == len(ids) and r.max_tf == max(p.tf for p in r.postings) and r.min_length == min(p.length for p in r.postings)


def test_a_merged_segment_keeps_how_often_a_document_has_a_word(spark, tmp_path):
    root = str(tmp_path)
    X.update(spark, root, spark.createDataFrame([(1, "a a b"), (2, "b")], "id long, title string"), ["title"])
    X.update(spark, root, spark.createDataFrame([(2, "c c c"), (3, "a")], "id long, title string"), ["title"])
    assert X.merge(spark, root, 2) == 1
    made, = X.segments(spark, root)
    docs = spark.read.parquet(f"{root}/{made.folder}/docs").orderBy("id").collect()
    assert [(r.id, r.words, r.times) for r in docs] == [(1, ["a", "b"], [2, 1]), (2, ["c"], [3]), (3, ["a"], [1])]
    assert made.docs == 3


def test_segments_without_these_numbers_are_merged_from_their_blocks(spark, tmp_path):
    root = str(tmp_path / "i")
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query_text string")
    frames = [spark.createDataFrame(r, "id long, title string") for r in ([(1, "a a b"), (2, "b")], [(2, "c c a"), (3, "a")])]
    for f in frames:
        made = X.update(spark, root, f, ["title"])
        place = f"{root}/{made.folder}/docs"
        rows = spark.read.parquet(place).drop("times").collect()
        spark.createDataFrame(rows, "id long, length int, words array<string>").write.mode("overwrite").parquet(place)
    assert X.merge(spark, root, 2) == 1
    want = R.bm25(spark.createDataFrame([(1, "a a b"), (2, "c c a"), (3, "a")], "id long, title string"), ["title"], queries, 5)
    assert sorted(map(tuple, X.search(spark, root, queries, 5).collect())) == sorted(map(tuple, want.collect()))
