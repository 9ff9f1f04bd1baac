import hashlib
import random
import re

import pytest
from fixtures import DOC_SCHEMA, doc, odd_rows, prose
from pyspark.sql import functions as F

from millrace.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    out = []
    for doc_id, text in docs:
        w, hit, held = words(text), set(), set()
        for item_id, item in items:
            i = words(item)
            span = min(n, len(i))
            for a in range(len(i) - span + 1) if i else ():
                for s in range(len(w) - span + 1):
                    if w[s:s + span] == i[a:a + span]:
                        hit.update(range(s, s + span))
                        held.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(x for x in held if x is not None)))
    return sorted(out, key=repr)


def rows_of(df):
    found = df.select("doc_id", "n_words", d.covered(F.col("windows")).alias("n_hit"), "items").collect()
    return sorted(((r[0], r[1], r[2], r[3]) for r in found), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([10, 12, 25]))) for i in range(6)]
    items += [(6, "just three words"), (7, "Short"), (8, ""), (9, None), (None, prose(rng, 11)), (10, items[0][1].upper())]
    docs = [(i, prose(rng, rng.randrange(1, 60))) for i in range(20)]
    for i in range(20, 40):
        w = items[rng.choice([0, 1, 2, 3, 4, 5])][1].split()
        cut = w[rng.randrange(3):len(w) - rng.randrange(3)]
        docs.append((i, prose(rng, 5) + " " + "; ".join(cut) + ". " + prose(rng, 5)))
    docs += [(40, "well, JUST three\nwords here"), (41, "short"), (42, "É short é"), (43, "a " * 50 + items[1][1] * 2)]
    docs += [(r[0], r[1]) for r in odd_rows() if r[0] != 904]
    got = rows_of(d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10))
    want = brute(sorted(set(docs), key=repr), items, 10)
    assert got == sorted(want, key=repr)


def test_case_folds_ascii_only(spark):
    item = " ".join(f"é{i}" for i in range(10))
    docs = [(1, item), (2, item.upper()), (3, item.replace("é", "É"))]
    got = rows_of(d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert [r[2] for r in got] == [10, 0, 0]


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, "...")]])
def test_nothing_to_find(spark, items):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = d.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == [(1, 2, 0, []), (2, 0, 0, [])]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert d.contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_clean_rows_stay_with_their_columns(spark):
    rng = random.Random(2)
    item = prose(rng, 30)
    rows = odd_rows() + [doc(1, "x " + item), doc(None, item), doc(2, prose(rng, 40))]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("hash", F.lit(1)).withColumn("window", F.lit("w"))
    kept = d.decontaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 2
    assert kept.where("doc_id = 903").count() == 2


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = d.contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query_digest(spark, data_dir):
    from millrace.llm.queries import QUERIES

    row = QUERIES["op1_decontamination"](spark, data_dir).where("not contaminated").first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_case_does_not_depend_on_what_stands_between_words(spark):
    w = [f"{c}ΟΣ" for c in "ΑΒΓΔΕΖΗΘΙΚ"]
    docs = [(1, " ".join(w)), (2, ".".join(w)), (3, ".ΤΙ ".join(w)), (4, " ".join(w).lower())]
    items = [(1, ".".join(w))]
    got = rows_of(d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items, 10)
    assert [r[2] for r in got] == [10, 10, 0, 0]
