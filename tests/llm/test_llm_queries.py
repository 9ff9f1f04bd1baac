"""Every query of this package against its SQL, and the guard of the entry point."""

import duckdb
import pytest

from millrace.llm.queries import CHECKS, QUERIES


@pytest.fixture(scope="module")
def engine(data_dir):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(spark, data_dir, engine, name):
    df = QUERIES[name](spark, data_dir)
    cursor = engine.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


def test_registered():
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name,label,parts,held", [("op4_toxicity", "toxic", 5, 0), ("op7_language", "lang", 3, 1), ("op8_quality", "quality", 3, 1)])
def test_folds(spark, data_dir, name, label, parts, held):
    import zlib

    rows = QUERIES[name](spark, data_dir).collect()
    assert len(rows) == spark.read.parquet(f"{data_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    if label != "lang":
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_simhash_query(spark, data_dir):
    from test_simhash import groups, plain_fingerprint

    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    values = [plain_fingerprint(r["text"]) for r in docs]
    label, first = groups(values), {}
    for r, x in zip(docs, label):
        first[x] = min(r["doc_id"], first.get(x, r["doc_id"]))
    want = [(r["doc_id"], f"{v:016x}", first[x]) for r, v, x in zip(docs, values, label)]
    got = QUERIES["op6_simhash"](spark, data_dir).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got] == want
