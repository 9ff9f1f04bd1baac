"""Difference by digests against the full outer join, with composite keys."""

import random
from datetime import datetime, timedelta

from millrace.operators import digests as D
from millrace.operators import sync as S

SCHEMA = "region string, num long, content_hash string, updated_at timestamp, payload string"
KEYS = ["region", "num"]


def row(rnd, region, num):
    return (region, num, rnd.choice(["", None, f"h{num}"]), datetime(2024, 1, 1) + timedelta(minutes=num), "p" * 20)


def test_classes_and_unread_ranges(spark, tmp_path):
    rnd = random.Random(6)
    local = {(r, n): row(rnd, r, n) for r in ("a", "b", None, "") for n in [None, *range(600)] if n is not None or r == "a" for n in [n if n is not None else 0]}
    local[None, None] = (None, None, "x", None, "p")
    cloud = dict(local)
    for n in range(100, 130):  # changes stand together, as they do in time
        old = cloud["b", n]
        cloud["b", n] = (*old[:2], rnd.choice(["other", old[2]]), rnd.choice([old[3], datetime(2025, 1, 1)]), "q")
    del cloud["b", 131], local["b", 133]
    cloud["b", 5000] = ("b", 5000, None, None, "new")
    sides = [spark.createDataFrame(list(x.values()), SCHEMA) for x in (local, cloud)]
    splits = D.key_splits(sides[0], KEYS)
    assert 200 < len(splits) < 256
    paths = [str(tmp_path / x) for x in ("local", "cloud")]
    for df, path in zip(sides, paths):
        D.write_side(df, KEYS, splits, path)
    want = sorted(map(tuple, S.classify(*sides, KEYS).filter("class <> 'identical'").select(*KEYS, "class").collect()), key=repr)
    got = D.difference(spark, *paths, KEYS)
    assert sorted(map(tuple, got.select(*KEYS, "class").collect()), key=repr) == want and len(want) > 10
    whole = {r["class"]: r["n"] for r in S.summary(S.classify(*sides, KEYS)).collect()}
    assert {r["class"]: r["n"] for r in D.summary(spark, *paths, KEYS).collect()} == whole
    leaves, same = D.unequal_leaves(spark, *paths)
    assert 0 < len(leaves) < 12 and same > 2200
    # Files of the other ranges are not among those read.
    read = {f.split("_leaf=")[1].split("/")[0] for f in got.inputFiles() if "_leaf=" in f}
    kept = spark.read.parquet(f"{paths[0]}/rows").where(D.F.col("_leaf").isin(*leaves))
    assert kept.count() < 0.06 * len(local) and read
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_leaf" in plan.replace("[isnotnull", "[") or "_leaf" in plan.split("PartitionFilters")[1][:80]


def test_equal_sides_and_empty_ones(spark, tmp_path):
    rnd = random.Random(7)
    df = spark.createDataFrame([row(rnd, "a", n) for n in range(50)], SCHEMA)
    splits = D.key_splits(df, KEYS)
    for name, side in (("x", df), ("y", df.orderBy("updated_at", ascending=False)), ("z", df.limit(0))):
        D.write_side(side, KEYS, splits, str(tmp_path / name))
    x, y, z = (str(tmp_path / n) for n in "xyz")
    assert D.unequal_leaves(spark, x, y) == ([], 50) and D.difference(spark, x, y, KEYS).count() == 0
    assert {(r["class"], r["n"]) for r in D.summary(spark, x, z, KEYS).collect()} == {("op_only", 50)}
    assert D.key_splits(df.limit(0), KEYS) == []


def test_ranges_are_found_by_halves(spark):
    keys = [(r, n) for r in (None, "", "a", "b") for n in (None, -1, *range(40))]
    keys.sort(key=lambda k: [(v is not None, "" if v is None else v) for v in k])
    place = {k: i for i, k in enumerate(keys)}
    df = spark.createDataFrame(keys, "region string, num long")
    for splits in ([], keys[:1], keys[3:5], keys[::7], keys[1::2], keys):
        marked = D._leafed(df, KEYS, splits)
        assert marked.columns == [*KEYS, "_leaf"]
        for r in marked.collect():
            assert r["_leaf"] == sum(place[s] <= place[r["region"], r["num"]] for s in splits)
        # Compiled, and one comparison for each halving.
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and plan.count(" <= ") == len(splits).bit_length()
