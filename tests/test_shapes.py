"""Plan shapes against brute force, with one key that holds a third or more of all rows."""

import random
from bisect import bisect_right
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.plans.shapes import (
    asof_join, budget_prefix, first_per_key, islands, ordered_ranks, ordered_sums, sliding_count, small_side, top_per_key,
)


def hot_rows(n=900, seed=1):
    rnd = random.Random(seed)
    return [("hot" if i % 2 else f"k{rnd.randrange(40)}", i, rnd.choice([0, 0, 1, 2, 5, 30])) for i in range(n)]


@pytest.mark.parametrize("budget", [0, 7, 60, 10_000])
@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("keep_first", [True, False])
def test_budget_prefix(spark, rows, budget, desc, keep_first):
    data = hot_rows()
    df = spark.createDataFrame(data, "k string, pos long, cost long")
    got = rows(budget_prefix(df, ["k"], [("pos", desc)], "cost", budget, keep_first=keep_first, salts=4), "k", "pos")
    want = []
    for key in {r[0] for r in data}:
        used, first = 0, True
        for _, pos, cost in sorted((r for r in data if r[0] == key), key=lambda r: -r[1] if desc else r[1]):
            if used + cost > budget and not (keep_first and first and cost):
                break
            if used + cost > budget:
                want.append((key, pos))
                used += cost
                first = False
                continue
            used += cost
            first = first and cost == 0
            want.append((key, pos))
    # A first row that is kept although too large ends the walk for rows that cost something.
    if not keep_first:
        assert got == sorted(want, key=repr)
    else:
        costly = {(k, p) for k, p, c in data if c}
        assert [r for r in got if r in costly] == sorted((r for r in want if r in costly), key=repr)


def test_budget_prefix_ties_break_on_second_column(spark, rows):
    df = spark.createDataFrame([("a", 1, "x", 3), ("a", 1, "y", 3), ("a", 0, "z", 3)], "k string, p long, t string, cost long")
    got = rows(budget_prefix(df, ["k"], [("p", True), ("t", False)], "cost", 6), "t")
    assert got == [("x",), ("y",)]


def test_top_and_first_per_key(spark, rows):
    df = spark.createDataFrame(hot_rows(), "k string, pos long, cost long")
    top = rows(top_per_key(df, ["k"], [F.col("pos").desc()], 3, "r").filter("k = 'hot'"), "pos", "r")
    assert top == [(895, 3), (897, 2), (899, 1)]
    assert first_per_key(df, ["k"], [F.col("pos").asc()]).count() == df.select("k").distinct().count()


def test_rank_filter_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = top_per_key(df, ["k"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_asof_join(spark, rows):
    rnd = random.Random(3)
    day = lambda: date(2020, 1, 1) + timedelta(days=rnd.randrange(700))
    left = [("hot" if i % 3 else f"k{i % 7}", day(), i) for i in range(400)]
    right = sorted({("hot" if i % 2 else f"k{i % 5}", day()) for i in range(60)})
    right = [(k, d, n) for n, (k, d) in enumerate(right)]
    got = rows(asof_join(
        spark.createDataFrame(left, "k string, d date, i long"), spark.createDataFrame(right, "k string, e date, v long"),
        "k", "d", "e", ["v"]), "i", "v")
    known = defaultdict(list)
    for k, d, v in right:
        known[k].append((d, v))
    want = []
    for k, d, i in left:
        at = bisect_right([x[0] for x in known[k]], d)
        want.append((i, known[k][at - 1][1] if at else None))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("blocks", [1, 4])
def test_sliding_count(spark, rows, blocks):
    rnd = random.Random(5)
    data = [("hot" if i % 3 else "cold", rnd.randrange(5000)) for i in range(600)]
    df = spark.createDataFrame(data, "k string, t long")
    got = rows(sliding_count(df, "t", 100, ["k"], blocks=blocks), "k", "t", "in_window")
    want = {(k, t, sum(1 for k2, t2 in data if k2 == k and t - 100 <= t2 <= t)) for k, t in data}
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("block", [2, 3, 8, 4096])
def test_islands(spark, rows, block):
    rnd = random.Random(7)
    numbers = {k: sorted(rnd.sample(range(120), 80)) for k in ("a", "b")}
    df = spark.createDataFrame([(k, n) for k, ns in numbers.items() for n in ns], "k string, n long")
    want = []
    for k, ns in numbers.items():
        start = ns[0]
        for a, b in zip(ns, ns[1:] + [10_000]):
            if b != a + 1:
                want.append((k, start, a, a - start + 1))
                start = b
    assert rows(islands(df, ["k"], "n", block=block), "k", "first", "last", "length") == sorted(want, key=repr)


def test_small_side_hints_only_small_frames(spark):
    def hinted(df):
        return "Broadcast" in spark.range(10).join(df, "id")._jdf.queryExecution().logical().toString() or \
            "broadcast" in df._jdf.queryExecution().logical().toString()

    assert hinted(small_side(spark.range(5), 10))
    assert not hinted(small_side(spark.range(11), 10))


def test_budget_prefix_keeps_rows_without_an_order(spark, rows):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 0), (1, None, 0), (1, 3, 50), (1, 4, 0)], "k long, pos long, cost long")
    assert rows(budget_prefix(df, ["k"], [("pos", False)], "cost", 20), "pos") == [(1,), (2,), (None,)]
    assert rows(budget_prefix(df.filter("pos IS NULL OR pos <> 1"), ["k"], [("pos", True)], "cost", 20), "pos") == [(4,)]
    late = spark.createDataFrame([(1, 4, 5), (1, None, 0), (1, None, 0), (1, 3, 1)], "k long, pos long, cost long")
    assert rows(budget_prefix(late, ["k"], [("pos", True)], "cost", 20), "pos") == [(3,), (4,), (None,), (None,)]
    # The cut itself has no order.
    cut = spark.createDataFrame([(1, None, "b", 50), (1, None, "a", 0), (1, None, "c", 0), (1, 2, "a", 0)], "k long, pos long, t string, cost long")
    assert rows(budget_prefix(cut, ["k"], [("pos", False), ("t", False)], "cost", 20), "pos", "t") == [(None, "a")]


def test_ordered_ranks_and_sums(spark, rows):
    rnd = random.Random(3)
    data = [(None if k == "k3" else k, rnd.choice([None, 1, 2, 3]), i, rnd.choice([None, 0, 2, 5])) for k, i, _ in hot_rows(2000)]
    df = spark.createDataFrame(data, "k string, pos long, id long, w long").repartition(7)
    order = [F.col("pos").desc(), F.col("id").asc()]
    ranks, sums = {}, {}
    for key in {r[0] for r in data}:
        total = 0
        for n, r in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2])), 1):
            total += r[3] or 0
            ranks[r[2]], sums[r[2]] = n, total
    assert dict(rows(ordered_ranks(df, ["k"], order), "id", "rank")) == ranks
    assert dict(rows(ordered_sums(df, ["k"], order, "w", "s"), "id", "s")) == sums
    assert sorted(r[0] for r in rows(ordered_ranks(df, [], order, "n"), "n")) == list(range(1, 2001))
    assert ordered_ranks(df.limit(0), ["k"], order).count() == 0 == ordered_sums(df.limit(0), [], order, "w", "s").count()
