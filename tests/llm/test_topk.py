import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import topk as t


def brute(rows, k, every=50):
    vectors = []
    for i, e in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            vectors.append((i, [math.floor(256 * x) for x in e]))
    out = []
    for q, a in vectors:
        if q is None or q % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b)]
        scored.sort(key=lambda s: (s[0], s[1] is not None, s[1] or 0))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=50, **more):
    vectors = t.whole_numbers(spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, v string"))
    got = t.top_k(vectors, F.col("vec_id") % every == 0, k, **more)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("block", [2048, 7])
def test_matches_brute_force(spark, block):
    rng = random.Random(3)
    rows = [(i, [single(rng.gauss(0, 0.3)) for _ in range(9)]) for i in range(600)]
    rows += [(i, rows[i % 3][1]) for i in range(600, 700)]
    rows += [(1000, None), (1050, []), (1051, []), (1100, [1.0, None] + [0.0] * 7), (1150, [math.nan] * 9), (1200, [math.inf] * 9),
             (1250, [1.0, 2.0]), (None, rows[0][1]), (1300, [0.0] * 9)]
    assert run(spark, rows, block=block) == brute(rows, 5)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(120)]
    assert run(spark, rows) == brute(rows, 5)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0])]) == []
    assert run(spark, [(50, [1.0]), (1, [2.0])]) == [(50, 1, 1, 256 * 512)]
    assert run(spark, [(1, [2.0])]) == []


def test_wide_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [single(rng.uniform(-1, 1) * 4e6) for _ in range(4)]) for i in range(60)]
    assert run(spark, rows, every=10) == brute(rows, 5, every=10)


def test_all_scores_negative(spark):
    rows = [(0, [1.0, 1.0])] + [(i, [-1.0 - i / 7, -i / 5]) for i in range(1, 40)]
    assert run(spark, rows) == brute([(i, [single(x) for x in e]) for i, e in rows], 5)


def test_finite_components_of_any_size_stay(spark):
    rng = random.Random(8)
    rows = [(i, [single(rng.uniform(-1, 1)) for _ in range(4)]) for i in range(40)]
    # Small numbers in one list of dimensions, large ones in the other.
    rows += [(i, [single(rng.uniform(-1, 1)) for _ in range(3)] + [2.0 ** 33 + 2.0 ** 11 * i]) for i in range(40, 60)]
    rows += [(60, [2.0 ** 24, 0.0, 0.0, 0.0]), (61, [0.0, -(2.0 ** 22), 0.0, 0.0]), (62, [0.0, 0.0, 2.0 ** 100, 0.0]), (70, [0.0, 1.0, 0.0, 0.0])]
    few = [r for r in rows if r[0] < 40 or r[0] in (60, 61, 70)]
    assert run(spark, few, every=10) == brute(few, 5, every=10)
    apart = [(i, e[:2] + [0.0] + e[3:] if i != 62 else e) for i, e in rows if i not in (40, 50)]
    small = [(i, e) for i, e in apart if i in (0, 10, 60, 61, 62, 70) or 40 <= i < 60]
    assert run(spark, small, every=10) == brute(small, 5, every=10)


@pytest.mark.parametrize("sign", [1, -1])
def test_scores_beyond_a_long_are_an_error(spark, sign):
    with pytest.raises(Exception, match="beyond a long"):
        run(spark, [(50, [2.0 ** 40]), (1, [sign * 2.0 ** 40])])
    assert run(spark, [(50, [2.0 ** 40]), (1, [sign * 2.0 ** -8])]) == [(50, 1, 1, sign * 2 ** 48)]
