import hashlib
import itertools
import random

import numpy as np
import pytest

from millrace.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, part int, row string"


def plain(rows, scale=1024, parts=4, entries=256, rounds=4):
    """The same in whole numbers of Python, every part against every entry."""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v], lab) for i, v, lab, *_ in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for size in sorted({len(v) for _, v, _ in kept}):
        own = [k for k in kept if len(k[1]) == size]
        cuts = [size * p // parts for p in range(parts + 1)]
        first = sorted(own, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:entries]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
        books = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            book = [v[a:b] for _, v, _ in first]
            for _ in range(rounds):
                at = {}
                for _, v, _ in own:
                    at.setdefault(near(v[a:b], book)[1], []).append(v[a:b])
                for j, held in at.items():
                    book[j] = [sum(c) // len(held) for c in zip(*held)]
            books.append((a, b, book))
        digest = hashlib.sha256(",".join(str(x) for _, _, book in books for e in book for x in e).encode()).hexdigest()
        for i, v, lab in own:
            best = [near(v[a:b], book) for a, b, book in books]
            out.append((i, lab, [j for _, j in best], sum(d for d, _ in best), digest))
    return sorted(out, key=repr)


def coded(spark, rows, **more):
    found = codes.compress(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA), **more)
    return sorted(((r["vec_id"], r["label"], r["codes"], r["error"], r["books_sha256"]) for r in found.collect()), key=repr)


def some(rng, n, dims, centres=6, spread=0.05):
    mids = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [rng.gauss(x, spread) for x in mids[rng.randrange(centres)]], rng.choice([None, 0, 1])) for i in range(n)]


@pytest.mark.parametrize("block", [128, 5])
def test_matches_plain_python(spark, block):
    rng = random.Random(2)
    rows = some(rng, 700, 12)
    rows += [rows[5], rows[5], (None, rows[6][1], 1), (5, rows[9][1], 1), *[(900 + i, rows[0][1], 0) for i in range(300)]]
    rows += [(2000, None, 1), (2001, [0.1, None, *[0.0] * 10], 1), (2002, [float("nan")] * 12, 1), (2003, [float("-inf")] * 12, None)]
    assert coded(spark, rows, entries=40, block=block) == plain(rows, entries=40)


def test_few_rows_other_lengths_and_large_numbers(spark):
    rng = random.Random(4)
    rows = some(rng, 30, 7) + [(100 + i, [], 1) for i in range(3)] + [(200 + i, [rng.uniform(-1, 1)], None) for i in range(4)]
    assert coded(spark, rows) == plain(rows)
    for size in (1e5, 1e6):
        big = [(i, [rng.uniform(-size, size) for _ in range(4)], 0) for i in range(20)]
        assert coded(spark, big, entries=5) == plain(big, entries=5)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_shortlists_hold_the_nearest():
    rng = np.random.default_rng(1)
    spared = 0
    for _ in range(200):
        entries = rng.integers(-900, 900, (50, 3))
        points = rng.integers(-900, 900, 3) + rng.integers(0, 120, (20, 3))
        few = codes.shortlist(points.min(axis=0), points.max(axis=0), entries)
        far = ((points[:, None, :] - entries) ** 2).sum(axis=2)
        assert set(far.argmin(axis=1)) <= set(few)
        code, d = codes.nearest(points, entries[few])
        assert (few[code] == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
        spared += 50 - len(few)
    assert spared > 0.5 * 200 * 50


def test_far_numbers_stay_exact():
    points, entries = np.array([[3e17, 1.0]]), np.array([[3e17, 2.0], [3e17 - 64, 1.0]])
    assert [int(x[0]) for x in codes.nearest(points, entries)] == [0, 1]


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 1), (1, 4)])
def test_curve_goes_from_neighbour_to_neighbour(dims, bits):
    cells = np.array(list(itertools.product(range(2**bits), repeat=dims)), np.uint64)
    place = codes.hilbert(cells, bits)
    assert sorted(place) == list(range(2 ** (bits * dims)))
    steps = np.abs(np.diff(cells[np.argsort(place)].astype(np.int64), axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_query(spark, data_dir):
    from millrace.llm.queries import QUERIES

    table = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").collect()]
    want = plain(table)
    total = {}
    for _, lab, _, error, _ in want:
        total[lab] = total.get(lab, 0) + error
    got = [tuple(r) for r in QUERIES["op13_vector_codes"](spark, data_dir).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got) == sorted((i, "".join(f"{c:02x}" for c in code), e, total[lab], sha) for i, lab, code, e, sha in want)
