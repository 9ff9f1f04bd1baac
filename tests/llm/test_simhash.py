import random

from fixtures import DOC_SCHEMA, doc, odd_rows, prose
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm import simhash as s
from millrace.llm.components import components


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, radius=3):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def partition(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, set()).add(i)
    return sorted(map(sorted, out.values()))


def near_values(rng, n):
    values = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        v = rng.choice(values)
        for _ in range(rng.randrange(5)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    return list(dict.fromkeys(values))


def test_tree_links_as_all_pairs_do():
    values = near_values(random.Random(2), 60)
    labels = list(range(len(values)))
    for a, b in s.linked(values):
        labels[a] = b
    assert partition(labels) == partition(groups(values))


def test_dense_group_is_found_in_few_steps():
    values = [1 << i | 1 << j for i in range(64) for j in range(i)]
    assert sum(1 for _ in s.linked(values)) == len(values) - 1


def test_fingerprints(spark):
    rng = random.Random(3)
    rows = odd_rows() + [doc(i, prose(rng, n)) for i, n in enumerate([1, 2, 3, 4, 50])] + [doc(9, "A\x85B c d E")]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("fp", F.lit("clash"))
    got = s.fingerprints(docs).collect()
    want = sorted(((r[0], plain_fingerprint(r[1])) for r in rows), key=repr)
    assert sorted(((r[0], r[1] & (1 << 64) - 1) for r in got), key=repr) == want


def test_components_over_tables(spark):
    values = near_values(random.Random(4), 80)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = [(i, v) for i, v in enumerate(signed)] + [(1000 + i, v) for i, v in enumerate(signed[:20])] + [(None, signed[0]), (None, 77)]
    got = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    label = groups(values)
    smallest = {}
    for i, x in enumerate(label):
        smallest[x] = min(i, smallest.get(x, i))
    of = {v: smallest[x] for v, x in zip(signed, label)}
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["fp"] == 77 and 77 not in of else of[r["fp"]])


def test_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 999), (999, 1000), (5, 5)], "v long, u long")
    got = {r["v"]: r["label"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1000: 999}
    assert components(links.where("v < 0")).count() == 0


def test_one_of_each(spark):
    text = prose(random.Random(6), 80)
    near = text.replace("fox", "fox", 1) + ""
    rows = [doc(5, text), doc(3, near), doc(3, near), doc(8, prose(random.Random(7), 80)), *odd_rows()]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("fp", F.lit("x"))
    kept = s.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(repr, ids)) == sorted(map(repr, [3, 8, None, 900, 903, 904, 905]))
    assert s.one_of_each(docs.where("doc_id < 0")).count() == 0
