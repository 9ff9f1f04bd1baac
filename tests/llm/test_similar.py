"""Near-duplicates by shingles, against all pairs compared in plain Python."""

import random

import numpy as np
from fixtures import DOC_SCHEMA, doc, odd_rows, prose
from pyspark.sql import functions as F

from millrace.llm import similar as s


def plain_set(text, shingle=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def alike(a, b, least=0.8):
    return a == b or len(a & b) / len(a | b) >= least


def kept_positions(texts):
    """Positions of the first text of each group that links connect."""
    sets, parent = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and alike(sets[i], sets[j])):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def test_groups_as_all_pairs_give(spark):
    rng = random.Random(11)
    texts = []
    for size in (6, 12, 40, 150, 400):
        for _ in range(6):
            base = prose(rng, size)
            texts += [base, base.upper()] + [edited(rng, base, rng.randrange(1, 2 + size // 25)) for _ in range(6)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOC_SCHEMA)
    assert {r["doc_id"] for r in s.one_of_each(docs).collect()} == kept_positions(texts)


def test_copies_of_one_base_that_are_less_alike_than_the_base(spark):
    """Edits of the base link with it, and hardly with each other; a smaller id than the base's is no obstacle."""
    rng = random.Random(12)
    base = prose(rng, 200)
    texts = [edited(rng, base, 4) for _ in range(60)] + [base] + [prose(rng, 200) for _ in range(20)]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOC_SCHEMA)
    assert {r["doc_id"] for r in s.one_of_each(docs).collect()} == kept_positions(texts)


def test_chains_across_groups(spark):
    """A text between two groups connects them, whichever hub it was compared with first."""
    rng = random.Random(13)
    words = prose(rng, 300).split()
    texts = []
    for step in range(8):
        words[10 * step:10 * step + 6] = [f"x{step}_{i}" for i in range(6)]
        texts += [" ".join(words)] + [edited(rng, " ".join(words), 1) for _ in range(4)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOC_SCHEMA)
    assert {r["doc_id"] for r in s.one_of_each(docs).collect()} == kept_positions(texts)


def test_odd_rows(spark):
    text = prose(random.Random(6), 80)
    rows = [doc(5, text), doc(3, text), doc(3, text), doc(8, prose(random.Random(7), 80)), *odd_rows()]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("near_key", F.lit("x")).withColumn("row", F.lit(1))
    kept = s.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [3, 8, None, 900, 903, 904, 905]))
    assert s.one_of_each(docs.where("doc_id < 0")).count() == 0


def joined(groups, pairs):
    """Groups as sets of groups that the pairs connect."""
    parts = [{g} for g in sorted(groups)]
    for a, b in pairs:
        hit = [p for p in parts if a in p or b in p]
        parts = [p for p in parts if p not in hit] + [set().union(*hit)]
    return sorted(map(sorted, parts))


def test_groups_of_a_shard_are_connected_as_all_pairs_do():
    rng = random.Random(14)
    for n in (2, 30, 120):
        bases = [rng.sample(range(10_000), 40) for _ in range(5)]
        rows = []
        for i in range(n):
            has = set(rng.choice(bases))
            has -= set(rng.sample(sorted(has), rng.randrange(7)))
            rows.append((i, rng.getrandbits(6), rng.randrange(12), np.array(sorted(has), "<u8").tobytes()))
        sets = [set(np.frombuffer(r[3], "<u8").tolist()) for r in rows]
        pairs = [(i, j) for i in range(n) for j in range(i) if rows[i][2] != rows[j][2]
                 and (rows[i][1] ^ rows[j][1]).bit_count() <= 4 and alike(sets[i], sets[j])]
        got = list(s.connecting(rows, 4, 0.8))
        groups = {r[2] for r in rows}
        assert all((max(p), min(p)) in pairs for p in got) and len(got) < len(groups)
        named = lambda links: joined(groups, [(rows[i][2], rows[j][2]) for i, j in links])
        assert named(got) == named(pairs)


def test_texts_apart_from_each_other_and_from_their_hub_give_no_pairs():
    """A family just below the similarity: all pairs are compared, none is given."""
    rng = random.Random(16)
    base = rng.sample(range(10_000), 100)
    rows = [(i, 0, i, np.array(sorted(set(base) - set(rng.sample(base, 25))), "<u8").tobytes()) for i in range(60)]
    assert list(s.connecting(rows, 4, 0.8)) == []


def test_hub_is_the_centre():
    base = random.Random(15).getrandbits(64)
    assert s.hub_of([base ^ 1 << i for i in range(20)] + [base]) == 20
