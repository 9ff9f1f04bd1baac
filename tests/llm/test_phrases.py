import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOC_SCHEMA, doc, odd_rows

from millrace.llm import phrases as ph


def plain(rows, least=10, cover=50, most=2000):
    """The same by counting all runs of one, two and three words."""
    f, n, out = Counter(), Counter(), []
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    listed = {}
    for key, a in f.items():
        lang, *w = key
        if len(w) < 2 or a < least:
            continue
        longer = [m for x, m in f.items() if len(x) == len(key) + 1 == 4 and x[0] == lang and m >= least and (list(x[1:3]) == w or list(x[2:]) == w)] if len(w) == 2 else []
        if any(100 * m >= cover * a for m in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        listed.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    for lang, found in listed.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(spark, rows, **more):
    df = ph.collocations(spark.createDataFrame([(*r, "clash") for r in rows], DOC_SCHEMA + ", word string"), **more)
    return sorted(tuple(r) for r in df.collect())


def texts(rng, n, vocabulary=30):
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "é", "日本", "New", "York", "x" * 300]
    passages = [" ".join(rng.choice(words) + str(i) for i in range(rng.randrange(2, 40))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts.append(rng.choice([*passages, "new york city", "New  York\tCity"]) if rng.random() < 0.5
                         else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))))
            parts.append(rng.choice([" ", ". ", ",", "\n", "!?", "\r\n", " ", "\x0b"]))
        out.append(doc(i, "".join(parts), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("volume", [ph.VOLUME, 2000])
def test_matches_plain_python(spark, volume):
    rows = texts(random.Random(1), 500) + odd_rows() + [doc(9000 + i, "the very same line of text", "en") for i in range(300)]
    want = plain(rows)
    assert len(want) > 100 and any(r[2].count(" ") == 1 for r in want)
    assert mined(spark, rows, volume=volume) == want


def test_few_ranks_other_limits_and_empty(spark):
    rows = texts(random.Random(2), 200)
    assert mined(spark, rows, least=3, cover=80, most=7) == plain(rows, 3, 80, 7)
    assert mined(spark, []) == [] and mined(spark, [doc(1, None), doc(2, "a b c")]) == []


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    import xxhash

    rows = texts(random.Random(3), 120)
    real, seeds = ph._lexicon, []

    def first_collides(source, seed, *more):
        seeds.append(seed)
        found = real(source, seed, *more)
        return found.unionByName(found.where("kind = 0").limit(1).withColumn("word", found["word"].substr(1, 0))) if seed == 0 else found

    monkeypatch.setattr(ph, "_lexicon", first_collides)
    assert mined(spark, rows, least=3) == plain(rows, 3) and seeds == [0, 1] and xxhash


def test_paths_are_compacted(spark):
    edges = spark.createDataFrame([(1, 2, 3, 20), (2, 3, 4, 20), (3, 4, 5, 20), (4, 5, 6, 12), (7, 8, 9, 11)], "a long, b long, c long, n long")
    pairs = spark.createDataFrame([(1, 2, 25), (2, 3, 20), (3, 4, 20), (4, 5, 20), (5, 6, 12), (7, 8, 11), (8, 9, 11)], "a long, b long, n long")
    assert sorted((r["words"], r["n"]) for r in ph.paths(edges, pairs).collect()) == [([1, 2, 3, 4, 5], 20), ([4, 5, 6], 12), ([7, 8, 9], 11)]


def test_walks_stop_at_pieces_and_texts():
    words, at, done = ph.walks(pa.array(["a b", "c, d", None, "", "A\tB;", ",", "e"]).slice(0))
    said = [words[int(i)].as_py().decode() for i in at]
    assert said == ["a", "b", "c", "d", "a", "b", "e"] and done.tolist() == [False, True, True, True, False, True, True]
    words, at, done = ph.walks(pa.array(["x", "ab", "cd", "y"]).slice(1, 2))
    assert [words[int(i)].as_py() for i in at] == [b"ab", b"cd"] and done.all()


def test_counts_beyond_the_packed_room():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 5, 300) for _ in range(3))
    one = np.ones(300, np.int64)
    small, large = ph.counted(a, b, c, one, 5), ph.counted(a, b, c, one, 1 << 22)
    assert all((x == y).all() for x, y in zip(small, large)) and small[3].sum() == 300
