import random

import pytest
from fixtures import DOC_SCHEMA, doc, odd_rows, prose
from pyspark.sql import functions as F

from millrace.llm import linededup as ld


def common_lines(text, earlier, block_words):
    """Lines of a text in a block of enough words that one earlier text has too, by comparing all runs of lines."""
    mine, gone = [x.strip() for x in text.split("\n") if x.strip()], set()
    for other in earlier:
        theirs = [x.strip() for x in other.split("\n") if x.strip()]
        for a in range(len(mine)):
            for at in range(len(theirs)):
                n = 0
                while a + n < len(mine) and at + n < len(theirs) and mine[a + n] == theirs[at + n]:
                    n += 1
                if sum(len(x.split()) for x in mine[a:a + n]) >= block_words:
                    gone.update(range(a, a + n))
    return [x for i, x in enumerate(mine) if i not in gone]


def kept_texts(rows, block_words):
    """The lines that stay of each document, by all runs of lines of all earlier documents."""
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda k: (*k[:2], k[2]))
    return {(None if none else i, t): common_lines(t, [x[2] for x in order[:k]], block_words) for k, (none, i, t) in enumerate(order)}


def run(spark, rows, block_words=20):
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("line", F.lit("clash")).withColumn("old", F.col("text"))
    return docs, ld.without_repeated_lines(docs, block_words)


def test_matches_plain_python(spark):
    rng = random.Random(11)
    shared = [prose(rng, rng.choice([3, 8, 25])) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = [prose(rng, rng.choice([2, 12, 30])) for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(lines) + 1)
            k = rng.randrange(10)
            lines[at:at] = shared[k:k + rng.randrange(1, 3)]
        rows.append(doc(i, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    rows += [doc(50, rows[3][1]), doc(51, rows[3][1]), doc(None, rows[3][1]), *odd_rows()]
    docs, got = run(spark, rows)
    assert got.columns == [*docs.columns, "removed_lines"]
    want = kept_texts(rows, 20)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        if r["old"] is None:
            assert r["text"] is None
        else:
            assert [x.strip() for x in r["text"].split("\n") if x.strip()] == want[(r["doc_id"], r["old"])]
            assert r["removed_lines"] or r["text"] == r["old"]


def test_copies_lose_all_and_the_first_nothing(spark):
    text = "\n".join(prose(random.Random(i), 15) for i in range(4))
    _, got = run(spark, [doc(2, text), doc(1, text), doc(3, text + "\nnew line"), doc(2, text)])
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, text), (2, ""), (2, ""), (3, "new line")]


def test_moved_passage_goes_and_short_lines_stay(spark):
    rng = random.Random(9)
    a, b, tail = prose(rng, 60), prose(rng, 60), "All rights reserved."
    _, got = run(spark, [doc(1, f"{a}\n{b}\n{tail}"), doc(2, f"{b}\nmine\n{a}\n{tail}\nend"), doc(3, f"own\n{tail}")])
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert a not in texts[2] and b not in texts[2] and "mine" in texts[2] and "end" in texts[2]
    assert texts[3] == f"own\n{tail}"


def test_hot_line_and_empty_frame(spark):
    line = prose(random.Random(1), 30)
    _, got = run(spark, [doc(i, f"{line}\nown words of {i}") for i in range(500)])
    assert got.where("removed_lines = 0").count() == 1
    assert got.where(F.col("text").contains(line)).count() == 1
    assert run(spark, [])[1].count() == 0


def test_alignment():
    names = {c: c.encode().rjust(16, b"0") for c in "abcdefgx"}

    def align(mine, theirs, size=20):
        own, other = [names[c] for c in mine], [names[c] for c in theirs]
        held = {}
        for m, a, _ in ld._marks(other, [size] * len(other), 20):
            held.setdefault(m, a)
        return sorted(ld.aligned_blocks(own, list(ld._marks(own, [size] * len(own), 20)), other, held))

    assert align("abxcd", "abcd") == [(0, 2), (3, 5)]
    assert align("cdab", "abcd") == [(0, 2), (2, 4)]  # one of the two was moved
    assert align("aab", "ab") == [(0, 1), (1, 3)]  # the second one leads on
    assert align("xfg", "abc") == [] and align("", "a") == []
    assert align("abxcd", "abcd", 7) == [] and align("abcxd", "gabcd", 7) == [(0, 3)]


def test_increasing_run():
    assert ld._increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert ld._increasing([]) == []


def test_blocks_are_those_of_one_earlier_document(spark):
    rng = random.Random(4)
    shared = [prose(rng, rng.choice([1, 4, 8, 12, 25])) for _ in range(60)]
    rows = []
    for i in range(120):
        # No document repeats a line of its own.
        left, lines = shared[:], []
        while len(lines) < 12:
            at = rng.randrange(len(left))
            lines += left[at:at + rng.randrange(1, 5)]
            del left[at:at + 4]
            lines.append(prose(rng, 9) if rng.random() < 0.3 else "")
        rows.append(doc(i, "\n".join(lines)))
    _, got = run(spark, rows)
    lost = 0
    for r in got.collect():
        want = common_lines(r["old"], [x[1] for x in rows[:r["doc_id"]]], 20)
        assert [x for x in r["text"].split("\n") if x] == want
        assert r["removed_lines"] == len([x for x in r["old"].split("\n") if x]) - len(want)
        lost += r["removed_lines"]
    assert lost


def test_neighbours_of_the_later_document_alone_stay(spark):
    rng = random.Random(6)
    a, b, c = prose(rng, 8), prose(rng, 1), prose(rng, 12)
    held = prose(rng, 8) + "\n" + prose(rng, 12)
    x, y = held.split("\n")
    rows = [doc(1, f"{a}\nmine"), doc(2, f"{b}\nmy own"), doc(3, f"{c}\nour own"), doc(4, f"{a}\n{b}\n{c}"),
            doc(5, f"{a}\nits own\n{c}"), doc(6, f"{a}\n{c}"), doc(7, f"{x}\nso"), doc(8, held), doc(9, f"no\n{held}\n{a}")]
    _, got = run(spark, rows)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[4] == f"{a}\n{b}\n{c}" and texts[6] == f"{a}\n{c}" and texts[8] == held
    # The block is taken as a whole though its lines were first in different documents, and nothing beside it.
    assert texts[9] == f"no\n{a}"


@pytest.mark.parametrize("line,goes", [
    ("天地玄黄宇宙洪荒" * 20, True), ("ภาษาไทยไม่เว้นวรรค" * 10, True), ("天地玄黄宇宙洪荒", False), ("日月盈昃\u3000辰宿列张", False),
    ("\t".join(f"w{i}" for i in range(25)), True), ("\u00A0".join(f"é{i}" for i in range(25)), True),
    ("short" + " " * 40 + "words", False), ("kurz" + " " * 40 + "wörter", False), ("x" * 300, False),
])
def test_words_are_runs_or_letters_of_unparted_scripts(spark, line, goes):
    _, got = run(spark, [doc(1, f"{line}\nmine"), doc(2, f"own\n{line}")])
    assert {r["doc_id"]: r["text"] for r in got.collect()}[2] == ("own" if goes else f"own\n{line}")
