import hashlib
import random

from millrace.llm import chat as c

SCHEMA = "conv_id long, turn long, seq long, kind string, role string, text string"


def formatted(spark, events):
    rows = c.format_conversations(spark.createDataFrame(events, SCHEMA)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["turn_no"]):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def said(rows):
    return [t for r in rows for t in c.read_turns(r["formatted"])]


def test_escapes_are_reversible():
    rng = random.Random(4)
    parts = ["\\", "#", "### assistant:", "</turn>", "\n", "a", "é", ":", "\\\\", "<", "turn>", "### ", "日本"]
    for _ in range(500):
        turns = [("".join(rng.choices(parts, k=rng.randrange(5))), "".join(rng.choices(parts, k=rng.randrange(9)))) for _ in range(3)]
        whole = "".join(c.rendered(*t)[0] for t in turns)
        assert c.read_turns(whole) == turns
        for role, text in turns:
            out, a, b = c.rendered(role, text)
            assert c.unescaped(out[a:b]) == text


def test_fold(spark):
    events = [
        (1, 0, 0, c.MESSAGE, "user", "hi"), (1, 1, 1, c.MESSAGE, "assistant", ""), (1, 1, 2, c.DELTA, "assistant", "Hel"),
        (1, 1, 3, c.DELTA, "assistant", "lo"), (1, 2, 4, c.MESSAGE, "user", "more"), (1, 3, 5, c.MESSAGE, "assistant", "old"),
        (1, 0, 6, c.EDIT, "user", "hi there"), (1, 1, 7, c.REGENERATE, "assistant", ""), (1, 1, 8, c.DELTA, "assistant", "Again"),
        (1, 2, 9, c.MESSAGE, "user", "thanks"),
        (2, 0, 0, c.DELTA, "user", "lone delta"), (2, 1, 1, "what", None, None),
    ]
    random.Random(1).shuffle(events)
    got = formatted(spark, events)
    assert said(got[1]) == [("user", "hi there"), ("assistant", "Again"), ("user", "thanks")]
    assert said(got[2]) == [("user", "lone delta"), ("", "")]


def test_starts_and_mask(spark):
    rows = formatted(spark, [(1, 0, 0, c.MESSAGE, "user", "# é"), (1, 1, 1, c.MESSAGE, "assistant", "a\\b")])[1]
    whole = "".join(r["formatted"] for r in rows)
    assert [r["start"] for r in rows] == [0, len(rows[0]["formatted"])]
    assert rows[0]["loss_start"] == rows[0]["loss_end"]
    at = rows[1]["start"]
    assert c.unescaped(whole[at + rows[1]["loss_start"]:at + rows[1]["loss_end"]]) == "a\\b"


def test_nulls_ties_and_repeated_rows(spark):
    events = [
        (None, 0, 0, c.MESSAGE, "user", "x"), (None, None, None, c.MESSAGE, None, None), (3, 0, 0, c.MESSAGE, "user", "same"),
        (3, 0, 0, c.MESSAGE, "user", "same"), (3, 0, 0, c.MESSAGE, "assistant", "tie"), (4, 0, 0, None, "user", "y" * 100_000),
    ]
    got = formatted(spark, events)
    assert said(got[None]) == [("", ""), ("user", "x")]
    assert said(got[3]) == [("assistant", "tie"), ("user", "same"), ("user", "same")]
    assert said(got[4]) == [("user", "y" * 100_000)]


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", formatted string, start string")
    assert c.digest(c.format_conversations(none)).count() == 0
    one = spark.createDataFrame([(1, 0, 0, c.MESSAGE, "user", "x", "clash", "clash")], SCHEMA + ", formatted string, start string")
    assert c.format_conversations(one).first()["start"] == 0


def test_query_against_plain_python(spark, data_dir):
    from millrace.llm.queries import QUERIES

    convs = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in sorted(spark.read.parquet(f"{data_dir}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in QUERIES["op3_chat_format"](spark, data_dir).collect()}
    assert got.keys() == convs.keys()
    for conv_id, turns in convs.items():
        r, loss = got[conv_id], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(c.rendered(*t)[0]) for t in turns)
