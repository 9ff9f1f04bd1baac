"""Rule edges on small hand-made frames."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions import finance as fin
from millrace.functions import logs as lg
from millrace.functions import notes as nt
from millrace.functions import text as tx
from millrace.functions.html import _slim, _split_at_newlines
from millrace.operators import batches, context, facts, logs, market, notes, pages, retrieval, sync
from millrace.plans import shapes
from millrace.sources import tables


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


# --- logs -------------------------------------------------------------------

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
LOGS = [
    (1, datetime(2024, 5, 1, 11, 45), "INFO", "System:Start", "j", "Started", None),
    (2, datetime(2024, 5, 1, 11, 50), "ERROR", "Backup:Cloud", "j", "100% lost", '{"code": "A_1"}'),
    (3, datetime(2024, 5, 1, 11, 55), "WARNING", "DB:Writer", "k", "slow", "not json"),
    (4, datetime(2024, 5, 1, 12, 0), "DEBUG", "Internal:Cache", "k", "hit", None),
]


@pytest.fixture
def log_frame(spark):
    return spark.createDataFrame(LOGS, "id long, log_ts timestamp, level string, tag string, job_id string, message string, payload_json string")


@pytest.mark.parametrize("text,want", [("30m", datetime(2024, 5, 1, 11, 30)), ("1h", datetime(2024, 5, 1, 11)), ("2d", datetime(2024, 4, 29, 12)),
                                       ("1w", datetime(2024, 4, 24, 12)), ("2024-05-01T10:00:00", datetime(2024, 5, 1, 10))])
def test_since_bound(text, want):
    assert lg.since_bound(text, NOW) == want.replace(tzinfo=timezone.utc)


def test_since_bound_refuses_other_text():
    assert lg.since_bound("", NOW) is None
    with pytest.raises(ValueError):
        lg.since_bound("yesterday", NOW)


def test_log_conditions(log_frame, rows):
    ids = lambda df: [r[0] for r in rows(df, "id")]
    assert ids(logs.recent(log_frame, level="warning")) == [2, 3]
    assert ids(logs.recent(log_frame, level="odd")) == []
    assert ids(logs.by_tag(log_frame, "Backup:Cloud")) == [2]
    assert ids(logs.by_tag(log_frame, "Backup:Cloud", strict=True)) == []
    assert ids(logs.by_tag(log_frame, "Backup:", strict=True)) == [2]
    assert ids(logs.search(log_frame, "0% L")) == [2]
    assert ids(logs.search(log_frame, "0_ L")) == []
    assert ids(logs.search(log_frame, "a_1", in_payload=True)) == [2]
    assert ids(logs.recent(log_frame, since=datetime(2024, 5, 1, 11, 55))) == [3, 4]
    assert logs.show(log_frame).filter("id = 3").first().payload is None or logs.show(log_frame).filter("id = 3").first().payload == {}


def test_stats_and_context(log_frame, spark):
    total = logs.stats_total(log_frame, F.lit("2024-05-01 12:00:00").cast("timestamp")).first()
    assert (total.total, total.errors_last_hour) == (4, 1)
    events = log_frame.filter("id IN (2, 4)").select(F.col("id").alias("event_id"), "log_ts")
    early = spark.createDataFrame([(9, datetime(2024, 5, 1)), (8, None)], "event_id long, log_ts timestamp")
    got = logs.error_context(log_frame, events.unionByName(early), 3)
    assert sorted((r.event_id, r.id) for r in got.collect()) == [(2, 1), (2, 2), (4, 2), (4, 3), (4, 4)]


def test_context_in_one_hot_hour(spark):
    from random import Random

    rnd = Random(2)
    moments = [datetime(2024, 5, 1, 12, 0, rnd.randrange(30)) for _ in range(3000)]
    log = spark.createDataFrame([(i, t, f"said {i}") for i, t in enumerate(moments)], "id long, log_ts timestamp, message string").repartition(6)
    asked = [(i, moments[i]) for i in range(0, 3000, 97)] + [(5000, datetime(2024, 5, 1, 12, 0, 40)), (5001, datetime(2024, 1, 1))]
    got = logs.error_context(log, spark.createDataFrame(asked, "event_id long, log_ts timestamp"), 4)
    assert got.columns == ["event_id", "id", "log_ts", "message"]
    want = [(e, i) for e, at in asked for _, i in sorted((t, i) for i, t in enumerate(moments) if t <= at)[-4:]]
    assert sorted((r.event_id, r.id) for r in got.collect()) == sorted(want)


def test_limits_are_the_callers(spark):
    many = spark.range(6001).select(
        F.col("id"), F.lit("2024-01-01").cast("timestamp").alias("log_ts"), F.lit("ERROR").alias("level"), F.lit("A").alias("tag"),
        F.lit("j").alias("job_id"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("payload_json"))
    assert logs.errors(many).count() == 6001 and logs.errors(many, 5500).count() == 5500
    assert logs.by_job(many, "j").count() == 6001
    assert shapes.top_per_key(many, ["job_id"], [F.col("id").asc()], 2500, "r").filter("r = id + 1").count() == 2500


def test_missing_fields_lose_no_line(spark, rows):
    at = datetime(2024, 1, 1)
    lines = spark.createDataFrame(
        [(1, at, "INFO", "T", "j", "a"), (2, at, None, None, "j", "b"), (3, at, "INFO", "T", None, None), (4, at, "INFO", None, None, "c")],
        "id long, log_ts timestamp, level string, tag string, job_id string, message string")
    assert [r[0] for r in rows(logs.tail_budget(lines, 1000), "id")] == [1, 2, 3, 4]
    said = spark.createDataFrame(
        [("s", 1, "x", 5, None, True), ("s", 2, "y", None, 3, None), (None, 3, "z", 4, None, False)],
        "session_id string, id long, content string, char_count long, attachment_char_count long, has_screenshot boolean")
    assert rows(context.context(said, 100), "id", "cost") == [(1, 5), (2, 3), (3, 4)]
    assert rows(context.session_cost(said, 100), "session_id", "cost") == sorted([("s", 8), (None, 4)], key=repr)
    assert rows(context.evict(said, 100), "id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("limit", [1, 5, 9, 10, 11, 20, 31, 32, 100])
def test_tail_budget_matches_a_text_tail(spark, rows, limit):
    lines = ["first", "second one", "x", "the last"]
    df = spark.createDataFrame([(i, datetime(2024, 1, 1), "j", t) for i, t in enumerate(lines)], "id long, log_ts timestamp, job_id string, t string")
    kept = [r[1] for r in sorted(rows(logs.tail_budget(df, limit, F.col("t")), "id", "line"))]
    full = "\n".join(lines)
    tail = full[-limit:]
    if len(full) > limit and "\n" in tail:
        tail = tail[tail.find("\n") + 1:]
    elif len(full) <= limit:
        tail = full
    assert "\n".join(kept) == tail or (tail == "" and kept == [lines[-1][-limit:]])


# --- facts ------------------------------------------------------------------

BP = "concept string, label string, depth int, is_abstract boolean, is_total boolean, position int"
FACT = "ticker string, concept string, period_start date, period_end date, fiscal_period string, fiscal_year int, numeric_value double, unit string, period_type string"


def fact(start, end, fp, value, fy=2023, concept="us-gaap:A", kind="duration"):
    return ("T", concept, start, end, fp, fy, float(value), "USD", kind)


@pytest.fixture
def blueprint(spark):
    return spark.createDataFrame([("us-gaap:A", "A", 1, False, True, 0), ("us-gaap:EarningsPerShareBasic", "EPS", 1, False, False, 1), ("us-gaap:H", "H", 0, True, False, 2)], BP)


def test_quarter_label(spark):
    label = lambda d, q: one(spark, d, "date", lambda c: fin.quarter_label(c, F.lit(q)))
    assert label(date(2024, 1, 27), "Q4") == "2023-Q4"
    assert label(date(2024, 1, 27), "Q1") == "2024-Q1"
    assert label(date(2023, 12, 31), "Q4") == "2023-Q4"


def test_income_with_long_quarter_restatement_and_derived_q4(spark, rows, blueprint):
    y = date(2023, 1, 1)
    data = [
        fact(y, date(2023, 4, 8), "Q1", 10),                      # 14 weeks
        fact(y, date(2023, 4, 8), "Q1", 11, fy=2024),             # restated: wins
        fact(date(2023, 4, 9), date(2023, 7, 1), "Q2", 20),
        fact(y, date(2023, 7, 1), "Q2", 31),                      # half year: not a quarter
        fact(y, date(2023, 9, 30), "Q3", 60),                     # nine months
        fact(y, date(2023, 12, 31), "FY", 100),
        fact(y, date(2023, 12, 31), "FY", 4, concept="us-gaap:EarningsPerShareBasic"),
        fact(y, date(2023, 9, 30), "Q3", 3, concept="us-gaap:EarningsPerShareBasic"),
        fact(y, date(2023, 4, 8), "Q1", 5, concept="us-gaap:H"),
    ]
    got = rows(facts.income(spark.createDataFrame(data, FACT), blueprint, 8), "concept", "quarter", "numeric_value", "label", "concept_order")
    assert got == [("us-gaap:A", "2023-Q1", 11.0, "A", 0), ("us-gaap:A", "2023-Q2", 20.0, "A", 0), ("us-gaap:A", "2023-Q4", 40.0, "A", 0)]


def test_existing_q4_is_kept(spark, rows, blueprint):
    y = date(2023, 1, 1)
    data = [fact(date(2023, 10, 1), date(2023, 12, 31), "Q4", 7), fact(y, date(2023, 9, 30), "Q3", 60), fact(y, date(2023, 12, 31), "FY", 100)]
    assert rows(facts.income(spark.createDataFrame(data, FACT), blueprint, 8), "quarter", "numeric_value") == [("2023-Q4", 7.0)]


def test_cashflow_gap(spark, rows, blueprint):
    y = date(2023, 1, 1)
    data = [fact(y, date(2023, 3, 31), "Q1", 10), fact(y, date(2023, 9, 30), "Q3", 60), fact(y, date(2023, 12, 31), "FY", 100)]
    got = rows(facts.cashflow(spark.createDataFrame(data, FACT), blueprint, 8), "quarter", "numeric_value")
    assert got == [("2023-Q1", 10.0), ("2023-Q4", 40.0)]  # no Q2, so no Q3 either


def test_balance_prefers_year_end(spark, rows, blueprint):
    d = date(2023, 12, 31)
    data = [fact(None, d, "Q4", 1, kind="instant"), fact(None, d, "FY", 2, kind="instant")]
    assert rows(facts.balance(spark.createDataFrame(data, FACT), blueprint, 8), "quarter", "fiscal_period", "numeric_value") == [("2023-Q4", "Q4", 2.0)]


@pytest.mark.parametrize("value,unit,want", [
    (1.5, "USD per share", "$1.50"), (0.001, "USD/shares", "$0.0010"), (2.5e9, "shares", "2.50B"), (1234.0, "shares", "1,234"),
    (1.25e9, "TWD", "NT$1.2B"), (-3.4e6, "USD", "$-3.4M"), (12.0, "XYZ", "XYZ12"), (5.0, "", "$5"), (None, "USD", "—"), (float("nan"), "USD", "—")])
def test_format_value(spark, value, unit, want):
    assert spark.createDataFrame([(value, unit)], "v double, u string").select(fin.format_value(F.col("v"), F.col("u"))).first()[0] == want


def test_short_names_and_query_prefix(spark, rows):
    df = spark.createDataFrame([("T", "income", "us-gaap:A", "2023-Q1", 1)], "ticker string, statement_type string, concept string, quarter string, concept_order int")
    assert facts.query_facts(df, "t", "INCOME", "us-gaap_A").count() == 1


# --- notes ------------------------------------------------------------------

def test_tidy_rows_are_rows_times_periods(spark):
    wide = spark.createDataFrame([("c", None, 1.5, "2"), ("d", True, None, "3")], "concept string, abstract boolean, `2023-12-31 (FY)` double, odd string")
    tidy = notes.to_tidy(wide)
    assert tidy.count() == 4
    got = {(r.concept, r.period_raw): (r.value, r.period_end_date, r.period_type) for r in tidy.collect()}
    assert got[("c", "2023-12-31 (FY)")] == ("1.5", "2023-12-31", "FY")
    assert got[("d", "2023-12-31 (FY)")][0] == ""
    assert got[("d", "odd")] == ("3", "1970-01-01", "UNKNOWN")
    filled = notes.fill_meta(tidy.withColumn("level", F.lit("2.0")))
    assert {(r.abstract, r.level, r.balance) for r in filled.collect()} == {("", 2, ""), ("True", 2, "")}


@pytest.mark.parametrize("text,want", [("2500000000", "2.5B"), ("-1200000", "-1.2M"), ("1500", "1.5K"), ("3", "3.00"), ("plain words over twenty chars", "plain words over twe")])
def test_short_number(spark, text, want):
    assert one(spark, text, "string", nt.short_number) == want


@pytest.mark.parametrize("text,want", [("2023-01", True), ("2023-13", False), ("1900-05", False), ("23-01", False), (None, False)])
def test_valid_month(spark, text, want):
    assert one(spark, text, "string", nt.valid_month) is want


@pytest.mark.parametrize("end", [date(2023, m, 15) for m in (1, 3, 6, 9, 10, 12)])
@pytest.mark.parametrize("fye", [3, 6, 9, 12])
def test_fiscal_quarter(spark, end, fye):
    months = [(fye + i) % 12 + 1 for i in range(12)]
    want = months.index(end.month) // 3 + 1
    assert one(spark, end, "date", lambda c: nt.fiscal_quarter(F.month(c), F.lit(fye))) == want
    assert one(spark, end, "date", lambda c: nt.fiscal_year(c, F.lit(fye))) == end.year + (end.month > fye)


def test_series_refuses_a_bad_month(spark):
    with pytest.raises(ValueError):
        notes.series(spark.range(1), "T", "c", "2023-1")


def test_catalog_takes_the_newest_value(spark, rows):
    data = [("T", "a", 1, "c", "m", "old", "ax", date(2022, 1, 1), "5", False, "1"), ("T", "a", 1, "c", "m", "new", "ax", date(2023, 1, 1), "7000", False, "2"),
            ("T", "a", 1, "c", "m", "none", "ax", date(2024, 1, 1), "", False, "3")]
    df = spark.createDataFrame(data, "ticker string, accession_no string, note_number int, concept string, dimension_member_label string, label string, dimension_axis string, period_end_date date, value string, abstract boolean, detail_id string")
    assert rows(notes.concept_catalog(df), "label", "sample_value", "period_count") == [("new", "7.0K", 2)]


# --- retrieval --------------------------------------------------------------

def test_knn_paths_agree_with_ties_and_copies(spark, rows):
    import random

    rnd = random.Random(2)
    docs = [(i, [rnd.random() for _ in range(4)]) for i in range(60)] + [(100 + i, [0.5] * 4) for i in range(60)]
    asks = [(q, [rnd.random() for _ in range(4)]) for q in range(9)] + [(9, [0.5] * 4)]
    d, q = spark.createDataFrame(docs, "id long, vec array<float>"), spark.createDataFrame(asks, "query_id long, query_vec array<float>")
    small = rows(retrieval.knn(d, q, 7), "query_id", "id", "distance", "rank")
    large = rows(retrieval.knn(d, q, 7, max_queries=4), "query_id", "id", "distance", "rank")
    assert small == large and len(small) == 70
    assert [r[1] for r in small if r[0] == 9] == list(range(100, 107))
    cosine = retrieval.knn(d, q, 3, metric="cosine")
    assert cosine.filter("query_id = 9 AND rank = 1").first().distance == pytest.approx(0.0, abs=1e-5)


def test_task_functions_need_no_installed_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    blob = tmp_path / "f.pkl"
    blob.write_bytes(cloudpickle.dumps((_slim, _split_at_newlines, retrieval._nearest)))
    code = f"import pickle; s, c, n = pickle.load(open({str(blob)!r}, 'rb')); print(s('<p>x', 9, frozenset()), c('a', 2))"
    done = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "<p>x</p> ['a']", done.stderr


def test_prefilter_and_postfilter(spark):
    d = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b"), (3, [2.0], "a")], "id long, vec array<float>, c string")
    q = spark.createDataFrame([(1, [0.9])], "query_id long, query_vec array<float>")
    assert retrieval.knn(d, q, 2, where=F.col("c") == "a").count() == 2
    assert retrieval.knn(d, q, 2, where=F.col("c") == "a", prefilter=False).count() == 1


def test_bm25_against_plain_python(spark, tmp_path):
    import math
    import re

    texts = {1: "red fox and red hen", 2: "red hen", 3: "blue fox", 4: "", 5: "Red, FOX! red-hen hen hen"}
    docs = spark.createDataFrame(list(texts.items()), "id long, t string")
    ask = spark.createDataFrame([(7, "Hen red?"), (8, "fox absent"), (9, "fox")], "query_id long, query_text string")
    words = {i: [w for w in re.split(r"[^a-z]+", t.lower()) if w] for i, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)

    def score(i, terms):
        total = 0.0
        for t in terms:
            tf, df = words[i].count(t), sum(t in w for w in words.values())
            if not tf:
                return None
            idf = math.log((n - df + 0.5) / (df + 0.5))
            idf = idf if idf > 0 else 1e-6
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
        return total

    got = {(r.query_id, r.id): r.score for r in retrieval.bm25(docs, ["t"], ask, 10).collect()}
    want = {(q, i): s for q, terms in ((7, ("hen", "red")), (8, ("fox", "absent")), (9, ("fox",))) for i in words if (s := score(i, terms)) is not None}
    assert got == pytest.approx(want)
    retrieval.write_index(docs, ["t"], str(tmp_path / "index"))
    stored = retrieval.bm25_index(spark.read.parquet(str(tmp_path / "index")), ask, 10)
    assert {(r.query_id, r.id): r.score for r in stored.collect()} == pytest.approx(want)


def test_fused_score_is_bounded(spark):
    v = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, id long, rank long")
    top = retrieval.rrf(v, v, limit=5)
    assert [r.id for r in top.orderBy("rank").collect()] == [5, 6]
    assert top.agg(F.max("fusion_score")).first()[0] <= round(1 / 61, 5)


def test_validate_vectors(spark, rows):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, float("inf")]), (4, None)], "id long, embedding array<float>")
    good, bad = retrieval.validate_vectors(df, 2)
    assert rows(good, "id") == [(1,), (4,)] and rows(bad, "id") == [(2,), (3,)]


def test_toc_and_page_range(spark, rows):
    pages_ = [("d", n, "Contents" if n in (1, 4, 5, 6, 9) else "text") for n in range(1, 11)] + [("e", 3, "a....1 b....2 c....3 d....4")]
    df = spark.createDataFrame(pages_, "doc string, page_number int, content string")
    assert rows(retrieval.toc_block(df, "doc", "page_number", "content"), "doc", "page_number") == [("d", 4), ("d", 5), ("d", 6), ("e", 3)]
    assert rows(retrieval.page_range(df.filter("doc = 'd'"), "2-3,x,7-,9"), "page_number") == [(2,), (3,), (9,)]


# --- batches and context ----------------------------------------------------

def test_swaps(spark, rows):
    details = [(i, "b", f"a{i}", i < 3, i if i < 3 else None) for i in range(5)] + [(9, "c", "a9", True, 0)]
    d = spark.createDataFrame(details, "detail_id long, batch_id string, article_id string, is_top10 boolean, top10_rank long")
    ops = [("b", 1, 0, 2, None), ("b", 2, 1, None, "a4"), ("b", 3, 7, 0, None), ("b", 4, 0, None, "zz"), ("b", 5, 2, None, "a1"), ("b", 6, 0, None, "a4")]
    s = spark.createDataFrame(ops, "batch_id string, seq int, index_top10 int, target_index int, target_article string")
    got = rows(batches.apply_swaps(d, s).filter("is_top10"), "batch_id", "top10_rank", "article_id")
    top, pool = ["a0", "a1", "a2"], {"a3", "a4"}
    for _, _, i, j, new in ops:
        if not 0 <= i < 3:
            continue
        if j is not None and 0 <= j < 3:
            top[i], top[j] = top[j], top[i]
        elif new in pool:
            pool.add(top[i])
            top[i] = new
            pool.discard(new)
    assert got == [("b", i, a) for i, a in enumerate(top)] + [("c", 0, "a9")]


def test_pack_keeps_one_and_stops_at_the_first_overflow(spark, rows):
    data = [("b", "1", "t", "x" * 500), ("b", "2", "t", "x" * 300), ("b", "3", "t", "x"), ("c", "4", "t", "x" * 900)]
    df = spark.createDataFrame(data, "batch_id string, id string, title string, conclusion string")
    assert rows(batches.pack(df, 600), "batch_id", "id", "target") == [("b", "1", 1), ("c", "4", 1)]
    import json

    sizes = {r.id: r.size for r in batches.pack(df, 10_000).collect()}
    assert sizes["1"] == len(json.dumps({"title": "t", "conclusion": "x" * 500, "ulid": "1"}))


def test_rollup_branches(spark, rows):
    data = [("done", "PUBLISHED_ARCHIVE"), ("done", "SKIPPED"), ("bad", "FAILED"), ("bad", "SKIPPED"), ("part", "FAILED"), ("part", "PENDING"), ("new", "PENDING"), ("skip", "SKIPPED")]
    df = spark.createDataFrame(data, "batch_id string, publish_status string")
    assert dict(rows(batches.rollup(df), "batch_id", "status")) == {"done": "COMPLETED", "bad": "FAILED", "part": "PARTIAL", "new": "PENDING", "skip": "FAILED"}


def test_context_counts_only_the_newest_screenshot(spark, rows):
    data = [("s", 1, "a", 10, 500, True), ("s", 2, "b", 10, 0, False), ("s", 3, "c", 10, 500, True)]
    df = spark.createDataFrame(data, "session_id string, id long, content string, char_count long, attachment_char_count long, has_screenshot boolean")
    assert rows(context.effective_cost(df), "id", "cost") == [(1, 10), (2, 10), (3, 510)]
    assert rows(context.context(df, 525), "id") == [(2,), (3,)]
    assert context.session_cost(df, 5).first().cost == 0


def test_evict_lone_large_item(spark, rows):
    df = spark.createDataFrame([("s", 1, "x" * 5000, 5000, 0)], "session_id string, id long, content string, char_count long, attachment_char_count long")
    assert rows(context.evict(df, 3000), "char_count") == [(2000,)]
    assert rows(context.evict(df, 3000, keep_last=False)) == []


# --- pages ------------------------------------------------------------------

WALL = "<html><header>Subscribe to</header><p>Subscribe to us</p><!-- cancel anytime --><p>per&nbsp;month only 5 per month</p><script>'unlimited access'</script></html>"


def test_paywall_verdicts(spark, rows):
    data = [(1, WALL), (2, "<p>premium access</p>"), (3, "<p>log in to read, a paywall</p>"), (4, "<p>premium content. membership required</p>"), (5, "<p>paywall</p>")]
    got = rows(pages.paywall(spark.createDataFrame(data, "page_id long, html string")), "page_id", "blocker_type", F.array_join("indicators", ","))
    assert got == [(1, "paywall", "per month,subscribe to"), (2, "paywall", "premium access"), (3, "gatekeeper", "paywall,log in to read"),
                   (4, "paywall", "premium content,membership required"), (5, None, "")]


def test_blocked_and_media(spark):
    long = "x" * 1200
    assert one(spark, long, "string", pages.is_blocked) is False
    assert one(spark, long + "Access Denied", "string", pages.is_blocked) is True
    assert one(spark, None, "string", pages.is_blocked) is True
    player = '<iframe width="1" src="https://www.youtube.com/embed/x"></iframe>'
    assert one(spark, player + "<p>few words</p>", "string", pages.is_media_only) is True
    assert one(spark, player + f"<p>{long}</p>", "string", pages.is_media_only) is False
    assert one(spark, "<p>few</p>", "string", pages.is_media_only) is False
    assert one(spark, "<p> a <b> b </b></p><p>&amp;c</p>", "string", pages.paragraph_chars) == 5


def test_site_rules(spark, rows):
    html = ('<a data-trackable="heading-link" href="/content/1">x</a><a href="/content/a-b">y</a><a class="o-teaser__heading-link" href="/other">z</a>'
            '<div class="o-teaser__heading"><a href="/content/9">w</a></div><a href="/content/7">no</a>')
    df = spark.createDataFrame([(1, "http://x.example/", html)], "page_id long, url string, html string")
    got = [r[1][len("https://www."):].split("/", 1)[1] for r in rows(pages.extract_links(df, pages.SITES["FT"]), "page_id", "link")]
    assert got == ["content/1", "content/9", "content/a-b"]


def test_slim_html():
    text = '<div id="a" onclick="x"><script>s</script><!-- c --><p class="k">A &amp; B<br></p><div data-ai-badge="true">9</div></div>'
    assert _slim(text, 1000, frozenset({"id", "class"})) == '<div id="a"><p class="k">A &amp; B<br/></p></div>'
    assert _slim("<p>" + "x" * 50, 10, frozenset()) == "<p>xxxxxxx... [TRUNCATED]"


def test_chunks_cover_the_whole_text(spark, rows):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, "")], "id long, t string")
    assert rows(pages.chunk(df, "t", 4, 1), "id", "chunk", "chunk_text") == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (1, 3, "j"), (2, 0, "abc")]
    assert rows(pages.chunk(df, "t", 4, 4), "id", "chunk_text") == [(1, "abcd"), (2, "abc")]
    assert _split_at_newlines("aa\nbb cc\n dd", 6) == ["aa", "bb cc", "dd"]


@pytest.mark.parametrize("text,want", [
    ("api_key=abc rest", "api_key=[REDACTED] rest"), ("Password: x1 y", "Password: [REDACTED] y"), ("token=Bearer abc z", "token=[REDACTED] z"),
    ("keyboard input", "keyboard input"), ("private-key = a", "private-key = [REDACTED]")])
def test_redact(spark, text, want):
    assert one(spark, text, "string", tx.redact) == want


@pytest.mark.parametrize("text,want", [
    ('```json\n{"a": 1,}\n```', '{"a":1}'), ('{"a": [1, 2, ]}', '{"a":[1,2]}'), ("nothing", "{}"), ("", "{}"), (None, "{}")])
def test_extract_json(spark, text, want):
    assert one(spark, text, "string", tx.extract_json) == want


def test_bullets_urls_and_fields(spark, rows):
    assert one(spark, ["it notes that  rain fell", "", None, "Sun"], "array<string>", tx.clean_bullets) == ["Rain fell", "Sun"]
    assert one(spark, "HTTPS://A.example/B/?q=1#f", "string", tx.normalize_url) == "https://a.example/b"
    assert one(spark, "a“b” – c&nbsp;", "string", tx.ascii_punct) == 'a"b" - c'
    polls = spark.createDataFrame([("q" * 301, ["o" * 101, "o"], "e")], "q string, options array<string>, exp string")
    row = pages.truncate_fields(polls).first()
    assert (len(row.q), [len(o) for o in row.options], row.exp) == (300, [100, 1], "e")


# --- sync -------------------------------------------------------------------

def test_row_hash_treats_empty_values_alike(spark):
    df = spark.createDataFrame([(1, " a ", 0, False), (1, "a", None, None)], "id long, t string, n long, b boolean")
    assert df.select(sync.row_hash(df)).distinct().count() == 1


def test_composite_keys_with_odd_characters(spark, rows):
    odd = [("a|b", "c", "h1"), ("a", "b|c", "h2"), ('q"\\\n', "日本", "h3"), (None, "x", "h4")]
    kind = "a string, b string, content_hash string, updated_at int"
    local = spark.createDataFrame([(*r, 1) for r in odd], kind)
    cloud = spark.createDataFrame([(*r, 1) for r in odd[1:]], kind)
    assert rows(sync.to_push(local, cloud, ["a", "b"]), "a", "b") == [("a|b", "c")]
    assert {r[0]: r[1] for r in sync.classify(local, cloud, ["a", "b"]).groupBy("class").count().collect()} == {"op_only": 1, "identical": 3}


def test_merge_is_idempotent_and_newest_wins(spark, rows):
    kind = "id long, v string, updated_at int"
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], kind)
    source = spark.createDataFrame([(2, "new", 3), (2, "old", 2), (3, "c", 1)], kind)
    once = sync.merge(target, source, ["id"])
    assert rows(once) == [(1, "a", 1), (2, "new", 3), (3, "c", 1)]
    assert rows(sync.merge(once, source, ["id"])) == rows(once)


@pytest.mark.parametrize("strategy", sync.STRATEGIES)
def test_apply_twice_is_apply_once(spark, rows, strategy):
    kind = "id long, v string, content_hash string, updated_at int"
    local = spark.createDataFrame([(1, "l", "x", 2), (2, "l", "y", 1), (3, "l", "z", 1), (5, "l", "", 4)], kind)
    cloud = spark.createDataFrame([(1, "c", "a", 1), (2, "c", "b", 5), (4, "c", "d", 1), (5, "c", "", 4)], kind)
    once = sync.apply_sync(local, cloud, ["id"], strategy).drop("action")
    assert rows(sync.apply_sync(once, cloud, ["id"], strategy).drop("action")) == rows(once)


@pytest.mark.parametrize("conflicts,cloud_only,rows_,want", [(0, 0, 10, ("operational_wins", 0.95)), (0, 1, 10, ("newest_overall_wins", 0.9)), (1, 0, 99, ("newest_overall_wins", 0.85)),
                                                             (10, 0, 90, ("newest_overall_wins", 0.6)), (30, 0, 70, ("abort", 0.9))])
def test_recommend(spark, conflicts, cloud_only, rows_, want):
    counts = spark.createDataFrame([("conflict", conflicts, 0, 0), ("cloud_only", cloud_only, 0, 0), ("identical", rows_, 0, 0)], "class string, n long, op_newer long, cloud_newer long")
    got = sync.recommend(counts).first()
    assert (got.strategy, got.confidence) == want


@pytest.mark.parametrize("local,cloud,want", [({"a": 0}, {"a": 0}, "skip"), ({"a": 0}, {"a": 3}, "pull_only"), ({"a": 3}, {"a": 0}, "push_only"), ({"a": 3}, {"a": 3}, "skip"), ({"a": 3}, {"a": 2}, "bidirectional")])
def test_startup_action(spark, local, cloud, want):
    frame = lambda d: spark.createDataFrame(list(d.items()), "table_name string, n_rows long")
    assert sync.startup_action(frame(local), frame(cloud)).first().action == want


def test_backfill_fills_only_empty(spark, rows):
    df = spark.createDataFrame([(1, "a", ""), (2, "b", "keep"), (3, "c", None)], "id long, t string, content_hash string")
    filled = sync.backfill_hash(df, ["id", "t"])
    assert sync.count_backfill(df).first().to_fill == 2 and sync.count_backfill(filled).first().to_fill == 0
    assert filled.filter("id = 2").first().content_hash == "keep"
    assert rows(sync.backfill_hash(filled, ["id", "t"])) == rows(filled)


def test_sanitize_and_letters(spark):
    df = spark.createDataFrame([(1, True, float("nan"), bytearray(b"x"))], "id long, b boolean, d double, raw binary")
    clean = sync.sanitize(df).first()
    assert (clean.b, clean.d) == (1, None)
    letter = sync.dead_letters(df.drop("d"), "t", ["id", "b"], F.lit("why")).first()
    assert (letter.row_id, letter.row_data) == ("1|true", '{"id":1,"b":true}')
    assert sync.dead_letters(df.drop("d"), "t", [], F.lit("why")).first().row_id == "1"


# --- market -----------------------------------------------------------------

@pytest.mark.parametrize("text,want", [("$1,234.5", 1234.5), ("(2.5M)", -2_500_000.0), ("€ 3k", 3000.0), ("1.2B", 1.2e9), ("n/a", 0.0), (None, 0.0), ("", 0.0)])
def test_clean_value(spark, text, want):
    assert one(spark, text, "string", fin.clean_value) == pytest.approx(want)


@pytest.mark.parametrize("text,want", [("2024-02-03", date(2024, 2, 3)), ("2/3/2024", date(2024, 2, 3)), ("13/2/2024", date(2024, 2, 13)), ("Feb 3, 2024", date(2024, 2, 3)),
                                       ("February 3, 2024", date(2024, 2, 3)), ("2024-02-03T04:05:06", date(2024, 2, 3)), ("soon", None)])
def test_parse_date(spark, text, want):
    assert one(spark, text, "string", fin.parse_date) == want


@pytest.mark.parametrize("e,c,want", [(1000.0, 1.0, 1000.0), (1e6, 1.0, 1e6), (1.0, 1000.0, 1.0), (5.0, 4.0, 4.0), (0.0, 7.0, 7.0), (None, 7.0, 7.0)])
def test_rescale(spark, e, c, want):
    assert spark.createDataFrame([(e, c)], "e double, c double").select(fin.rescale(F.col("e"), F.col("c"))).first()[0] == want


def test_ttm_moving_and_pe(spark, rows):
    data = [("T", date(2023, m, 1), v) for m, v in ((3, 1), (6, 2), (9, 3), (12, 4))] + [("T", date(2024, 3, 1), 5)]
    df = spark.createDataFrame(data, "ticker string, period_end_date date, earnings long")
    assert [r.ttm for r in market.ttm(df, "earnings").orderBy("period_end_date").collect()] == [None, None, None, 10, 14]
    moved = market.moving(df, "earnings", 3, on="period_end_date").orderBy("period_end_date").collect()
    assert [r.moving_avg for r in moved] == [None, None, 2.0, 3.0, 4.0] and moved[2].std_dev == 1.0
    assert spark.range(1).select(market.pe(F.lit(2.0), F.lit(3.0), F.lit(0.0))).first()[0] is None


def test_align_dates_uses_each_once(spark, rows):
    ask = [("T", i, d) for i, d in enumerate([date(2023, 3, 31), date(2023, 3, 15), date(2023, 6, 30), date(2023, 9, 30)])]
    known = [("T", date(2023, 3, 25)), ("T", date(2023, 3, 28)), ("T", date(2023, 4, 1)), ("T", date(2023, 5, 30))]
    got = rows(market.align_dates(spark.createDataFrame(ask, "ticker string, position long, date date"), spark.createDataFrame(known, "ticker string, date date")), "position", "aligned")
    assert got == [(0, date(2023, 3, 28)), (1, date(2023, 4, 1)), (2, date(2023, 5, 30))]


def test_events(spark):
    markets = '[{"outcomes":["Yes","No"],"outcomePrices":"[\\"0.25\\",\\"x\\"]"},{"outcomes":["A"],"outcomePrices":"[\\"1\\"]"}]'
    df = spark.createDataFrame([("Rain", "r", ["Weather"], 5.0, markets), ("Snow", "s", ["Sport"], 9.0, "[]")], "title string, slug string, tags array<string>, volume double, markets string")
    got = market.event_outcomes(df).collect()
    assert [(r.title, r.probability_context) for r in got] == [("Snow", "N/A"), ("Rain", "Yes: 25.0% | A: 100.0%")]
    assert market.event_outcomes(df, topic="weather").count() == 1
    assert market.event_outcomes(df, categories=["sport"]).first().title == "Snow"


# --- tables -----------------------------------------------------------------

def test_scans_fit_the_operators(spark, tmp_path):
    from millrace.operators import jobs
    from millrace.sources.schemas import REGISTRY

    for name in ("logs", "broadcast_details", "scraped_articles", "stock_financials"):
        if name in REGISTRY:
            spark.createDataFrame([], REGISTRY[name].schema).write.parquet(f"{tmp_path}/{name}")
    seen = tables.scan(spark, str(tmp_path), "logs")
    assert "log_ts" in seen.columns and "timestamp" not in seen.columns
    assert logs.recent(seen, level="INFO").count() == logs.tail_budget(seen, 10).count() == logs.job_issues(seen).count() == 0
    assert retrieval.backlog(tables.scan(spark, str(tmp_path), "scraped_articles")).count() == 0
    details = tables.scan(spark, str(tmp_path), "broadcast_details")
    assert batches.batch_progress(details).count() == 0 if hasattr(batches, "batch_progress") else details.count() == 0
    assert jobs is not None


def test_nearest_by_full_distances_of_equal_length(spark, rows):
    docs = spark.createDataFrame([(1, [0.100002, 0.0]), (2, [0.100001, 0.0]), (3, [0.1]), (4, [0.0, float("nan")]), (5, None), (6, [0.0, 0.0, 0.0])],
                                 "id long, vec array<double>")
    asked = spark.createDataFrame([(7, [0.0, 0.0]), (8, [0.1]), (9, None)], "query_id long, query_vec array<double>")
    assert rows(retrieval.knn(docs, asked, 1), "query_id", "id") == [(7, 2), (8, 3)]
    plan = retrieval.knn(docs.repartition(3), asked, 1, max_queries=1)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan
    assert rows(retrieval.knn(docs, asked, 1, max_queries=1), "query_id", "id") == [(7, 2), (8, 3)]


def test_greedy_fill_walks_all_items(spark, rows):
    items = spark.createDataFrame([("k", i, 1 if i > 80 else 100) for i in range(90)] + [("k", 90, None), (None, 1, 3)], "k string, i long, c long")
    got = rows(retrieval.greedy_fill(items, ["k"], [F.col("i").asc()], "i", "c", 9), "k", "position", "i", "used")
    assert got == sorted([("k", n, 81 + n, 9) for n in range(9)] + [(None, 0, 1, 3)], key=repr)


def test_index_follows_changes(spark, tmp_path, rows):
    texts = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "old words")], "id long, t string")
    retrieval.write_index(texts, ["t"], f"{tmp_path}/i")
    changed = spark.createDataFrame([(3, "red red fox"), (4, "fox")], "id long, t string")
    index = retrieval.update_index(spark.read.parquet(f"{tmp_path}/i"), changed, ["t"], spark.createDataFrame([(2,)], "id long"))
    now = spark.createDataFrame([(1, "red fox"), (3, "red red fox"), (4, "fox")], "id long, t string")
    ask = spark.createDataFrame([(1, "red"), (2, "fox")], "query_id long, query_text string")
    assert rows(retrieval.bm25_index(index, ask, 5)) == rows(retrieval.bm25(now, ["t"], ask, 5))


def test_locked_batches_do_not_change(spark, rows):
    d = spark.createDataFrame([(i, b, f"a{i}", True, i % 2) for i, b in enumerate("ppccff")], "detail_id long, batch_id string, article_id string, is_top10 boolean, top10_rank long")
    s = spark.createDataFrame([(b, 1, 0, 1, None) for b in "pcf"], "batch_id string, seq int, index_top10 int, target_index int, target_article string")
    states = spark.createDataFrame([("p", "PENDING"), ("c", "COMPLETED"), ("f", "FAILED")], "batch_id string, status string")
    got = rows(batches.apply_swaps(d, s, states), "batch_id", "detail_id", "top10_rank")
    assert got == [("c", 2, 0), ("c", 3, 1), ("f", 4, 1), ("f", 5, 0), ("p", 0, 1), ("p", 1, 0)]


def test_merge_without_update_time(spark, rows):
    old = spark.createDataFrame([(1, "a", 1)], "id long, v string, created_at int")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (2, "d", 1)], "id long, v string, created_at int")
    assert rows(sync.merge(old, new, ["id"]), "id", "v") == [(1, "c"), (2, "d")]
    bare = sync.merge(old.drop("created_at"), new.drop("created_at"), ["id"])
    assert rows(bare, "id", "v") == rows(sync.merge(old.drop("created_at"), new.drop("created_at").orderBy(F.desc("v")), ["id"]), "id", "v")


def test_concepts_as_rows(spark, rows):
    tidy = spark.createDataFrame([("t", "d", "a", 1, c) for c in ("x", "x", "y", None, "")], "ticker string, detail_table_name string, accession_no string, note_number int, concept string")
    assert rows(notes.registry_concepts(tidy), "concept", "row_count") == [("x", 2), ("y", 1)]
    assert notes.registry_concepts(tidy).first().registry_id == notes.registry(tidy).first().registry_id


@pytest.mark.parametrize("sql", [
    "WITH t AS (SELECT 1 AS x) INSERT INTO y SELECT x FROM t", "with t as (select 1 as x) insert overwrite y select x from t",
])
def test_reads_that_write_are_refused(spark, sql):
    with pytest.raises(ValueError):
        tables.read_sql(spark, sql)


def test_reads_may_name_writes(spark):
    assert tables.read_sql(spark, "SELECT 'InsertIntoStatement' AS s, 'DROP TABLE x' AS d").count() == 1


def test_read_sql_is_read_only(spark):
    df = spark.createDataFrame([(1,)], "x long")
    assert tables.read_sql(spark, "with t as (select x from {d}) select * from t where x = :v", {"v": 1}, d=df).count() == 1
    for bad in ("drop table t", "insert into t values (1)", ""):
        with pytest.raises(ValueError):
            tables.read_sql(spark, bad)


def test_scan_export_and_restore(spark, tmp_path):
    from millrace.sources.schemas import DURABLE, REGISTRY

    for name in DURABLE:
        spark.createDataFrame([], REGISTRY[name].schema).write.parquet(str(tmp_path / "src" / name))
    row = ("i", "u", "Red fox", "", "A red hen", "{}", "PENDING", "", None, None)
    spark.createDataFrame([row], REGISTRY["scraped_articles"].schema).write.mode("overwrite").parquet(str(tmp_path / "src" / "scraped_articles"))
    assert tables.restore(tables.durable_frames(spark, str(tmp_path / "src")), str(tmp_path / "dst")) == list(DURABLE)
    back = tables.scan(spark, str(tmp_path / "dst"), "scraped_articles").first()
    assert back.conclusion is None and back.title == "Red fox"
    assert spark.read.parquet(str(tmp_path / "dst" / "article_postings")).filter("token = 'red'").first().tf == 2
    tables.export(spark.createDataFrame([(1, ["a"])], "x long, y array<string>"), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().y == '["a"]'


def test_schema_diff_and_evolve(spark, rows):
    from pyspark.sql import types as T

    have = T.StructType.fromDDL("a int, b string, c decimal(10,2)")
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("c", T.DecimalType(12, 3)), T.StructField("d", T.StringType())])
    assert rows(sync.schema_diff(spark, have, want), "column", "issue") == [("a", "type"), ("b", "extra"), ("d", "missing")]
    df = spark.createDataFrame([("7", "x"), ("bad", "y")], "a string, b string")
    out = sync.evolve(df, T.StructType.fromDDL("a int, d string"), {"d": "new"}, {"a": lambda _: F.lit(-1)})
    assert rows(out) == [(-1, "new"), (7, "new")]
