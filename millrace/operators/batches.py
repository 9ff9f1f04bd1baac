"""Articles in publishing batches: contents, progress, roll-up, ranking, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import normalize_url, strip_query
from millrace.operators.jobs import with_keys
from millrace.operators.sync import merge
from millrace.plans.shapes import budget_prefix, first_per_key

# Statuses that are still to publish, and sizes of curation.
OPEN_STATUSES = ("PENDING", "FAILED", "TRANSLATING", "PUBLISHED_BRIEFING")
MIN_SUMMARY = 600
TOP = 10


def upsert_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """One article for each URL; the first id and the time of the first visit stay."""
    return merge(old, new, ["url"], keep=["id", "scraped_at"], tie=["id"])


def new_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct links that are not known yet."""
    return links.select("url").distinct().join(known.select("url").distinct(), "url", "left_anti")


def link_counts(links: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct links, and how many of them were known and new."""
    marks = links.select("url").distinct().join(
        known.select("url").distinct().withColumn("_known", F.lit(True)), "url", "left")
    return marks.agg(
        F.count(F.lit(1)).alias("links"), F.count("_known").alias("known"),
        F.count_if(F.col("_known").isNull()).alias("new"))


def _titled(articles: DataFrame) -> DataFrame:
    return articles.filter(F.coalesce("title", F.lit("")) != "")


def batch_ids(details: DataFrame, articles: DataFrame, status: str | None = None) -> DataFrame:
    """Articles of each batch that have a title."""
    if status:
        details = details.filter(F.col("publish_status") == status)
    ids = _titled(articles).select(F.col("id").alias("article_id"))
    return details.select("batch_id", "article_id").join(ids, "article_id")


def _contents(details: DataFrame, articles: DataFrame) -> DataFrame:
    texts = articles.select(F.col("id").alias("article_id"), "url", "title", "conclusion", "summary")
    return details.join(texts, "article_id")


def _rank_order() -> list[Column]:
    return [F.col("is_top10").desc(), F.col("top10_rank").asc_nulls_first(), F.col("detail_id").asc()]


def batch_articles(details: DataFrame, articles: DataFrame, top_only: bool = False) -> DataFrame:
    """Contents of the batches, the top ten first and in rank order."""
    if top_only:
        details = details.filter("is_top10")
    return _contents(details, articles).orderBy("batch_id", *_rank_order())


def to_publish(details: DataFrame, articles: DataFrame) -> DataFrame:
    """What is still to be published, in the same order."""
    left = details.filter(F.col("publish_status").isin(*OPEN_STATUSES))
    return _contents(left, articles).orderBy("batch_id", *_rank_order())


def progress(details: DataFrame) -> DataFrame:
    return details.groupBy("batch_id", "publish_status").agg(F.count(F.lit(1)).alias("n"))


def rollup(details: DataFrame) -> DataFrame:
    """Status of each batch from the statuses of its articles."""
    s = F.col("publish_status")
    counts = details.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "PUBLISHED_ARCHIVE").alias("published"),
        F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "SKIPPED").alias("skipped"))
    total, published, failed, skipped = (F.col(c) for c in ("total", "published", "failed", "skipped"))
    status = (
        F.when((published + skipped == total) & (published > 0), "COMPLETED")
        .when((failed == total) | (failed + skipped == total), "FAILED")
        .when((published > 0) | (failed > 0), "PARTIAL")
        .otherwise("PENDING")
    )
    return counts.withColumn("status", status)


def add_details(existing: DataFrame, articles: DataFrame, top: DataFrame) -> DataFrame:
    """New rows for articles (batch_id, article_id) not in their batch yet, ranked as in ``top`` (batch_id, article_id, rank)."""
    key = ["batch_id", "article_id"]
    fresh = articles.select(*key).filter("article_id IS NOT NULL").distinct().join(existing.select(*key), key, "left_anti")
    # A later place in the list wins, as the list is read into a lookup.
    ranks = top.groupBy(*key).agg(F.max("rank").alias("top10_rank"))
    return fresh.join(ranks, key, "left").select(
        *key, F.col("top10_rank").isNotNull().alias("is_top10"), "top10_rank", F.lit("PENDING").alias("publish_status"))


# States in which a batch may still change.
OPEN_STATUSES = ("PENDING", "PARTIAL", "FAILED")


def apply_swaps(details: DataFrame, swaps: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Apply each batch's swaps, in order, to its top ten, and number it anew.

    ``swaps`` has batch_id, seq, index_top10 and either target_index (another place)
    or target_article (an article of the batch outside the top ten).  The article
    that leaves returns to the pool.  With ``batches`` (batch_id, status) only those in
    one of ``OPEN_STATUSES`` change; swaps of others are passed over.  Only top lists and swaps are gathered, never
    the pool: whether a target belongs to its batch is found by a join.
    """
    if batches is not None:
        unlocked = batches.filter(F.col("status").isin(*OPEN_STATUSES)).select("batch_id").distinct()
        swaps = swaps.join(unlocked, "batch_id", "left_semi")
    order = F.struct(F.coalesce("top10_rank", F.lit(999)).cast("long"), "detail_id", "article_id")
    tops = details.filter("is_top10").groupBy("batch_id").agg(F.array_sort(F.collect_list(order)).alias("_t"))
    tops = tops.select("batch_id", F.transform("_t", lambda x: x["article_id"]).alias("_top"))
    members = details.select("batch_id", F.col("article_id").alias("target_article"), F.lit(True).alias("_member"))
    known = swaps.join(members, ["batch_id", "target_article"], "left")
    op = F.struct("seq", "index_top10", "target_index", "target_article", F.coalesce("_member", F.lit(False)).alias("member"))
    ops = known.groupBy("batch_id").agg(F.array_sort(F.collect_list(op)).alias("_ops"))

    def put(array: Column, index: Column, value: Column) -> Column:
        return F.transform(array, lambda x, i: F.when(i == index, value).otherwise(x))

    def step(top: Column, o: Column) -> Column:
        i, j, new = o["index_top10"], o["target_index"], o["target_article"]
        inside = (i >= 0) & (i < F.size(top))
        trade = inside & j.isNotNull() & (j >= 0) & (j < F.size(top))
        bring = inside & j.isNull() & new.isNotNull() & o["member"] & ~F.array_contains(top, new)
        return (
            F.when(trade, put(put(top, i, F.get(top, j)), j, F.get(top, i)))
            .when(bring, put(top, i, new))
            .otherwise(top)
        )

    done = tops.join(ops, "batch_id").select(
        "batch_id", F.posexplode(F.aggregate("_ops", F.col("_top"), step)).alias("_rank", "article_id"))
    touched = ops.select("batch_id", F.lit(True).alias("_touched"))
    return (
        details.join(touched, "batch_id", "left").join(done, ["batch_id", "article_id"], "left")
        .withColumn("is_top10", F.when(F.col("_touched"), F.col("_rank").isNotNull()).otherwise(F.col("is_top10")))
        .withColumn("top10_rank", F.when(F.col("_touched"), F.col("_rank").cast("long")).otherwise(F.col("top10_rank")))
        .drop("_touched", "_rank")
    )


def validate_items(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with id and title, and the others with the reason."""
    ident = F.col("ulid").cast("string")
    no_id = ident.isNull() | ident.isin("", "None")
    no_title = F.btrim(F.coalesce("title", F.lit(""))) == ""
    reason = F.when(no_id, F.concat(F.lit("Invalid id: "), F.coalesce(ident, F.lit("None")))).when(
        no_title, F.concat(F.lit("Missing/empty title for id "), ident))
    checked = df.withColumn("reason", reason)
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def finalize(details: DataFrame) -> DataFrame:
    """Everything not archived is skipped."""
    done = F.col("publish_status") == "PUBLISHED_ARCHIVE"
    return details.withColumn("publish_status", F.when(done, F.col("publish_status")).otherwise("SKIPPED"))


def reset(details: DataFrame) -> DataFrame:
    """Everything is pending again, and translations are cleared."""
    out = details.withColumn("publish_status", F.lit("PENDING"))
    for c in ("translated_title", "translated_summary", "translated_conclusion"):
        if c in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def candidates(articles: DataFrame, min_chars: int = MIN_SUMMARY) -> DataFrame:
    """Articles with an id and a summary long enough to judge."""
    return articles.filter(F.col("id").isNotNull() & (F.length(F.btrim(F.coalesce("summary", F.lit("")), F.lit(" \t\n\r"))) >= min_chars))


def item_size(ident: str = "id") -> Column:
    """Length of the candidate as JSON text with title, conclusion and id."""
    def quoted(c: Column) -> Column:
        # Quotes and backslashes take one more character, as do line ends and tabs.
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.length(text) + F.regexp_count(text, F.lit('["\\\\\n\r\t]')) + 2

    names = len('{"title": , "conclusion": , "ulid": }')
    return (quoted(F.col("title")) + quoted(F.col("conclusion")) + quoted(F.col(ident)) + names).cast("long")


def pack(df: DataFrame, budget: int, key: str = "batch_id", ident: str = "id") -> DataFrame:
    """Candidates of each batch that fit the budget: longest conclusion first, up to the first that overflows.

    The first one always stays.  ``target`` is the number to choose, ten at most.
    """
    sized = df.withColumn("_len", F.length(F.coalesce("conclusion", F.lit("")))).withColumn(
        "_title", F.coalesce("title", F.lit(""))).withColumn("size", item_size(ident))
    packed = budget_prefix(
        sized, [key], [("_len", True), ("_title", False), (ident, False)], "size", budget, keep_first=True, positive=True)
    # What is packed of a batch is bounded by the budget.
    count = F.count(F.lit(1)).over(Window.partitionBy(key))
    return packed.withColumn("target", F.least(F.lit(TOP), count).cast("long"))


def accept_ranking(ranked: DataFrame, packed: DataFrame, key: str = "batch_id", ident: str = "id") -> DataFrame:
    """The ranked ids (key, id, position) of each batch if, known and distinct, they number the target; else the first packed."""
    firsts = ranked.groupBy(key, ident).agg(F.min("position").alias("_at"))
    whole = Window.partitionBy(key)
    order = whole.orderBy(
        F.when(F.col("accepted"), F.col("_at")).asc_nulls_last(), F.col("_len").desc(), F.col("_title").asc(), F.col(ident).asc())
    return (
        packed.join(firsts, [key, ident], "left")
        .withColumn("accepted", F.count("_at").over(whole) == F.col("target"))
        .withColumn("choice", F.row_number().over(order).cast("long"))
        .filter(F.when(F.col("accepted"), F.col("_at").isNotNull()).otherwise(F.col("choice") <= F.col("target")))
        .select(key, ident, "choice", "accepted")
    )


def completed_articles(articles: DataFrame, items: DataFrame) -> DataFrame:
    """Articles whose scrape step is complete, for each job; the item's ulid is the URL."""
    done = with_keys(items).filter((F.col("status") == "COMPLETED") & (F.col("step") == "scrape"))
    urls = done.select("job_id", F.col("ulid").alias("url")).distinct()
    return articles.join(urls, "url")


def phase_progress(details: DataFrame) -> DataFrame:
    """Sent, failed and ``sent/total`` of each batch, for the briefing (top ten) and the archive."""
    s, top = F.col("publish_status"), F.col("is_top10")
    briefed = s.isin("PUBLISHED_BRIEFING", "PUBLISHED_ARCHIVE")
    counts = details.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_if(top).alias("total_briefing"), F.count_if(~top).alias("total_archive"),
        F.count_if(top & briefed).alias("briefing_sent"), F.count_if(top & (s == "FAILED")).alias("briefing_failed"),
        F.count_if(~top & (s == "PUBLISHED_ARCHIVE")).alias("archive_sent"), F.count_if(~top & (s == "FAILED")).alias("archive_failed"))

    def share(sent: str, total: str) -> Column:
        text = F.concat(F.col(sent).cast("string"), F.lit("/"), F.col(total).cast("string"))
        return F.when(F.col(total) > 0, text).otherwise("N/A")

    return counts.withColumn("briefing_progress", share("briefing_sent", "total_briefing")).withColumn(
        "archive_progress", share("archive_sent", "total_archive"))


def dedupe_results(results: DataFrame, order: list[Column]) -> DataFrame:
    """The first result of each URL, not counting its query and outer slashes."""
    keyed = results.filter(F.coalesce("url", F.lit("")) != "").withColumn("_key", strip_query(F.col("url")))
    return first_per_key(keyed, ["_key"], order).drop("_key")


def with_canonical_url(df: DataFrame) -> DataFrame:
    return df.withColumn("canonical_url", normalize_url(F.col("url")))
