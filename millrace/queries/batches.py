"""Queries over articles, batches and session context."""

from pyspark.sql import functions as F

from millrace.functions.text import normalize_url
from millrace.operators import batches as B
from millrace.operators import context as C
from millrace.operators.jobs import publisher_report
from millrace.queries.registry import query

AD = ["articles_v", "details_v"]
ARTICLE = "a.id AS article_id, d.batch_id, d.detail_id, d.is_top10, coalesce(d.top10_rank, -1) AS top10_rank, d.publish_status, a.url, a.title"
NORM = "lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''))"


def _shown(df):
    return df.select("article_id", "batch_id", "detail_id", "is_top10", F.coalesce("top10_rank", F.lit(-1)).cast("long").alias("top10_rank"),
                     "publish_status", "url", "title")


@query("art_upsert", ["articles_v"], f"""
WITH n AS (SELECT url, id + 1000000 AS id, concat(title, '!') AS title FROM articles_v WHERE lang <> 'fr'), o AS (SELECT url, id, title FROM articles_v WHERE lang <> 'en')
SELECT coalesce(o.url, n.url) AS url, coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, CASE WHEN o.url IS NULL THEN 'new' ELSE 'old' END AS scraped_at
FROM o FULL JOIN n ON o.url = n.url""")
def art_upsert(v):
    rows = v("articles_v").select("url", "id", "title", "lang")
    old = rows.filter("lang <> 'en'").select("url", "id", "title", F.lit("old").alias("scraped_at"), F.lit(1).alias("updated_at"))
    new = rows.filter("lang <> 'fr'").select(
        "url", (F.col("id") + 1000000).alias("id"), F.concat("title", F.lit("!")).alias("title"), F.lit("new").alias("scraped_at"), F.lit(2).alias("updated_at"))
    earlier = new.withColumn("updated_at", F.lit(0)).withColumn("title", F.lit("stale"))
    return B.upsert_articles(old, new.unionByName(earlier)).select("url", "id", "title", "scraped_at")


@query("url_normalize", [], f"SELECT page_id, {NORM} AS canonical_url FROM pages")
def url_normalize(v):
    return B.with_canonical_url(v("pages")).select("page_id", "canonical_url")




def _links(v):
    # Pages already seen: those of hosts that some secure page was read from.
    all_links = v("pages").select(normalize_url(F.col("url")).alias("url"))
    return all_links, all_links.filter(F.col("url").startswith("https:"))


@query("url_new", [], f"WITH l AS (SELECT DISTINCT {NORM} AS url FROM pages) SELECT url FROM l WHERE NOT starts_with(url, 'https:')")
def url_new(v):
    return B.new_links(*_links(v))


@query("url_new_counts", [], f"""
WITH l AS (SELECT DISTINCT {NORM} AS url FROM pages) SELECT CAST(count(*) AS BIGINT) AS links, CAST(count(*) FILTER (WHERE starts_with(url, 'https:')) AS BIGINT) AS known,
  CAST(count(*) FILTER (WHERE NOT starts_with(url, 'https:')) AS BIGINT) AS new FROM l""")
def url_new_counts(v):
    return B.link_counts(*_links(v))


@query("batch_ids", AD, "SELECT d.batch_id, d.article_id FROM details_v d JOIN articles_v a ON d.article_id = a.id WHERE a.title <> '' AND d.publish_status = 'PENDING'")
def batch_ids(v):
    return B.batch_ids(v("details_v"), v("articles_v"), "PENDING")


@query("batch_articles", AD, f"SELECT {ARTICLE} FROM details_v d JOIN articles_v a ON d.article_id = a.id")
def batch_articles(v):
    return _shown(B.batch_articles(v("details_v"), v("articles_v")))


@query("batch_top", AD, f"SELECT {ARTICLE} FROM details_v d JOIN articles_v a ON d.article_id = a.id WHERE d.is_top10")
def batch_top(v):
    return _shown(B.batch_articles(v("details_v"), v("articles_v"), top_only=True))


@query("batch_progress", ["details_v"], "SELECT batch_id, publish_status, CAST(count(*) AS BIGINT) AS n FROM details_v GROUP BY 1, 2")
def batch_progress(v):
    return B.progress(v("details_v"))


@query("batch_to_publish", AD, f"SELECT {ARTICLE} FROM details_v d JOIN articles_v a ON d.article_id = a.id WHERE d.publish_status IN ('PENDING', 'FAILED', 'TRANSLATING', 'PUBLISHED_BRIEFING')")
def batch_to_publish(v):
    return _shown(B.to_publish(v("details_v"), v("articles_v")))


@query("batch_rollup", ["details_v"], """
WITH d AS (SELECT concat(batch_id, '/', d.lang) AS batch_id, publish_status AS s FROM details_v JOIN documents d ON article_id = d.doc_id),
c AS (SELECT batch_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE s = 'PUBLISHED_ARCHIVE') AS BIGINT) AS published,
  CAST(count(*) FILTER (WHERE s = 'FAILED') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE s = 'SKIPPED') AS BIGINT) AS skipped FROM d GROUP BY 1)
SELECT *, CASE WHEN published + skipped = total AND published > 0 THEN 'COMPLETED' WHEN failed = total OR failed + skipped = total THEN 'FAILED'
  WHEN published > 0 OR failed > 0 THEN 'PARTIAL' ELSE 'PENDING' END AS status FROM c""")
def batch_rollup(v):
    langs = v("documents").select(F.col("doc_id").alias("article_id"), "lang")
    return B.rollup(v("details_v").join(langs, "article_id").withColumn("batch_id", F.concat_ws("/", "batch_id", "lang")))


@query("batch_resume", ["details_v"], """
WITH c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE publish_status IN ('PUBLISHED_ARCHIVE', 'PUBLISHED_BRIEFING', 'SKIPPED')) AS done,
  count(*) FILTER (WHERE publish_status = 'PUBLISHED_ARCHIVE') AS published, count(*) FILTER (WHERE publish_status = 'FAILED') AS failed, count(*) FILTER (WHERE publish_status = 'SKIPPED') AS skipped FROM details_v GROUP BY 1),
s AS (SELECT *, CASE WHEN published + skipped = total AND published > 0 THEN 'COMPLETED' WHEN failed = total OR failed + skipped = total THEN 'FAILED'
  WHEN published > 0 OR failed > 0 THEN 'PARTIAL' ELSE 'PENDING' END AS status FROM c)
SELECT batch_id, status, CAST(done AS BIGINT) AS items_completed, CAST(total - done AS BIGINT) AS items_pending,
  CASE WHEN status = 'COMPLETED' THEN false WHEN failed > 0 THEN true ELSE status IN ('PENDING', 'PARTIAL') AND total > done END AS resumable FROM s""")
def batch_resume(v):
    details = v("details_v")
    return publisher_report(B.rollup(details).select("batch_id", "status"), details)


@query("batch_assign", AD, """
WITH e AS (SELECT batch_id, article_id FROM details_v WHERE publish_status = 'FAILED'),
t AS (SELECT batch_id, article_id, top10_rank FROM details_v WHERE is_top10)
SELECT d.batch_id, d.article_id, t.top10_rank IS NOT NULL AS is_top10, coalesce(t.top10_rank, -1) AS top10_rank, 'PENDING' AS publish_status
FROM details_v d LEFT JOIN t USING (batch_id, article_id) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.batch_id = d.batch_id AND e.article_id = d.article_id)""")
def batch_assign(v):
    d = v("details_v")
    top = d.filter("is_top10").select("batch_id", "article_id", F.col("top10_rank").alias("rank"))
    made = B.add_details(d.filter("publish_status = 'FAILED'"), d, top)
    return made.withColumn("top10_rank", F.coalesce("top10_rank", F.lit(-1)).cast("long"))


# For each batch: bring in the first article outside the top ten at place 0, then trade places 0 and 1.
@query("batch_swap", ["details_v"], """
WITH f AS (SELECT batch_id, min(article_id) AS new FROM details_v WHERE NOT is_top10 GROUP BY 1),
t AS (SELECT d.*, f.new FROM details_v d LEFT JOIN f USING (batch_id))
SELECT detail_id, batch_id, article_id, CASE WHEN new IS NULL THEN is_top10 ELSE (is_top10 AND top10_rank <> 0) OR article_id = new END AS is_top10,
  CASE WHEN new IS NULL THEN coalesce(top10_rank, -1) WHEN article_id = new THEN 1 WHEN top10_rank = 0 THEN -1 WHEN top10_rank = 1 THEN 0 ELSE coalesce(top10_rank, -1) END AS top10_rank FROM t""")
def batch_swap(v):
    d = v("details_v")
    new = d.filter("NOT is_top10").groupBy("batch_id").agg(F.min("article_id").alias("target_article"))
    none = F.lit(None)
    bring = new.select("batch_id", F.lit(1).alias("seq"), F.lit(0).alias("index_top10"), none.cast("int").alias("target_index"), "target_article")
    trade = new.select("batch_id", F.lit(2).alias("seq"), F.lit(0).alias("index_top10"), F.lit(1).alias("target_index"), none.cast("long").alias("target_article"))
    swapped = B.apply_swaps(d, bring.unionByName(trade))
    return swapped.select("detail_id", "batch_id", "article_id", "is_top10", F.coalesce("top10_rank", F.lit(-1)).cast("long").alias("top10_rank"))


@query("batch_validate", ["articles_v"], """
SELECT id, CASE WHEN source = 'src0' THEN 'Invalid id: None' WHEN lang = 'de' OR trim(title) = '' THEN concat('Missing/empty title for id ', id) ELSE 'ok' END AS reason FROM articles_v""")
def batch_validate(v):
    rows = v("articles_v").select(
        "id", F.when(F.col("source") != "src0", F.col("id")).alias("ulid"), F.when(F.col("lang") != "de", F.col("title")).alias("title"))
    good, bad = B.validate_items(rows)
    return bad.select("id", "reason").unionByName(good.select("id", F.lit("ok").alias("reason")))


@query("batch_finalize", ["details_v"], "SELECT detail_id, CASE WHEN publish_status = 'PUBLISHED_ARCHIVE' THEN publish_status ELSE 'SKIPPED' END AS publish_status FROM details_v")
def batch_finalize(v):
    return B.finalize(v("details_v")).select("detail_id", "publish_status")


@query("batch_reset", ["details_v"], "SELECT detail_id, 'PENDING' AS publish_status, CAST(NULL AS VARCHAR) AS translated_title FROM details_v")
def batch_reset(v):
    return B.reset(v("details_v").withColumn("translated_title", F.lit("x"))).select("detail_id", "publish_status", "translated_title")


@query("cur_candidates", ["articles_v"], "SELECT id FROM articles_v WHERE length(trim(summary, ' \t\n\r')) >= 600")
def cur_candidates(v):
    return B.candidates(v("articles_v")).select("id")


PACK = """
c AS (SELECT d.batch_id, a.id, a.title, a.conclusion, length(conclusion) AS len, 37 + 6 + length(title) + length(conclusion) + length(CAST(a.id AS VARCHAR))
    + len(regexp_extract_all(title, '["\\\\\\n\\r\\t]')) + len(regexp_extract_all(conclusion, '["\\\\\\n\\r\\t]')) AS size
  FROM articles_v a JOIN details_v d ON d.article_id = a.id WHERE length(trim(summary, ' \t\n\r')) >= 600),
r AS (SELECT *, sum(size) OVER (PARTITION BY batch_id ORDER BY len DESC, title, id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY batch_id ORDER BY len DESC, title, id) AS rn FROM c),
p AS (SELECT batch_id, id, title, len, CAST(size AS BIGINT) AS size, rn FROM r WHERE cum <= 6000 OR rn = 1),
pt AS (SELECT *, CAST(least(10, count(*) OVER (PARTITION BY batch_id)) AS BIGINT) AS target FROM p)"""


def _packed(v):
    pool = B.candidates(v("articles_v")).join(v("details_v").select("batch_id", F.col("article_id").alias("id")), "id")
    return B.pack(pool, 6000)


@query("cur_pack", AD, f"WITH {PACK.strip()} SELECT batch_id, id, size, target FROM pt")
def cur_pack(v):
    return _packed(v).select("batch_id", "id", "size", "target")


# The ranking offered: the labelled articles of the batch, with one named twice.
@query("cur_accept", AD, f"""
WITH {PACK.strip()},
k AS (SELECT pt.*, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS at FROM pt WHERE id IN (SELECT doc_id FROM labels) OR batch_id < 'src15'),
n AS (SELECT batch_id, count(*) AS n FROM k GROUP BY 1),
v AS (SELECT DISTINCT pt.batch_id, target, coalesce(n, 0) = target AS accepted FROM pt LEFT JOIN n ON pt.batch_id = n.batch_id)
SELECT k.batch_id, k.id, CAST(k.at AS BIGINT) AS choice, accepted FROM k JOIN v ON k.batch_id = v.batch_id WHERE accepted
UNION ALL SELECT pt.batch_id, pt.id, CAST(pt.rn AS BIGINT), accepted FROM pt JOIN v ON pt.batch_id = v.batch_id WHERE NOT accepted AND pt.rn <= v.target""")
def cur_accept(v):
    packed = _packed(v)
    labels = v("labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("_l"))
    offered = v("details_v").select("batch_id", F.col("article_id").alias("id")).join(labels, "id", "left")
    offered = offered.filter("_l OR batch_id < 'src15'").select("batch_id", "id", F.col("id").alias("position"))
    twice = offered.withColumn("position", F.col("position") + 1000000)
    return B.accept_ranking(offered.unionByName(twice), packed)


@query("job_completed_articles", ["articles_v", "items_v"], """
SELECT DISTINCT i.job_id, a.id, a.title FROM articles_v a JOIN items_v i ON json_extract_string(i.item_metadata, '$.ulid') = concat('u', a.id)
WHERE i.status = 'COMPLETED' AND json_extract_string(i.item_metadata, '$.step') = 'scrape'""")
def job_completed_articles(v):
    articles = v("articles_v").withColumn("url", F.concat(F.lit("u"), F.col("id").cast("string")))
    return B.completed_articles(articles, v("items_v")).select("job_id", "id", "title")


@query("batch_phases", ["details_v"], """
WITH c AS (SELECT batch_id, CAST(count(*) AS BIGINT) AS total_articles, CAST(count(*) FILTER (WHERE is_top10) AS BIGINT) AS total_briefing, CAST(count(*) FILTER (WHERE NOT is_top10) AS BIGINT) AS total_archive,
  CAST(count(*) FILTER (WHERE is_top10 AND publish_status IN ('PUBLISHED_BRIEFING', 'PUBLISHED_ARCHIVE')) AS BIGINT) AS briefing_sent, CAST(count(*) FILTER (WHERE is_top10 AND publish_status = 'FAILED') AS BIGINT) AS briefing_failed,
  CAST(count(*) FILTER (WHERE NOT is_top10 AND publish_status = 'PUBLISHED_ARCHIVE') AS BIGINT) AS archive_sent, CAST(count(*) FILTER (WHERE NOT is_top10 AND publish_status = 'FAILED') AS BIGINT) AS archive_failed FROM details_v GROUP BY 1)
SELECT *, CASE WHEN total_briefing > 0 THEN concat(briefing_sent, '/', total_briefing) ELSE 'N/A' END AS briefing_progress,
  CASE WHEN total_archive > 0 THEN concat(archive_sent, '/', total_archive) ELSE 'N/A' END AS archive_progress FROM c""")
def batch_phases(v):
    return B.phase_progress(v("details_v"))


@query("url_dedupe", [], """
WITH r AS (SELECT page_id, concat('https://', regexp_extract(url, '^https?://[^/]*?([^./]+\\.[a-z]+)/', 1), '/', CASE WHEN contains(url, '?') THEN '?x=1' ELSE '' END) AS url FROM pages),
k AS (SELECT *, trim(regexp_replace(url, '\\?.*$', ''), '/') AS key FROM r)
SELECT page_id, url FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1""")
def url_dedupe(v):
    site = F.regexp_extract("url", r"^https?://[^/]*?([^./]+\.[a-z]+)/", 1)
    made = F.concat(F.lit("https://"), site, F.lit("/"), F.when(F.col("url").contains("?"), "?x=1").otherwise(""))
    return B.dedupe_results(v("pages").select("page_id", made.alias("url")), [F.col("page_id").asc()])


COST = """
e AS (SELECT *, char_count + CASE WHEN has_screenshot AND id < max(CASE WHEN has_screenshot THEN id END) OVER (PARTITION BY session_id) THEN 0 ELSE coalesce(attachment_char_count, 0) END AS cost FROM messages_v),
r AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS cum FROM e),
k AS (SELECT * FROM r WHERE cum <= 3000),
sc AS (SELECT m.session_id, CAST(coalesce(sum(k.cost), 0) AS BIGINT) AS cost FROM (SELECT DISTINCT session_id FROM messages_v) m LEFT JOIN k ON m.session_id = k.session_id GROUP BY 1)"""


@query("ctx_prefix", ["messages_v"], f"WITH {COST.strip()} SELECT session_id, id, role, content, CAST(cum AS BIGINT) AS running_cost FROM k")
def ctx_prefix(v):
    return C.context(v("messages_v"), 3000).select("session_id", "id", "role", "content", "running_cost")


@query("ctx_cost_rows", ["messages_v"], f"WITH {COST.strip()} SELECT session_id, id, CAST(cost AS BIGINT) AS cost FROM e")
def ctx_cost_rows(v):
    return C.effective_cost(v("messages_v")).select("session_id", "id", "cost")


@query("ctx_cost", ["messages_v"], f"WITH {COST.strip()} SELECT * FROM sc")
def ctx_cost(v):
    return C.session_cost(v("messages_v"), 3000)


@query("ctx_exceeds", ["messages_v"], f"WITH {COST.strip()} SELECT *, cost + 500 > 3000 AS exceeds FROM sc")
def ctx_exceeds(v):
    return C.would_exceed(v("messages_v"), 500, 3000)


@query("ctx_evict", ["messages_v"], """
WITH s AS (SELECT *, char_count + coalesce(attachment_char_count, 0) AS size FROM messages_v),
r AS (SELECT *, sum(size) OVER (PARTITION BY session_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS rn FROM s)
SELECT session_id, id, content, char_count FROM r WHERE cum <= 1400
UNION ALL SELECT session_id, id, substr(content, 1, 1000), length(substr(content, 1, 1000)) FROM r WHERE rn = 1 AND size > 1400""")
def ctx_evict(v):
    return C.evict(v("messages_v"), 1400).select("session_id", "id", "content", "char_count")
