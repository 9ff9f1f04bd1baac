"""Queries over vectors, texts and pages."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import decode_vec, encode_vec
from millrace.operators import retrieval as R
from millrace.operators import textindex as X
from millrace.operators.batches import batch_ids
from millrace.queries.registry import query
from millrace.session import ensure_checkpoint_dir

TEXT = ["title", "conclusion", "summary"]
SEARCH = ["articles_v", "searches_v"]


def _docs(v) -> DataFrame:
    return v("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _short(column: str):
    return F.round(column, 5).alias(column)


def knn_sql(k: int, where: str = "true") -> str:
    return f"""
near AS (SELECT query_id, vec_id AS id, list_distance(CAST(query_vec AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS distance
  FROM searches_v, embeddings WHERE query_vec IS NOT NULL AND {where}),
vec AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS BIGINT) AS rank FROM near QUALIFY rank <= {k})"""


def bm25_sql(k: int, allowed: str = "true") -> str:
    return f"""
words AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, conclusion, summary)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM articles_v),
posts AS (SELECT id, length, token, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS token FROM words) GROUP BY 1, 2, 3),
st AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS m FROM words),
terms AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query_text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS token FROM searches_v),
need AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1),
dfs AS (SELECT token, greatest(ln(((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)), 0) AS raw FROM posts GROUP BY 1),
sc AS (SELECT query_id, id, count(*) AS hits, sum((CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT m FROM st))) ORDER BY token) AS s
  FROM posts JOIN terms USING (token) JOIN dfs USING (token) WHERE {allowed} GROUP BY 1, 2),
kw AS (SELECT query_id, id, round(s, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS BIGINT) AS rank
  FROM sc JOIN need USING (query_id) WHERE hits = n_terms QUALIFY rank <= {k})"""


def rrf_sql(limit: int | None) -> str:
    cut = "" if limit is None else f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sc0 DESC, id) <= {limit}"
    return f"""
f AS (SELECT coalesce(vec.query_id, kw.query_id) AS query_id, coalesce(vec.id, kw.id) AS id, vec.rank AS vr, kw.rank AS kr,
  coalesce(0.6::DOUBLE / (60 + vec.rank), 0) + coalesce(0.4::DOUBLE / (60 + kw.rank), 0) AS sc0
  FROM vec FULL JOIN kw ON vec.query_id = kw.query_id AND vec.id = kw.id)
SELECT query_id, id, coalesce(vr, 0) AS vec_rank, coalesce(kr, 0) AS kw_rank, round(sc0, 5) AS fusion_score FROM f {cut}"""


def _ranks(df: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.select("query_id", "id", F.coalesce("vec_rank", zero).alias("vec_rank"), F.coalesce("kw_rank", zero).alias("kw_rank"), "fusion_score")


@query("vec_knn", ["searches_v"], f"WITH {knn_sql(10).strip()} SELECT query_id, id, round(distance, 5) AS distance, rank FROM vec")
def vec_knn(v):
    return R.knn(_docs(v), v("searches_v"), 10).select("query_id", "id", _short("distance"), "rank")


@query("vec_knn_metric", ["searches_v"], f"WITH {knn_sql(10).strip()} SELECT query_id, id, round(distance, 5) AS distance, rank FROM vec")
def vec_knn_metric(v):
    """As if the queries were too many to travel with the tasks."""
    return R.knn(_docs(v), v("searches_v"), 10, max_queries=0).select("query_id", "id", _short("distance"), "rank")


@query("vec_threshold", ["searches_v"], f"WITH {knn_sql(50).strip()} SELECT query_id, id, round(1 - distance, 5) AS similarity FROM vec WHERE 1 - distance >= 0.1")
def vec_threshold(v):
    return R.above(R.knn(_docs(v), v("searches_v"), 50), 0.1).select("query_id", "id", _short("similarity"))


@query("vec_knn_filtered", ["searches_v"], f"WITH {knn_sql(5, 'label < 3').strip()} SELECT query_id, id, round(distance, 5) AS distance, rank FROM vec")
def vec_knn_filtered(v):
    return R.knn(_docs(v), v("searches_v"), 5, where=F.col("label") < 3).select("query_id", "id", _short("distance"), "rank")


@query("vec_knn_postfiltered", ["searches_v"], f"WITH {knn_sql(25).strip()} SELECT query_id, id, round(distance, 5) AS distance FROM vec JOIN embeddings ON id = vec_id WHERE label < 3")
def vec_knn_postfiltered(v):
    return R.knn(_docs(v), v("searches_v"), 25, where=F.col("label") < 3, prefilter=False).select("query_id", "id", _short("distance"))


@query("kw_clean", [], """
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM documents""")
def kw_clean(v):
    return v("documents").select("doc_id", R.clean_query(F.col("text")).alias("cleaned"))


@query("kw_postings", ["articles_v"], """
WITH words AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, conclusion, summary)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM articles_v)
SELECT token, id, CAST(length AS INT) AS length, CAST(count(*) AS BIGINT) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS token FROM words) GROUP BY 1, 2, 3""")
def kw_postings(v):
    return R.postings(v("articles_v"), TEXT)


@query("kw_bm25", SEARCH, f"WITH {bm25_sql(10).strip()} SELECT query_id, id, score, rank FROM kw")
def kw_bm25(v):
    return R.bm25(v("articles_v"), TEXT, v("searches_v"), 10).withColumn("score", _short("score"))


def _index(v) -> DataFrame:
    """A stored index, brought up to date for the articles of one language after they changed."""
    articles = v("articles_v")
    spark = articles.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    german = F.col("lang") == "de"
    R.write_index(articles.withColumn("summary", F.when(german, F.lit("old text")).otherwise(F.col("summary"))), TEXT, folder)
    return R.update_index(spark.read.parquet(folder), articles.filter(german), TEXT)


@query("kw_bm25_index", SEARCH, f"WITH {bm25_sql(10).strip()} SELECT query_id, id, score, rank FROM kw")
def kw_bm25_index(v):
    return R.bm25_index(_index(v), v("searches_v"), 10).withColumn("score", _short("score"))


def _segments(v) -> str:
    """An index in segments: the texts of one language were replaced, and others came, went and came again."""
    articles = v("articles_v")
    spark = articles.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/segments-{uuid.uuid4().hex}"
    german, french = F.col("lang") == "de", F.col("lang") == "fr"
    X.update(spark, root, articles.filter(~french).withColumn("summary", F.when(german, F.lit("old text")).otherwise(F.col("summary"))), TEXT)
    X.update(spark, root, articles.filter(german | french), TEXT, articles.filter(F.col("lang") == "es").select("id"))
    X.update(spark, root, articles.filter(F.col("lang") == "es"), TEXT)
    return root


@query("kw_bm25_pruned", SEARCH, f"WITH {bm25_sql(10).strip()} SELECT query_id, id, score, rank FROM kw")
def kw_bm25_pruned(v):
    queries = v("searches_v")
    return X.search(queries.sparkSession, _segments(v), queries, 10).withColumn("score", _short("score"))


@query("kw_bm25_merged", SEARCH, f"WITH {bm25_sql(10).strip()} SELECT query_id, id, score, rank FROM kw")
def kw_bm25_merged(v):
    queries, root = v("searches_v"), _segments(v)
    X.merge(queries.sparkSession, root, 2)
    return X.search(queries.sparkSession, root, queries, 10).withColumn("score", _short("score"))


@query("rrf", SEARCH, f"WITH {knn_sql(15).strip()}, {bm25_sql(15).strip()}, {rrf_sql(None).strip()}")
def rrf(v):
    near = R.knn(_docs(v), v("searches_v"), 15)
    return _ranks(R.rrf(near, R.bm25(v("articles_v"), TEXT, v("searches_v"), 15)))


IN_BATCH = "id IN (SELECT d.article_id FROM details_v d JOIN articles_v a ON d.article_id = a.id WHERE a.title <> '' AND d.publish_status <> 'FAILED')"


@query("hybrid_search", [*SEARCH, "details_v"],
       f"WITH {knn_sql(15, IN_BATCH.replace('id IN', 'vec_id IN')).strip()}, {bm25_sql(15, IN_BATCH).strip()}, {rrf_sql(5).strip()}")
def hybrid_search(v):
    articles = v("articles_v")
    batch = batch_ids(v("details_v").filter("publish_status <> 'FAILED'"), articles).select(F.col("article_id").alias("id"))
    return _ranks(R.hybrid_search(articles, TEXT, _docs(v), v("searches_v"), allowed=batch, limit=5))


@query("hybrid_search_index", [*SEARCH, "details_v"],
       f"WITH {knn_sql(180, IN_BATCH.replace('id IN', 'vec_id IN')).strip()}, {bm25_sql(180, IN_BATCH).strip()}, {rrf_sql(60).strip()}")
def hybrid_search_index(v):
    articles = v("articles_v")
    batch = batch_ids(v("details_v").filter("publish_status <> 'FAILED'"), articles).select(F.col("article_id").alias("id"))
    return _ranks(R.hybrid_search(articles, TEXT, _docs(v), v("searches_v"), allowed=batch, limit=60, index=_index(v)))


@query("vec_validate", [], """
SELECT vec_id, CASE WHEN label < 2 THEN 'Dimension mismatch: expected 64, got 63' WHEN label < 4 THEN 'Vector contains non-finite values' END AS error_message
FROM embeddings WHERE label < 4 UNION ALL SELECT vec_id, 'ok' FROM embeddings WHERE label >= 4""")
def vec_validate(v):
    vec = F.col("embedding")
    spoiled = F.when(F.col("label") < 2, F.slice(vec, 1, 63)).when(
        F.col("label") < 4, F.concat(F.slice(vec, 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(vec)
    good, bad = R.validate_vectors(v("embeddings").select("vec_id", spoiled.alias("embedding")), 64)
    return bad.select("vec_id", "error_message").unionByName(good.select("vec_id", F.lit("ok").alias("error_message")))


@query("vec_decode", [], "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def vec_decode(v):
    back = v("embeddings").select("vec_id", decode_vec(encode_vec("embedding")).alias("e"))
    return back.select("vec_id", F.size("e").alias("n"), F.col("e")[0].cast("double").alias("first"), F.col("e")[63].cast("double").alias("last"))


@query("vec_backlog", ["articles_v"], "SELECT embedding_status, CAST(count(*) AS BIGINT) AS n FROM articles_v GROUP BY 1")
def vec_backlog(v):
    return R.backlog(v("articles_v"))


@query("page_range", [], "SELECT conv_id, turn, text FROM conversations WHERE turn BETWEEN 1 AND 3 OR turn = 5")
def page_range(v):
    return R.page_range(v("conversations"), "1-3,x,5", "turn").select("conv_id", "turn", "text")


@query("greedy_fill", [], """
WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE length(text) <= 1500),
w AS (SELECT conv_id, turn, rn, CASE WHEN cost <= 1500 THEN cost ELSE 0 END AS used, cost <= 1500 AS kept FROM r WHERE rn = 1
  UNION ALL SELECT r.conv_id, r.turn, r.rn, w.used + CASE WHEN w.used + r.cost <= 1500 THEN r.cost ELSE 0 END, w.used + r.cost <= 1500
  FROM w JOIN r ON r.conv_id = w.conv_id AND r.rn = w.rn + 1)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY rn) - 1 AS INT) AS position, CAST(max(used) OVER (PARTITION BY conv_id) AS BIGINT) AS used FROM w WHERE kept""")
def greedy_fill(v):
    pages = v("conversations").withColumn("cost", F.length("text"))
    return R.greedy_fill(pages, ["conv_id"], [F.col("turn").asc()], "turn", "cost", 1500)


@query("toc_block", [], """
WITH m AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations
  WHERE contains(lower(text), 'contents') OR contains(lower(text), 'on the')
    OR contains(lower(text), 'le ') OR contains(lower(text), 'der') OR len(regexp_extract_all(text, '\\.{3,}\\s*\\d+')) > 3),
b AS (SELECT conv_id, min(turn) AS a, max(turn) AS z FROM m GROUP BY conv_id, g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn)) = 1)
SELECT m.conv_id, m.turn FROM m JOIN b ON m.conv_id = b.conv_id AND turn BETWEEN a AND z""")
def toc_block(v):
    return R.toc_block(v("conversations"), "conv_id", "turn", "text", ("contents", "on the", "le ", "der")).select("conv_id", "turn")
