"""One query for each operator of this package, over whole tables, and its check in plain SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, codes, decontamination, html_text, language, linededup, packing, phrases, quality, simhash, topk, toxicity, urlfilter
from millrace.llm.common import cut, fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against benchmark items, by windows of 10 words."""
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hit = decontamination.covered(F.col("windows"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
CHECKS["op1_decontamination"] = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
  lambda s: array_to_string(w[s:s + least(len(w), 10) - 1], ' '))) AS win FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2),
  lambda s: array_to_string(w[s:s + n - 1], ' '))) AS win FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN iw USING (n, win)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
held AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN held USING (doc_id)"""


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), 2048)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(slim, 2048)


@_query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says what the template says, read back from their formatted turns."""
    said = "\\### Assistant: </turn> ok"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    events = rows.withColumn("seq", F.col("turn")).withColumn("kind", F.lit(chat.MESSAGE))
    return chat.digest(chat.format_conversations(events))


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model that has seen four fifths of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model that has seen two thirds of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    found = language.identify(docs, language.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a model that has seen two thirds of the labels."""
    docs = _table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    found = quality.grade(docs, quality.fit(docs, _table(spark, sf_dir, "labels").where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@_query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other rows for each row whose id 50 divides."""
    vectors = topk.whole_numbers(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


CHECKS["op10_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""


@_query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = simhash.near_duplicates(simhash.fingerprints(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the blocks of lines that earlier ones hold."""
    found = linededup.without_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "removed_lines", F.length("text").cast("long").alias("n_chars"))


#: Rules of the url filter: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


CHECKS["op11_url_filter"] = f"""
WITH rules(h, p, v) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u AS (SELECT row_number() OVER () AS n, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fit AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS r
  FROM u JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM fit WHERE r = 1) USING (n)"""


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and those of their label."""
    found = cut(codes.compress(_table(spark, sf_dir, "embeddings")))
    of_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.col("books_sha256").alias("codebooks_sha256"))


@_query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language over all documents."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


CHECKS["op12_phrases"] = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(w) AS x, unnest(w[2:]) AS y, unnest(w[3:]) AS z FROM w WHERE len(w) > 0),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS a FROM g GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS a FROM g WHERE y IS NOT NULL GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS a FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING a >= 10),
cuts AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.a, l.a AS l, r.a AS r, 1 AS k FROM f2 c JOIN f1 l USING (lang, x)
    JOIN f1 r ON r.lang = c.lang AND r.x = c.y WHERE c.a >= 10 AND NOT EXISTS (SELECT 1 FROM f3 h WHERE h.lang = c.lang AND h.x = c.x AND h.y = c.y AND 100 * h.a >= 50 * c.a)
    AND NOT EXISTS (SELECT 1 FROM f3 h WHERE h.lang = c.lang AND h.y = c.x AND h.z = c.y AND 100 * h.a >= 50 * c.a)
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.a, l.a, r.a, 1 FROM f3 c JOIN f1 l USING (lang, x) JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.a, l.a, r.a, 2 FROM f3 c JOIN f2 l USING (lang, x, y) JOIN f1 r ON r.lang = c.lang AND r.x = c.z),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ns AS (SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN ns USING (lang) QUALIFY rank <= 2000"""
