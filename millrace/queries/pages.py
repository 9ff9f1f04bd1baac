"""Queries over web pages and texts."""

from pyspark.sql import functions as F

from millrace.functions.text import ascii_punct, clean_bullets, extract_json, extract_tag
from millrace.operators import pages as P
from millrace.queries.registry import query

EDGES = "' \t\n\r'"


def _strip(tags: tuple[str, ...], sql: str) -> str:
    for t in tags:
        sql = f"regexp_replace({sql}, '(?si)<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'g')"
    return sql


_BARE = _strip(("noscript", "nav", "header", "footer"), f"regexp_replace({_strip(('script', 'style'), 'html')}, '(?s)<!--.*?-->', '', 'g')")


def _plain(sql: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return sql


VISIBLE = f"""vis AS (SELECT page_id, lower(array_to_string(list_filter(list_transform(
  regexp_split_to_array({_plain(f"regexp_replace({_BARE}, '<[^>]*>', chr(1), 'g')")}, chr(1)), lambda t: trim(t, {EDGES})), lambda t: t <> ''), ' ')) AS body FROM pages)"""


@query("page_links", [], """
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s+([^>]*)>', 1)) AS attrs FROM pages),
h AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS host, replace(regexp_extract(attrs, '(?i)(?:^|\\s)href\\s*=\\s*["'']([^"'']*)["'']', 1), '&amp;', '&') AS href FROM a)
SELECT DISTINCT page_id, CASE WHEN starts_with(href, '/') THEN concat(host, href) ELSE href END AS link FROM h WHERE href <> ''""")
def page_links(v):
    return P.extract_links(v("pages"))


@query("page_links_rule", [], """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s+([^>]*)>', 1)) AS attrs FROM pages),
h AS (SELECT page_id, regexp_extract(attrs, '(?i)(?:^|\\s)href\\s*=\\s*["'']([^"'']*)["'']', 1) AS href FROM a)
SELECT DISTINCT page_id, concat('https://site.example', href) AS link FROM h WHERE (starts_with(href, '/t') OR contains(href, 'n')) AND starts_with(href, '/e')""")
def page_links_rule(v):
    rule = P.LinkRule(base="https://site.example", anchors=(P.Anchor(href_prefix="/t"), P.Anchor(href_prefix="/", href_contains="n")), keep="example/e")
    return P.extract_links(v("pages"), rule)


@query("page_text", [], f"WITH {VISIBLE} SELECT page_id, body AS visible FROM vis")
def page_text(v):
    return v("pages").select("page_id", P.visible_text(F.col("html")).alias("visible"))


def wall_sql(walls) -> str:
    sizes, kinds, hits = [], [], []
    for i, w in enumerate(walls):
        listed = ", ".join(f"'{p}'" for p in w.phrases)
        sizes.append(f"list_filter([{listed}], lambda p: contains(body, p)) AS w{i}")
        gate = " OR ".join(f"contains(body, '{p}')" for p in w.gate_phrases) or "false"
        kinds.append(f"WHEN len(w{i}) >= {w.needed} THEN CASE WHEN {gate} THEN 'gatekeeper' ELSE 'paywall' END")
        hits.append(f"WHEN len(w{i}) >= {w.needed} THEN array_to_string(w{i}, '|')")
    return f"""WITH {VISIBLE}, f AS (SELECT page_id, body, {', '.join(sizes)} FROM vis)
SELECT page_id, CASE {' '.join(kinds)} ELSE 'none' END AS blocker_type, CASE {' '.join(hits)} ELSE '' END AS indicators FROM f"""


def _walled(df):
    return df.select("page_id", F.coalesce("blocker_type", F.lit("none")).alias("blocker_type"), F.array_join("indicators", "|").alias("indicators"))


@query("page_paywall", [], wall_sql(P.WALLS))
def page_paywall(v):
    return _walled(P.paywall(v("pages")))


WORD_WALLS = (P.Wall(("the and", "whtion", "eaux"), 2), P.Wall(("ichkeit",), 1), P.Wall(("la ", "der ", "el ", "on"), 2, ("con ", "que")))


@query("page_walls", [], wall_sql(WORD_WALLS))
def page_walls(v):
    return _walled(P.paywall(v("pages"), WORD_WALLS))


@query("page_blocked", [], f"""
SELECT page_id, length(trim(html, {EDGES})) < 1000 OR {' OR '.join(f"contains(lower(html), '{p}')" for p in P.BLOCK_PHRASES)} AS blocked FROM pages""")
def page_blocked(v):
    return v("pages").select("page_id", P.is_blocked(F.col("html")).alias("blocked"))


@query("page_media", [], f"""
WITH s AS (SELECT page_id, html, regexp_split_to_array(html, '(?i)<p\\b[^>]*>') AS parts FROM pages),
b AS (SELECT page_id, html, list_transform(parts[2:], lambda p: regexp_replace(regexp_replace(p, '(?si)</p\\s*>.*$', ''), '<[^>]*>', chr(1), 'g')) AS bodies FROM s),
n AS (SELECT page_id, html, len(bodies) AS k, list_sum(list_transform(regexp_split_to_array({_plain("array_to_string(bodies, chr(1))")}, chr(1)), lambda t: length(trim(t, {EDGES})))) AS chars FROM b)
SELECT page_id, CAST(chars + greatest(k - 1, 0) AS INT) AS chars, regexp_matches(html, '(?i)<(video|audio)[\\s>/]') AND chars + greatest(k - 1, 0) < 500 AS media_only FROM n""")
def page_media(v):
    return v("pages").select("page_id", P.paragraph_chars(F.col("html")).alias("chars"), P.is_media_only(F.col("html")).alias("media_only"))


@query("text_json", [], """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN '{}' ELSE concat('{"n":', length(text), ',"role":"', role, '","turn":', turn, '}') END AS json FROM conversations""")
def text_json(v):
    body = F.concat(F.lit('{"turn": '), "turn", F.lit(', "role": "'), "role", F.lit('", "n": '), F.length("text"), F.lit(", }"))
    text = F.when(F.col("role") == "user", F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(
        F.col("role") == "system", F.concat(F.lit("not json "), "text")).otherwise(body)
    return v("conversations").select("conv_id", "turn", extract_json(text).alias("json"))


@query("text_tag", [], f"SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), {EDGES}) AS title FROM pages")
def text_tag(v):
    return v("pages").select("page_id", extract_tag(F.col("html"), "title").alias("title"))


@query("text_punct", [], f"""
SELECT doc_id, trim(replace(translate(concat(replace(text, ' the ', ' – '), '&nbsp;“q”'), '‑–—‘’“” ', '---''''"" '), '&nbsp;', ' '), {EDGES}) AS plain FROM documents""")
def text_punct(v):
    dressed = F.concat(F.replace("text", F.lit(" the "), F.lit(" – ")), F.lit("&nbsp;“q”"))
    return v("documents").select("doc_id", ascii_punct(dressed).alias("plain"))


@query("text_bullets", [], """
WITH l AS (SELECT doc_id, i, CASE WHEN i % 3 = 1 THEN concat('the ARTICLE says ', lower(s)) WHEN i % 3 = 2 THEN concat('It notes that  ', s) ELSE s END AS b, i % 3 AS m, s
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE s <> ''),
c AS (SELECT doc_id, i, ltrim(CASE m WHEN 1 THEN lower(s) WHEN 2 THEN s ELSE concat('x', s) END, ' ') AS t FROM l)
SELECT doc_id, array_to_string(list(concat(upper(substr(t, 1, 1)), substr(t, 2)) ORDER BY i), '|') AS bullets FROM c GROUP BY doc_id""")
def text_bullets(v):
    lines = F.filter(F.transform(
        F.split("text", "\n"),
        lambda s, i: F.when(s == "", "").when(i % 3 == 0, F.concat(F.lit("the ARTICLE says "), F.lower(s))).when(
            i % 3 == 1, F.concat(F.lit("It notes that  "), s)).otherwise(F.concat(F.lit("x"), s))), lambda b: b.isNotNull())
    docs = v("documents").select("doc_id", clean_bullets(lines).alias("b")).filter(F.size("b") > 0)
    return docs.select("doc_id", F.array_join("b", "|").alias("bullets"))


@query("text_chunks", [], """
WITH s AS (SELECT doc_id, text, CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 900) END AS st FROM documents WHERE text <> '')
SELECT doc_id, CAST(i - 1 AS INT) AS chunk, substr(text, st[i] + 1, 1000) AS chunk_text FROM (SELECT *, unnest(range(1, len(st) + 1)) AS i FROM s)""")
def text_chunks(v):
    return P.chunk(v("documents"), "text", 1000, 100).select("doc_id", "chunk", "chunk_text")


CUT = "CASE WHEN contains(substr(rest, 1, 800), chr(10)) THEN length(regexp_extract(substr(rest, 1, 800), '(?s)^(.*)\\n', 1)) ELSE 800 END"


@query("text_split", [], f"""
WITH RECURSIVE r AS (
  SELECT doc_id, -1 AS chunk, '' AS chunk_text, text AS rest FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, chunk + 1, CASE WHEN length(rest) <= 800 THEN rest ELSE substr(rest, 1, {CUT}) END,
    CASE WHEN length(rest) <= 800 THEN '' ELSE ltrim(substr(rest, {CUT} + 1), ' \t\n\r') END FROM r WHERE rest <> '')
SELECT doc_id, chunk, chunk_text FROM r WHERE chunk >= 0""")
def text_split(v):
    return P.chunk_at_newline(v("documents"), "text", 800).select("doc_id", "chunk", "chunk_text")


SECRET = "(?i)((?:api[_-]?key|secret|password|passwd|token|credential|auth|private[_-]?key)(?:\\s*[=:]\\s*))(?:bearer\\s+)?(\\S+)"


@query("text_redact", [], f"SELECT doc_id, regexp_replace(text, '{SECRET}', '\\1[REDACTED]', 'g') AS text, source FROM documents")
def text_redact(v):
    return P.redact_all(v("documents").select("doc_id", "text", "source"))


@query("text_spool", [], f"""
WITH c AS (SELECT doc_id, regexp_replace(text, '{SECRET}', '\\1[REDACTED]', 'g') AS text FROM documents)
SELECT 'main' AS part, doc_id, CASE WHEN length(text) > 10000 THEN concat('[SPOOLED: ', length(text), ' chars -> spool/', doc_id, ']') ELSE text END AS text FROM c
UNION ALL SELECT 'side', doc_id, text FROM c WHERE length(text) > 10000""")
def text_spool(v):
    main, side = P.spool_large(v("documents").select("doc_id", "text"), "text", "doc_id", "spool/")
    return main.select(F.lit("main").alias("part"), "doc_id", "text").unionByName(side.select(F.lit("side").alias("part"), "doc_id", "text"))


@query("text_truncate", [], """
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS o FROM documents)
SELECT doc_id, CASE WHEN length(text) > 300 THEN concat(substr(text, 1, 297), '...') ELSE text END AS q,
  array_to_string(list_transform(o, lambda x: CASE WHEN length(x) > 100 THEN concat(substr(x, 1, 97), '...') ELSE x END), '|') AS options FROM s""")
def text_truncate(v):
    polls = v("documents").select("doc_id", F.col("text").alias("q"), F.split("text", "\n").alias("options"))
    return P.truncate_fields(polls).withColumn("options", F.array_join("options", "|"))


@query("art_parse", ["articles_v"], """
SELECT id, CASE WHEN lang = 'de' THEN 'Empty parsed_json content' WHEN lang = 'fr' OR trim(title) = '' THEN 'Missing mandatory JSON fields (title or conclusion)' ELSE 'ok' END AS reason,
  CASE WHEN lang = 'de' THEN '' ELSE trim(title) END AS title, CASE WHEN lang IN ('de', 'fr') THEN '' ELSE source END AS conclusion,
  CASE WHEN lang = 'de' THEN '' WHEN lang = 'en' THEN concat('- ', source, chr(10), '- ', lang) ELSE source END AS summary
FROM (SELECT id, lang, source, regexp_replace(title, '[^a-zA-Z ]', '', 'g') AS title FROM articles_v)""")
def art_parse(v):
    rows = v("articles_v").select("id", "lang", "source", F.regexp_replace("title", "[^a-zA-Z ]", "").alias("t"))
    lang = F.col("lang")
    summary = F.when(lang == "en", F.concat(F.lit('["'), "source", F.lit('", "", "'), "lang", F.lit('"]'))).otherwise(F.concat(F.lit('"'), "source", F.lit('"')))
    conclusion = F.when(lang == "fr", "").otherwise(F.col("source"))
    body = F.concat(F.lit('{"title": " '), "t", F.lit(' ", "conclusion": "'), conclusion, F.lit('", "summary": '), summary, F.lit("}"))
    parsed = P.parse_article(rows.withColumn("parsed_json", F.when(lang == "de", "{}").otherwise(body)))
    return parsed.select("id", F.coalesce("reason", F.lit("ok")).alias("reason"), "title", "conclusion", "summary")
