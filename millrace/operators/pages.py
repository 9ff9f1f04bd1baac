"""Web pages and texts: links, visible text, verdicts, chunks, redaction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.html import slim_html, split_at_newlines, unescape
from millrace.functions.text import found_in, redact, shorten

_NODE, _BLOCK = "\x01", "\x02"
_EDGES = " \t\n\r\f\x0b                 　\x85\x1c\x1d\x1e\x1f"

# Elements that a reader does not see.
HIDDEN_TAGS = ("script", "style", "noscript", "nav", "header", "footer")


@dataclass(frozen=True)
class Anchor:
    """One way to pick anchors; every given condition must hold."""

    href_prefix: str = ""
    href_contains: str = ""
    attribute: tuple[str, str] | None = None
    css_class: str = ""
    parent_class: str = ""


@dataclass(frozen=True)
class LinkRule:
    """Which anchors of a site lead to articles.  Without ``base`` a page's own host is used."""

    anchors: Sequence[Anchor] = (Anchor(),)
    base: str = ""
    keep: str = ""


# Sites with the anchors that lead to their articles.
SITES = {
    "FT": LinkRule(
        base="https://www.ft.com",
        anchors=(
            Anchor(href_prefix="/content/", attribute=("data-trackable", "heading-link")),
            Anchor(href_prefix="/content/", href_contains="-"),
            Anchor(attribute=("data-trackable", "heading-link")),
            Anchor(href_prefix="/content/", css_class="link"),
            Anchor(css_class="js-teaser-heading-link"),
            Anchor(css_class="o-teaser__heading-link"),
            Anchor(parent_class="o-teaser__heading"),
        ),
        keep="/content/",
    ),
    "Bloomberg": LinkRule(base="https://www.bloomberg.com", anchors=(Anchor(href_prefix="/news/articles/"),)),
    "Technoz": LinkRule(
        base="https://www.bloombergtechnoz.com", anchors=(Anchor(href_contains="detail-"),), keep="detail-news"),
}


@dataclass(frozen=True)
class Wall:
    """Phrases of one kind of wall and how many of them must be seen."""

    phrases: Sequence[str]
    needed: int
    gate_phrases: Sequence[str] = field(default=())


# Phrases of walls, in the order in which they are tried.
WALLS = (
    Wall(("per month", "complete digital access", "cancel anytime", "unlimited access", "subscribe to"), 2),
    Wall(("explore our full range", "keep reading for", "premium access", "subscription required"), 1),
    Wall(
        ("paywall", "premium content", "subscription required", "log in to read", "sign up to continue", "membership required"),
        2, ("log in", "sign up", "continue")),
)

# Phrases of pages that refuse to be read.
BLOCK_PHRASES = (
    "just a moment", "verify you are human", "cloudflare", "ddos protection", "access denied", "checking your browser",
    "please wait", "security check", "enable javascript", "turn off ad blocker", "cookie consent", "access error",
    "potential misuse", "access blocked", "status code: 403", "<debug-panel>",
)
# Sizes and limits.
BLOCK_CHARS = 1000

# Hosts of embedded players.
PLAYERS = ("youtube.com/embed", "youtu.be", "vimeo.com", "dailymotion.com")
# Sizes and limits.
MEDIA_CHARS = 500
POLL_LIMITS = {"q": 300, "options": 100, "exp": 200}
SPOOL_CHARS = 10_000
CHUNK = (25_000, 2_500)


def _attribute(attrs: Column, name: str) -> Column:
    return F.regexp_extract(attrs, rf"""(?i)(?:^|\s){name}\s*=\s*["']([^"']*)["']""", 1)


def _has_class(attrs: Column, name: str) -> Column:
    return F.array_contains(F.split(_attribute(attrs, "class"), r"\s+"), name)


def extract_links(pages: DataFrame, rule: LinkRule = LinkRule(), markup: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Distinct links of each page that the rule picks, relative ones made absolute."""
    anchors = F.regexp_extract_all(F.col(markup), F.lit(r"(?is)<a\s+([^>]*)>"), 1)
    found = pages.select(key, url, F.explode(anchors).alias("_attrs"), F.lit("").alias("_parent"))
    for name in {a.parent_class for a in rule.anchors if a.parent_class}:
        inside = rf"""(?is)<div\s[^>]*class\s*=\s*["'][^"']*(?<![\w-]){name}(?![\w-])[^"']*["'][^>]*>\s*<a\s+([^>]*)>"""
        found = found.unionByName(pages.select(
            key, url, F.explode(F.regexp_extract_all(F.col(markup), F.lit(inside), 1)).alias("_attrs"), F.lit(name).alias("_parent")))
    attrs = F.col("_attrs")
    href = F.replace(_attribute(attrs, "href"), F.lit("&amp;"), F.lit("&"))
    found = found.withColumn("_href", href).filter("_href <> ''")
    picked = F.lit(False)
    for a in rule.anchors:
        one = F.col("_href").startswith(a.href_prefix) & F.col("_href").contains(a.href_contains)
        if a.attribute:
            one = one & (_attribute(attrs, a.attribute[0]) == a.attribute[1])
        if a.css_class:
            one = one & _has_class(attrs, a.css_class)
        if a.parent_class:
            one = one & (F.col("_parent") == a.parent_class)
        picked = picked | one
    host = F.lit(rule.base) if rule.base else F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1)
    link = F.when(F.col("_href").startswith("/"), F.concat(host, "_href")).otherwise(F.col("_href"))
    links = found.filter(picked).select(key, link.alias("link"))
    if rule.keep:
        links = links.filter(F.col("link").contains(rule.keep))
    return links.distinct()


def _without(markup: Column, tags: Sequence[str]) -> Column:
    for tag in tags:
        markup = F.regexp_replace(markup, rf"(?si)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return markup


def visible_text(markup: Column) -> Column:
    """What a reader sees: text between tags, each piece trimmed, joined by spaces, in lower case."""
    bare = _without(markup, HIDDEN_TAGS[:2])
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", "")
    bare = _without(bare, HIDDEN_TAGS[2:])
    plain = unescape(F.regexp_replace(bare, "<[^>]*>", _NODE))
    pieces = F.transform(F.split(plain, _NODE), lambda t: F.btrim(t, F.lit(_EDGES)))
    return F.lower(F.array_join(F.filter(pieces, lambda t: t != ""), " "))


def paywall(pages: DataFrame, walls: Sequence[Wall] = WALLS, text: Column | None = None) -> DataFrame:
    """Whether a page is walled, by which kind, and the phrases seen.  The first wall that holds decides."""
    body = F.col("_text")
    out = pages.withColumn("_text", text if text is not None else visible_text(F.col("html")))
    hits, kind = None, None
    for i, wall in enumerate(walls):
        out = out.withColumn(f"_w{i}", found_in(body, wall.phrases))
        holds = F.size(f"_w{i}") >= wall.needed
        gate = F.lit(False)
        for p in wall.gate_phrases:
            gate = gate | body.contains(p)
        name = F.when(gate, "gatekeeper").otherwise("paywall")
        hits = F.when(holds, F.col(f"_w{i}")) if hits is None else hits.when(holds, F.col(f"_w{i}"))
        kind = F.when(holds, name) if kind is None else kind.when(holds, name)
    return (
        out.withColumn("blocker_type", kind)
        .withColumn("is_paywalled", F.col("blocker_type").isNotNull())
        .withColumn("indicators", F.coalesce(hits, F.array().cast("array<string>")))
        .drop("_text", *[f"_w{i}" for i in range(len(walls))])
    )


def is_blocked(markup: Column, phrases: Sequence[str] = BLOCK_PHRASES) -> Column:
    """Empty, very short, or with a phrase of a refusing page."""
    low = F.lower(markup)
    named = F.lit(False)
    for p in phrases:
        named = named | low.contains(p)
    return markup.isNull() | (F.length(F.btrim(markup, F.lit(_EDGES))) < BLOCK_CHARS) | named


def paragraph_chars(markup: Column) -> Column:
    """Characters of paragraph text, pieces trimmed, paragraphs joined by one space."""
    parts = F.split(markup, r"(?i)<p\b[^>]*>")
    bodies = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.regexp_replace(p, r"(?si)</p\s*>.*$", ""))
    nodes = F.transform(bodies, lambda p: F.regexp_replace(p, "<[^>]*>", _NODE))
    plain = unescape(F.array_join(nodes, _BLOCK))
    trimmed = F.transform(F.split(plain, f"[{_NODE}{_BLOCK}]"), lambda t: F.length(F.btrim(t, F.lit(_EDGES))))
    total = F.aggregate(trimmed, F.lit(0), lambda a, x: a + x)
    return total + F.greatest(F.size(bodies) - 1, F.lit(0))


def is_media_only(markup: Column) -> Column:
    """A page with a player and little paragraph text."""
    sources = F.regexp_extract_all(markup, F.lit(r"""(?is)<iframe\s[^>]*src\s*=\s*["']([^"']*)["']"""), 1)
    embedded = F.exists(sources, lambda s: s.rlike("|".join(p.replace(".", r"\.") for p in PLAYERS)))
    player = markup.rlike(r"(?i)<(video|audio)[\s>/]") | embedded
    return F.coalesce(player & (paragraph_chars(markup) < MEDIA_CHARS), F.lit(False))


def slim(pages: DataFrame, limit: int | None = None, markup: str = "html", extra: Sequence[str] = ()) -> DataFrame:
    return pages.withColumn("slim", slim_html(F.col(markup), limit, extra))


def chunk(df: DataFrame, text: str, size: int = CHUNK[0], overlap: int = CHUNK[1]) -> DataFrame:
    """Overlapping pieces of the whole text; a text no longer than ``size`` is one piece."""
    n, step = F.length(text), size - overlap
    starts = F.array(F.lit(0)) if step <= 0 else F.sequence(F.lit(0), n - 1, F.lit(step))
    places = F.when(n <= size, F.array(F.lit(0))).otherwise(starts)
    rows = df.filter(n > 0).select("*", F.posexplode(places).alias("chunk", "_from"))
    return rows.withColumn("chunk_text", F.substring(F.col(text), F.col("_from") + 1, F.lit(size))).drop("_from")


def chunk_at_newline(df: DataFrame, text: str, limit: int) -> DataFrame:
    """Pieces of at most ``limit`` characters, cut at newlines where there are any."""
    return df.select("*", F.posexplode(split_at_newlines(F.col(text), limit)).alias("chunk", "chunk_text"))


def redact_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Secrets removed from the given columns, or from every text column; works on streams too."""
    chosen = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: redact(F.col(c)) for c in chosen})


def spool_large(df: DataFrame, column: str, key: str, folder: str, n: int = SPOOL_CHARS) -> tuple[DataFrame, DataFrame]:
    """Rows with redacted text or a pointer to it, and the long texts by key for the side table."""
    clean = df.withColumn(column, redact(F.col(column)))
    safe = F.regexp_replace(F.col(key).cast("string"), "[^A-Za-z0-9_-]", "_")
    size = F.length(column)
    pointer = F.concat(F.lit("[SPOOLED: "), size.cast("string"), F.lit(f" chars -> {folder.rstrip('/')}/"), safe, F.lit("]"))
    main = clean.withColumn(column, F.when(size > n, pointer).otherwise(F.col(column)))
    return main, clean.filter(size > n).select(key, safe.alias("spool_name"), column)


def truncate_fields(df: DataFrame, limits: dict[str, int] = POLL_LIMITS) -> DataFrame:
    """Texts, and texts in arrays, cut to their limit with an ellipsis."""
    def cut(name: str, limit: int) -> Column:
        if isinstance(df.schema[name].dataType, T.ArrayType):
            return F.transform(F.col(name), lambda x: shorten(x, limit))
        return shorten(F.col(name), limit)

    return df.withColumns({name: cut(name, limit) for name, limit in limits.items() if name in df.columns})


def parse_article(df: DataFrame, column: str = "parsed_json") -> DataFrame:
    """Title, conclusion and bulleted summary out of JSON text, or FAILED with a reason."""
    v = F.try_parse_json(F.col(column))
    opened = df.withColumns({
        "title": F.btrim(F.coalesce(F.try_variant_get(v, "$.title", "string"), F.lit("")), F.lit(_EDGES)),
        "conclusion": F.btrim(F.coalesce(F.try_variant_get(v, "$.conclusion", "string"), F.lit("")), F.lit(_EDGES)),
        "_list": F.try_variant_get(v, "$.summary", "array<string>"),
        "_text": F.btrim(F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit("")), F.lit(_EDGES)),
        "_empty": F.coalesce(F.regexp_replace(F.col(column), r"\s", "").isin("", "{}", "null"), F.lit(True)),
    })
    bullets = F.transform(F.filter("_list", lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(F.lit("- "), x))
    missing = (F.col("title") == "") | (F.col("conclusion") == "")
    reason = F.when(F.col("_empty"), "Empty parsed_json content").when(missing, "Missing mandatory JSON fields (title or conclusion)")
    return (
        opened.withColumn("summary", F.when(F.col("_list").isNotNull(), F.array_join(bullets, "\n")).otherwise(F.col("_text")))
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "SUCCESS").otherwise("FAILED"))
        .drop("_list", "_text", "_empty")
    )
