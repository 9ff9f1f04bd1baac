"""Column rules for URLs, texts and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what replaces them.
PUNCTUATION_FROM = "‑–—‘’“” "
PUNCTUATION_TO = "---''\"\" "

# Letters with a capital of one character where upper case writes two or three.
CAPITALS_FROM = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ"
CAPITALS_TO = "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"

# Openings that only name the source of a statement.
ATTRIBUTIONS = (
    "The article says ", "The article states ", "The article notes ", "The article reports ",
    "The article mentions ", "The writer argues ", "The author argues ", "The author notes ",
    "The author states ", "According to the article, ", "According to the piece, ",
    "According to the report, ", "It reports that ", "It notes that ", "It states that ",
    "The report says ", "The report notes ", "The piece argues ", "The piece notes ",
)

# Names of secrets that are followed by = or :.
SECRET_NAMES = "api[_-]?key|secret|password|passwd|token|credential|auth|private[_-]?key"
SECRET = rf"(?i)((?:{SECRET_NAMES})(?:\s*[=:]\s*))(?:bearer\s+)?(\S+)"
REDACTED = "[REDACTED]"

SPACES = " \t\n\r\f\x0b"


def normalize_url(url: Column) -> Column:
    """Lower case, without query, fragment and slashes at the end."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.lower(F.regexp_replace(bare, r"/+$", ""))


def strip_query(url: Column) -> Column:
    return F.btrim(F.regexp_replace(url, r"\?.*$", ""), F.lit("/"))


def extract_json(text: Column) -> Column:
    """JSON text out of a fenced block or the bare text, commas before a closing bracket removed; ``{}`` if it is not JSON."""
    fenced = F.regexp_extract(text, r"(?si)```(?:json)?\s*(.*?)\s*```", 1)
    has_fence = text.rlike(r"(?si)```(?:json)?\s*.*?\s*```")
    body = F.btrim(F.when(has_fence, fenced).otherwise(text), F.lit(SPACES))
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    parsed = F.to_json(F.try_parse_json(body))
    return F.coalesce(F.when(body != "", parsed), F.lit("{}"))


def extract_tag(text: Column, tag: str) -> Column:
    """Trimmed content of the first such tag, or empty text."""
    return F.btrim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit(SPACES))


def ascii_punct(text: Column) -> Column:
    """Plain dashes, quotes and spaces, trimmed."""
    plain = F.translate(text, PUNCTUATION_FROM, PUNCTUATION_TO)
    return F.btrim(F.replace(plain, F.lit("&nbsp;"), F.lit(" ")), F.lit(SPACES))


def capital(letter: Column) -> Column:
    """One letter's capital letter; a letter whose capitals would be several characters (ŉ, ﬁ) stays."""
    upper = F.upper(letter)
    return F.when(F.length(upper) > 1, F.translate(letter, CAPITALS_FROM, CAPITALS_TO)).otherwise(upper)


def clean_bullet(text: Column) -> Column:
    """Without an opening that names the source, and with a capital letter."""
    bare = F.regexp_replace(text, "(?i)^(?:" + "|".join(ATTRIBUTIONS) + r")\s*", "")
    return F.concat(capital(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare)))


def clean_bullets(bullets: Column) -> Column:
    kept = F.filter(bullets, lambda b: b.isNotNull() & (b != ""))
    return F.transform(kept, clean_bullet)


def redact(text: Column) -> Column:
    """Secrets after a known name and ``=`` or ``:`` are replaced, with a word after ``Bearer`` too.

    The pattern needs one of the two signs, so texts without them are passed on unread.
    """
    signed = text.contains("=") | text.contains(":")
    return F.when(signed, F.regexp_replace(text, SECRET, "$1[REDACTED]")).otherwise(text)


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, with an ellipsis if cut."""
    cut = F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def found_in(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in the text, in their own order."""
    listed = F.array(*[F.lit(p) for p in phrases])
    return F.filter(listed, lambda p: text.contains(p))
