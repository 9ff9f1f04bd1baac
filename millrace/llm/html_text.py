"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Tags and class names reject what is menu, advert and the like; they never
accept.  The first pass decides every other block by its length, its link density and its share of stop words (in other
languages, by ends of sentences) and leaves open what these can't tell.  The second pass gives open blocks the label of the
nearest decided neighbour; where a page has an article element, within that.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.chunks import by_volume
from millrace.llm.common import named

# Fixed values.
#: Tags whose content is never text of the page.
_SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button".split())
#: Those whose content no end tag of another element ends, and those that may hold their own kind.
_RAW = frozenset("script style".split())
_NESTED = frozenset("object svg math template audio video canvas".split())
#: Tags that don't end an open head.
_OF_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Tags around what is not the article.
_BOILERPLATE = frozenset("nav footer aside form header menu dialog".split())
#: Tags that begin and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark other than the article.
_HINT = re.compile(
    r"(?:^|[\s_-])(?<!with[_-])(?<!has[_-])(?<!no[_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|"
    r"subscri\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|foot|masthead|site-header|page-header|header|comments?|"
    r"disqus|replies|reply|respond|related|recommend\w*|share|sharing|social|widget|login|search|pagination|pager|toolbar|"
    r"copyright|legal|disclaimer|skip|navigation|complementary|contentinfo|alertdialog)(?=$|[\s_-])", re.I)
#: Those that an article of its own may have and not be the page's article.
_OTHER = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|response|related|recommend\w*|promo\w*|sponsor\w*|ads?|advert\w*|teaser)(?=$|[\s_-])", re.I)
#: Whole classes and roles within an article that are other than the article.
_WITHIN = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscri\w*|nav\w*|"
    r"menu\w*|breadcrumbs?|sidebar\w*|footer|comments?|disqus|replies|reply|respond|related|recommend\w*|share|sharing|widget|"
    r"pagination|pager|toolbar|complementary|contentinfo|alertdialog)", re.I)
#: Those of a container that holds the article where no tag says so.
_CONTENT = re.compile(r"(?:^|[\s_-])(?:content|main|article|post|entry|story|body)(?=$|[\s_-])", re.I)
#: Parts of a name that say nothing by themselves.
_NEUTRAL = re.compile(
    r"\d+|div|box|bars?|blocks?|buttons?|list|links?|items?|cards?|posts?|articles?|entry|story|body|container|wrapper|wrap|inner|section|slot|area|form|signup|icons?|unit", re.I)
#: Whole ids within an article that are other than the article; all other ids may be made from what a heading says.
_OTHER_ID = re.compile(r"(?:^|[\s_-])(?:comments?|replies|related|recommend(?:ed|ations?)|promo|sponsored|ads?|adverts?|teaser)(?=$|[\s_-])", re.I)
#: Stop words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it its not of on or that the this to was were will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour qu que qui sa se ses son sur un "
    "une als am auch auf aus bei das dem den der die ein eine einer er es für hat ich im ist mit nicht nach nur oder sich sie "
    "sind so über um und von war wie wird zu al como con del el era está la las lo los más mi muy no o para pero por quien ser "
    "si sin su sus también todo y ya".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: What ends a tag or begins a value within one.
_END = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Tags of what need not be sentences: code, tables and lists.
_LISTED = frozenset("pre td th li dd".split())
#: The end of a sentence, or a run of a script that marks none.
_SENTENCE = re.compile(r"[.!?\u2026][\"'\u00BB\u201D\u2019)\]]*(?:\s|$)|[\u3002\uFF01\uFF1F\uFF0E\uFF61\u0964\u0965\u061F\u06D4\u0589\u1362\u104B\u17D4\u0F0D]|[\u0E00-\u0EFF]{20}")
#: Letters that say as much as two of others.
_DENSE = re.compile("[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\U00020000-\U0003FFFF]")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")

_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_TITLE_END = re.compile(r"</title(?=[\s/>])[^>]*>", re.I)
_OPENERS = (*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/!?", "")

#: Below this many characters the first pass leaves a block open.
SHORT = 70
MOST_LINKS = 0.33
LEAST_STOP_WORDS = 0.10


#: Links from which a block may be a menu.
MENU_LINKS = 3


class Block(NamedTuple):
    text: str
    linked: int
    links: int
    level: int  # 2 within an article or main element, 1 within what is named as content, else 0
    rejected: bool
    tag: str


class Token(NamedTuple):
    start: int
    end: int
    closing: bool
    tag: str  # empty for comments and declarations
    attrs: str


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Where each sign stands that ends a tag or begins a quoted value, and where a tag ends that reaches it (-1: nowhere).

    A value without a closing quote is no quoted value.  Worked out from the back, so that broken markup is never read twice.
    """
    signs = [(m.start(), m.end(), m.group(1)) for m in _END.finditer(page)]
    starts = [x[0] for x in signs]
    quotes = {q: [m.start() for m in re.finditer(q, page)] for q in "\"'"}
    ends = [-1] * (len(signs) + 1)
    for i in range(len(signs) - 1, -1, -1):
        _, after, quote = signs[i]
        if quote is None:
            ends[i] = after
            continue
        places = quotes[quote]
        at = bisect_left(places, after)
        ends[i] = ends[bisect_left(starts, places[at] + 1)] if at < len(places) else ends[i + 1]
    return starts, ends


def tokens(page: str) -> list[Token]:
    """Tags, comments and declarations of a page in order, those within scripts and styles left out; in linear time."""
    out: list[Token] = []
    starts, ends = _tag_ends(page)
    unclosed: set[str] = set()
    at = 0
    while (m := _OPEN.search(page, at)):
        at = m.end()
        if m.group(1):
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            out.append(Token(m.start(), at, False, "", ""))
            continue
        if m.group(2):
            end = page.find(">", m.end())
            if end >= 0:
                at = end + 1
                out.append(Token(m.start(), at, False, "", ""))
                continue
            break  # nothing ends any more
        end = ends[bisect_left(starts, m.end())]
        if end < 0:
            # All signs from here on stand in quoted values: the first one ends the tag all the same.
            end = page.find(">", m.end()) + 1
            if not end:
                break
        at = end
        tag, attrs = m.group(4).lower(), page[m.end():end - 1]
        out.append(Token(m.start(), end, bool(m.group(3)), tag, attrs))
        if tag in _RAW and not m.group(3) and not attrs.endswith("/") and tag not in unclosed:
            done = _RAW_END[tag].search(page, at)
            if done:
                at = done.start()
            else:
                unclosed.add(tag)
                at = len(page)
    return out


def _ends(tag: str, found: list[Token]) -> dict[int, int]:
    """Where the content of skipped elements ends, by where it starts; elements that are never closed are not listed.

    One that can't hold its own kind and meets it before an end tag was not closed.
    """
    out: dict[int, int] = {}
    opened: list[int] = []
    for t in found:
        if t.tag != tag:
            continue
        if t.closing:
            if opened:
                out[opened.pop()] = t.end
        elif not t.attrs.endswith("/"):
            if tag not in _NESTED:
                opened.clear()
            opened.append(t.end)
    return out


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes of a tag by name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(attrs):
        found.setdefault(name.lower(), a or b or c)
    return found


def _is_hidden(said: dict[str, str]) -> bool:
    if "hidden" in said or said.get("aria-hidden", "").strip().lower() == "true":
        return True
    for rule in said.get("style", "").lower().split(";"):
        name, _, value = rule.partition(":")
        if name.strip() == "display" and value.split("!")[0].strip() == "none":
            return True
    return False


def _whole(hint: re.Pattern, names: str) -> bool:
    """Whether a name as a whole says what the hint says: all of its parts do, but for those that say nothing."""
    for name in names.split():
        parts = [x for x in re.split(r"[_-]+", name) if x and not _NEUTRAL.fullmatch(x)]
        if parts and all(hint.fullmatch(x) for x in parts):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page with their text, linked characters, and what the tags around them say."""
    last = page.rfind("<")
    if last >= 0 and ">" not in page[last:] and page[last + 1:last + 2] in _OPENERS:
        page = page[:last]  # a tag that the page breaks off in
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, level, rejected
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = seen = at = 0
    in_head, untitled = False, False
    ends: dict[str, dict[int, int]] = {}
    found = tokens(page)

    def close() -> None:
        nonlocal linked, seen
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            tag, level, rejected = stack[-1] if stack else ("", 0, False)
            out.append(Block(text, linked, seen, level, rejected, tag))
        parts.clear()
        linked = seen = 0

    for token in [*found, Token(len(page), len(page), False, "", "")]:
        if token.start < at:
            continue  # within what was skipped
        raw = page[at:token.start]
        if raw and in_head and not raw.isspace():
            in_head = False
        if raw and not in_head:
            parts.append(raw)
            if links:
                linked += len(raw.strip())
        at = token.end
        closing, tag, attrs = token.closing, token.tag, token.attrs
        if not tag:
            continue
        if tag == "head":
            close()
            in_head = not closing
            continue
        if in_head and not closing and tag not in _OF_HEAD:
            in_head = False  # a tag of the body ends a head that is not closed
        if tag == "title":
            close()
            if not closing and not untitled:
                done = _TITLE_END.search(page, at)
                untitled = done is None
                at = done.end() if done else at
            if not closing and untitled:
                at = max(page.find("<", at), at)
            continue
        if tag in _RAW and not closing and not attrs.endswith("/"):
            parts.append(" ")
            if tag not in ends:
                ends[tag] = _ends(tag, found)
            at = ends[tag].get(at, len(page))
            continue
        if tag in _SKIPPED and not closing and not attrs.endswith("/"):
            if tag in ("svg", "select", "button", "noscript", "template"):
                close()
            parts.append(" ")
            if tag not in ends:
                ends[tag] = _ends(tag, found)
            at = ends[tag].get(at, at)
            continue
        if tag == "a":
            links = 0 if closing else 1
            seen += links
        if tag == "br":
            parts.append(" ")
        if tag not in _BLOCK:
            continue
        close()
        if tag in _VOID:
            continue
        if closing:
            if open_tags[tag]:
                while True:
                    gone = stack.pop()[0]
                    open_tags[gone] -= 1
                    if gone == tag:
                        break
            links = 0
            continue
        if (tag == "p" or tag in _HEADINGS) and stack and stack[-1][0] == "p":
            open_tags[stack.pop()[0]] -= 1  # an open paragraph ends here
        if tag in ("li", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
            open_tags[stack.pop()[0]] -= 1
        _, level, rejected = stack[-1] if stack else ("", 0, False)
        said = _attributes(attrs) if attrs else {}
        roles, classes, ids = said.get("role", ""), said.get("class", ""), said.get("id", "")
        hints = f"{classes} {ids} {roles}"
        if tag in ("article", "main"):
            named = _whole(_OTHER, f"{classes} {roles}") or _whole(_OTHER_ID, ids)
            level = 2
        elif tag in ("html", "body"):
            named = False
        elif level == 2:
            # The header and the headings of an article are part of it, whatever they are called.
            own = " ".join(c for c in f"{classes} {roles}".split() if not re.fullmatch(r"(?:.*[_-])?header", c, re.I))
            named = (tag in _BOILERPLATE and tag != "header") or _whole(_WITHIN, own) or (tag not in _HEADINGS and _whole(_OTHER_ID, ids))
        else:
            named = tag in _BOILERPLATE or bool(_HINT.search(hints))
            if not level and _CONTENT.search(hints):
                level = 1
        rejected = rejected or named or _is_hidden(said)
        stack.append((tag, level, rejected))
        open_tags[tag] += 1
    close()
    return out


def _size(text: str) -> int:
    return len(text) if len(text) >= SHORT or text.isascii() else len(text) + len(_DENSE.findall(text))


def _stop_words(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _known_language(found: list[Block]) -> bool:
    """Whether the long blocks of a page, links and rejected ones apart, are in a language of the stop words."""
    held = [_stop_words(b.text) for b in found if not b.rejected and len(b.text) >= SHORT and b.linked <= MOST_LINKS * len(b.text)]
    return sum(n for n, _ in held) >= max(1, LEAST_STOP_WORDS * sum(n for _, n in held))


def _first_pass(block: Block, level: int, known: bool) -> bool | None:
    """True or False if the block decides itself, None if it can't tell; `known` if stop words can.

    Links: a block that is links for the most part is a menu, but within an article only one of several links that says
    nothing in sentences.  Length: short blocks can't tell.  Density: long ones need stop words, or where these are of
    another language an end of a sentence; those without are none of the text, but within an article they can't tell.
    """
    if block.rejected or block.level < level:
        return False
    long = _size(block.text) >= SHORT
    stop, words = _stop_words(block.text) if long and known else (0, 0)
    dense = bool(words) and stop >= LEAST_STOP_WORDS * words if known else _SENTENCE.search(block.text) is not None
    if block.linked > MOST_LINKS * len(block.text):
        if not level:
            return False
        return False if long and block.links >= MENU_LINKS and not dense else None
    if not long:
        return None
    if dense or (not level and (block.tag == "pre" or (not known and block.tag in _LISTED))):
        return True
    return None if level or (known and block.tag in _LISTED) else False


def _inherited(found: list[Block], first: list[bool | None], told: list[bool], inside: bool) -> list[bool]:
    """The second pass: labels of all blocks, open ones from the nearest block that is decided and may tell (`told`).

    A heading goes with what it stands above.  Between two that differ and are equally near, and with nobody to ask, a
    block is text within an article and none elsewhere.
    """
    n = len(found)
    before, after = [-1] * n, [-1] * n
    for places, order, step in ((before, range(n), -1), (after, range(n - 1, -1, -1), 1)):
        for i in order:
            j = i + step
            if 0 <= j < n:
                places[i] = j if first[j] is not None and told[j] else places[j]
    out = []
    for i, label in enumerate(first):
        if label is None:
            x, y = before[i], after[i]
            if y >= 0 and found[i].tag in _HEADINGS:
                label = first[y]
            elif x < 0 and y < 0:
                label = inside
            elif x < 0 or y < 0:
                label = first[max(x, y)]
            elif first[x] == first[y]:
                label = first[x]
            else:
                label = inside if i - x == y - i else first[x if i - x < y - i else y]
        out.append(bool(label))
    return out


def main_text(page: str) -> str:
    """The article's blocks in page order, two line feeds between them; empty if there are none."""
    found = blocks(page)
    level = max((b.level for b in found if not b.rejected), default=0)
    known = _known_language([b for b in found if b.level >= level])
    first = [_first_pass(b, level, known) for b in found]
    # What is rejected, or outside, says nothing of the text of an article around or beside it.
    told = [not level or not (b.rejected or b.level < level) for b in found]
    kept = _inherited(found, first, told, level > 0)
    return "\n\n".join(b.text for b, label in zip(found, kept) if label)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """`page_id, url, text` of every row: the main text of the whole page.

    Null or empty pages, and pages without an article, give the empty text.  Broken markup is read as far as it goes: an
    element that is never closed ends with the page, but a head ends where the body begins, and elements whose content is
    not read, scripts and styles apart, lose their tag only.  Repeated rows are read each; other columns are not looked at.
    """
    source = named(pages, page_id=page_id, url=url, content=content)
    types = [source.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, texts = batch.column("content"), []
            for a, b in by_volume(content):
                texts += [main_text(p) if p else "" for p in content.slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return source.mapInArrow(run, f"page_id {types[0]}, url {types[1]}, text string")
