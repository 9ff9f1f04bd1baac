import pytest

from millrace.llm import html_text as h

LONG = "This is what the article says of the matter, and it says it in as many words as it takes to be sure of it."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("body,want", [
    (f"<nav><ul><li><a href='/x'>Home</a></li></ul></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer>",
     f"Head\n\n{LONG}\n\nShort."),
    (f"<div class='ad'>{LONG}</div><article><p>{LONG}<aside>{LONG}</aside><p>a &amp; b &lt;c&gt; &#233;</article>", f"{LONG}\n\na & b <c> é"),
    (f"<article><p><b>{LONG}<br>two\n  lines<p>next</article>", f"{LONG} two lines\n\nnext"),
    (f"<header>Site</header><div id='main-text'><h2>Head</h2><p>{LONG}</p><p>Ok.</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div>",
     f"Head\n\n{LONG}\n\nOk.\n\n{LONG}"),
    (f"<div class='cookie-notice'>{LONG}</div><form><p>{LONG}</p></form><div class='sidebar'><p>{LONG}</p></div>", ""),
    (f"<article><header><h1>Own</h1></header><p>{LONG}</p><section id='comments'><p>{LONG}</p></section></article>", f"Own\n\n{LONG}"),
    (f"<article><p>{LONG}</p><!-- <p>no</p> --><script>if (a < b) {{ }}</script><p>end", f"{LONG}\n\nend"),
    ("", ""), ("<p>", ""), ("<<<>>&amp", ""), ("just text", ""),
    (f"<main><div class='newsletter'>{LONG}</div><ul><li>{LONG}</li><li>{LONG}</li></ul></main>", f"{LONG}\n\n{LONG}"),
    (f"<div class='page with-sidebar'><article><div class='entry-header'><h1>Own</h1></div><p>{LONG}</p><p><a href='/'>a link</a></p>"
     f"<ul><li><a href='/t'>tag</a></li></ul></article><article class='comment'><p>{LONG}</p></article></div>", f"Own\n\n{LONG}\n\na link\n\ntag"),
    ("<div class='menu'>x</div><div id='content'><p>Rhubarb zorgle blent.</p><p>Quux.</p></div><p>All rights kept.</p>", "Rhubarb zorgle blent.\n\nQuux."),
    (f"<div hidden>{LONG}</div><article><p>{LONG}</p></article>", LONG),
])
def test_pages(body, want):
    assert h.main_text(page(body)) == want


@pytest.mark.parametrize("end", ["", "<", "</artic", "<p", "<p class='x", "</p><!-"])
def test_pages_that_break_off(end):
    assert h.main_text(f"<article><p>{LONG}{end}") == LONG


def test_deep_and_long_pages():
    assert h.main_text("<article>" + "<div>" * 5000 + LONG + "</div>" * 5000) == LONG
    assert len(h.main_text("<article><p>" + "word " * 300_000)) == 5 * 300_000 - 1


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>")), (1, "u", page(f"<article><p>{LONG}</p></article>")), (2, None, None),
            (None, "v", ""), (3, "w", "<p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in h.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", LONG), (1, "u", LONG), (2, None, ""), (None, "v", ""), (3, "w", "")], key=repr)
    assert h.extract(pages.limit(0)).count() == 0


def test_query(spark, data_dir):
    from millrace.llm.queries import QUERIES

    rows = QUERIES["op9_html_text"](spark, data_dir).collect()
    assert len(rows) == spark.read.parquet(f"{data_dir}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


BOTH = f"<article><p>{LONG}</p><header>Own</header><p>{LONG}</p></article>"
BOTH_TEXT = f"{LONG}\n\nOwn\n\n{LONG}"


@pytest.mark.parametrize("content,want", [
    (f"<html><head><title>T</title><script>'<p></head>'</script><body>{BOTH}", BOTH_TEXT),
    (f"<html><head><meta charset=x><title>T</title>{BOTH}<script>'</head>'</script>", BOTH_TEXT),
    (f"<head><title>T</head><body>{BOTH}", BOTH_TEXT),
    *[(f"<body><{t} class='x'><article><p>{LONG}</p></article>", LONG) for t in "button select object canvas template noscript iframe svg".split()],
    (f"<body><button>go<article><p>{LONG}</p></article><button>x</button>", LONG),
    (f"<article><p>{LONG}</p><object><object>a</object>b</object><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    (f"<article><p>{LONG}</p><style>p {{}}", LONG),
    (f"<article data-title='The hidden cost of rain'><p>{LONG}</p></article>", LONG),
    (f"<article><div class='block hidden md:block'>{LONG}</div><p title='aria-hidden=true display:none'>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    (f"<article><p>{LONG}</p><p hidden>{LONG}</p><p aria-hidden='true'>{LONG}</p><p style='color:red; display : none !important'>{LONG}</p></article>", LONG),
    (f"<article><section id='legal-status'><h2 id='search'>Search</h2><p class='notice-of-intent'>{LONG}</p></section></article>", f"Search\n\n{LONG}"),
    (f"<article id='response-to-critics' class='post tag-related-work'><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><div class='related-posts'>{LONG}</div><div role='navigation'>{LONG}</div><div id='comments'>{LONG}</div></article>", LONG),
])
def test_text_is_not_dropped_without_need(content, want):
    got = h.main_text(content)
    assert got.replace("go\n\n", "") == want


def test_many_elements_that_are_not_closed():
    assert h.main_text("<article>" + "<svg><button>" * 20_000 + f"<p>{LONG}") == LONG


POLISH = "Rada miasta przyjęła wczoraj nowy budżet. Mieszkańcy czekali na tę decyzję przez wiele miesięcy, lecz nie bez obaw."
CHINESE = "市议会昨天通过了新的预算。居民们为这个决定等待了好几个月，但并非没有担忧，许多人仍然怀疑。"
THAI = "สภาเมืองอนุมัติงบประมาณใหม่เมื่อวานนี้หลังจากประชาชนรอคอยการตัดสินใจมาหลายเดือนแต่ยังคงมีความกังวลอยู่มาก"
CODE = "int x = 0; while (x < 10) { x += step(x); log(x); } return finish(x, LIMIT, FLAGS_DEFAULT, handler);".replace("<", "&lt;")


@pytest.mark.parametrize("body,want", [
    *[(f"<div><h2>{t[:9]}</h2><p>{t}</p><p>{t}</p></div><div class='menu'>{t}</div>", f"{t[:9]}\n\n{t}\n\n{t}") for t in (POLISH, CHINESE, THAI)],
    (f"<pre>{CODE}</pre>", CODE.replace("&lt;", "<")),
    (f"<p>{LONG}</p><pre>{CODE}</pre><p>{LONG}</p>", f"{LONG}\n\n{CODE.replace('&lt;', '<')}\n\n{LONG}"),
    ("<ul><li>" + "Kraków, Łódź, Wrocław, " * 5 + "</li></ul>", ("Kraków, Łódź, Wrocław, " * 5).strip()),
    ("<div>" + "Kraków Łódź Wrocław " * 5 + "</div>", ""),
    (f"<p>{LONG}</p><div>" + "Xylo brint quop. " * 8 + "</div>", LONG),
])
def test_pages_without_containers_in_any_language(body, want):
    assert h.main_text(page(body)) == want


@pytest.mark.parametrize("inside", [
    "<ul><li><a href='/s'>Smith 2019</a></li><li><a href='/t'>Tuor 2020</a></li></ul>", "<dl><dt>Word</dt><dd><a href='/m'>Meaning</a></dd></dl>",
    "<div><a href='/d'>Full data set</a></div>", "<section class='social'>Of social matters</section>", "<p class='legal'>The law</p>",
])
def test_links_and_names_of_an_article_stay(inside):
    import re

    said = [x for x in re.split(r"<[^>]*>", inside) if x]
    assert h.main_text(page(f"<article><p>{LONG}</p>{inside}<p>{LONG}</p></article>")) == "\n\n".join([LONG, *said, LONG])


MENU = "<div>" + " ".join(f"<a href='/{i}'>Topik {i} zarn</a>" for i in range(9)) + "</div>"
PLAIN = "Xylo brint quop marn " * 6


@pytest.mark.parametrize("rule,off,content", [
    ("STOP_WORDS", frozenset(), f"<p>{LONG[:-1]}</p><div>{PLAIN}</div>"),
    ("LEAST_STOP_WORDS", 0.0, f"<p>{LONG}</p><div>{PLAIN}</div>"),
    ("MOST_LINKS", 1.0, f"<p>{LONG}</p><p>{LONG}</p>{MENU.replace('Topik', 'The topic of the')}"),
    ("MOST_LINKS", 1.0, f"<article><p>{LONG}</p>{MENU.replace('Topik', 'This is.')}<h2>Menu</h2>{MENU}</article>"),
    ("MENU_LINKS", 99, f"<article><p>{LONG}</p><h2>Menu</h2>{MENU}</article>"),
    ("SHORT", 10, f"<p>{LONG}</p><p>Xylo brint quop.</p><p>{LONG}</p>"),
])
def test_each_rule_decides(monkeypatch, rule, off, content):
    before = h.main_text(page(content))
    monkeypatch.setattr(h, rule, off)
    assert h.main_text(page(content)) != before


def test_open_blocks_take_the_nearest_label():
    bad, gap = f"<div>{PLAIN}</div>", "<p>x</p>"
    assert h.main_text(page(f"<p>{LONG}</p>{gap}{gap.replace('x', 'y')}{gap.replace('x', 'z')}{bad}")) == f"{LONG}\n\nx"
    assert h.main_text(page(f"<article><p>{LONG}</p><h2>More</h2>{MENU}{gap}</article>")) == LONG


@pytest.mark.parametrize("broken", [
    "<a \"x " * 170_000, "<a t=\"x " * 130_000 + "> \"", "<div>" * 100_000 + "x</p>" * 100_000, "<title>x" * 100_000, "<svg><button>" * 50_000,
    "<!-- <a> " * 100_000, "<script>" * 100_000, "<p '=\"<b ='" * 80_000, "<select \"" * 100_000,
])
def test_broken_pages_take_linear_time(broken):
    import time

    start = time.perf_counter()
    h.main_text(f"<article><p>{LONG}</p>" + broken)
    assert time.perf_counter() - start < 20


def test_values_may_hold_signs_of_tags():
    assert h.main_text(f"<article><p title=\"a > b <i>\" data-x='</p>'>{LONG}</p><p x=\"y>{LONG}</article>") == f"{LONG}\n\n{LONG}"
