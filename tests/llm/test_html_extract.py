import html
import re
import time

import pyarrow.parquet as pq
from pyspark.sql import Row

from newsloom.llm.html_extract import SURGE, WINDOW, block_weights, extract, main_text

ARTICLE = "<h1>Title</h1><p>First paragraph, long enough to be a surge, with words and more words.<p>Short.<p><b>Second</b> part&nbsp;is &lt;here&gt;,\n and long&#33; enough too."
EXPECTED = "Title First paragraph, long enough to be a surge, with words and more words. Short. Second part is <here>, and long! enough too."


def page(article):
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>";</script></head><body class="menu-open">
      <div id="header">A site name and its tagline, which is long enough to look like text</div><ul class="main menu"><li><a href="/x?a>b">Home</a><li>Other</ul>
      <!-- <p>not here</p> -->{article}
      <form><p>Write to us, please, at any time of the day or of the night, we read all.</form>
      <aside><p>Around the article there is much text that has nothing to do with it at all.</aside>
      <div class="sidebar"><p class="ad">Buy <b>now<p>A sidebar with enough text to count as a surge by its length alone.</div>
      <div id="comments"><article class="comment"><p>I disagree with this article and with everything that is in it.</article></div>
      <div class="cookieNotice cookie-notice">We use cookies, and they are many, and this is a notice about them.</div><footer>&copy; 2024</footer></body></html>"""


def test_marked_and_unmarked_articles():
    assert main_text(page(f"<article>{ARTICLE}</article>")) == EXPECTED
    assert main_text(page(f"<main><header>{ARTICLE[:14]}</header>{ARTICLE[14:]}</main>")) == EXPECTED
    assert main_text(page(f"<div class='content'>{ARTICLE}</div>")) == EXPECTED
    assert main_text(page(f"<article>{ARTICLE}<div class='ad'>Buy</div><div class='share'>Tell all</div><p>End.</article>")) == EXPECTED + " End."


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<!-- only") == main_text("<p") == ""
    assert main_text("<p>Tiny") == "Tiny"
    assert main_text("<article><p>a &amp b &am") == "a & b &am"
    assert main_text("<p>x</p>" * 50_000).count("x") == 50_000
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


def test_driver_pages(spark):
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        assert main_text(r["html"]) == " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", body).replace("<b>", "").replace("</b>", "")).split())


def test_rows(spark):
    pages = spark.createDataFrame([Row(page_id=1, url="u", html="<p>é x", text="k"), Row(page_id=1, url="u", html="<p>é x", text="k"), Row(page_id=None, url=None, html=None, text="k")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in extract(pages).collect() if r.page_id) == [(1, "u", "é x", 3)] * 2
    assert [tuple(r) for r in extract(pages.filter("page_id is null")).collect()] == [(None, None, "", 0)]
    assert extract(pages.limit(0)).count() == 0


LONG = "A paragraph that is long enough to be a surge, with words and yet more words in it."
LINKS = "<ul><li><a href='/1'>One</a><li><a href='/2'>Two</a><li><a href='/3'>Three</a><li><a href='/4'>Four</a></ul>"


def test_link_lines_of_an_article_stay():
    assert main_text(f"<article><p>{LONG}</p><p><a href='/r'>Read the full report</a></p></article>") == f"{LONG} Read the full report"
    assert main_text(f"<main><p>{LONG}</p>{LINKS}<p>End.</p></main><p>{LONG}") == f"{LONG} One Two Three Four End."
    assert main_text("<article><p><a href='/r'>Only this</a></p></article>") == "Only this"
    assert main_text(f"<div><p>{LONG}</p><p><a href='/r'>Read the full report</a></p></div><div>{LINKS}</div>") == f"{LONG} Read the full report"


def test_short_lines_in_wrappers_of_their_own_stay():
    assert main_text(f"<body><div><h1>Short</h1></div><div><p>{LONG}</p></div></body>") == f"Short {LONG}"
    assert main_text(f"<div><div><p>{LONG}</p></div>\n<div>\n<div>\n<p>Brief.</p>\n</div>\n</div>\n<div>\n<p>{LONG}</p></div></div>") == f"{LONG} Brief. {LONG}"
    assert "Brief." in main_text(f"<div><p>{LONG}</p>{LINKS}<p>Brief.</p>{LINKS}<p>{LONG}</p></div>")
    assert main_text(f"<div>{LINKS}</div><div><h1><a href='/'>Linked</a></h1><p>{LONG}</p></div><div>{LINKS}</div>") == f"Linked {LONG}"


def test_words_do_not_discard_the_article():
    inner = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    text = f"Title {LONG} {LONG}"
    around = f"<div class='sidebar'><p>{LONG}</p></div><div id='comments'>{f'<p>{LONG}</p>' * 9}</div>"
    for name in ("layout has-sidebar", "no-sidebar", "with-comments", "hasSidebar", "post category-social", "search-results", "widget", "comments"):
        assert main_text(f"<div class='{name}'><article>{inner}</article></div>{around}") == text, name
        assert main_text(f"<div id='{name}'>{inner}</div><div class='sidebar'><p>Brief.</p></div>") == text, name
    for name in ("no-sidebar", "post category-social"):
        assert main_text(f"<div class='{name}'><div class='widget'>{inner}</div></div>{around}") == text, name
    assert main_text(f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><div class='ad'>Buy</div></article>") == f"Title {LONG}"
    assert main_text(f"<main class='main sidebar'>{inner}</main>") == text
    assert main_text(f"<main>{inner}<div class='related'><article><p>{LONG * 9}</p></article></div></main>") == text
    assert main_text(f"<div class='widget'><article><p>{LONG}</p></article></div><div class='widget'><article><p>{LONG}</p></article></div>") == f"{LONG} {LONG}"
    assert main_text(f"<p>{LONG}<p>Hello<span class='ad'>Buy</span>, you.") == f"{LONG} Hello, you."


def brute(page):
    """Surges and dives by their definition, over the lines of a page of the driver's kind without marks."""
    for gone in (r"<head>.*?</head>", r"<nav>.*?</nav>", r"<!--.*?-->", r"<div class=.ad.>.*?</div>", r"<footer>.*?</footer>"):
        page = re.sub(gone, "\n", page, flags=re.S)
    told = [" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]+>", "\n", page.replace("<b>", "").replace("</b>", "")).split("\n")]
    told = [x for x in told if x]
    block = [sum(len(x) for x in told[max(0, i - WINDOW // 2) : i + WINDOW // 2 + 1]) for i in range(len(told))]
    return " ".join(told) if any(b >= SURGE for b in block) else None


def test_the_distribution_finds_articles_without_marks():
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    seen = 0
    for r in rows:
        page = re.sub("</?article>", "", r["html"])
        expect = brute(page)
        if expect is not None and len(expect) > 200:
            seen += 1
            assert main_text(page) == main_text(r["html"]) == expect
    assert seen > 150


def test_block_weights():
    weights, borders = [5, 0, 0, 0, 7, 1, 9, 2], [False, False, False, False, False, False, True, False]
    part = [0] * 6 + [1] * 2
    expect = [sum(w for k, w in enumerate(weights) if abs(k - i) <= 1 and part[k] == part[i]) for i in range(8)]
    assert block_weights(weights, borders) == expect and block_weights([], []) == []


def test_marks_are_weights():
    assert main_text(f"<article><p>Teaser.</p></article><div>{f'<p>{LONG}</p>' * 30}</div>") == " ".join(["Teaser.", *[LONG] * 30])
    assert main_text(f"<article><p>{LONG}</p></article><div><p>{LONG}</p></div>") == LONG


def test_wrappers_whose_class_mentions_what_surrounds():
    inner = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    for page in (f'<div class="content no-sidebar">{inner}</div>', f'<main class="layout has-sidebar">{inner}</main>', f'<section class="notice-of-meeting">{inner}</section>', f'<div id="search-engine-article">{inner}</div><p>x'):
        assert main_text(f"<html><body>{page}</body></html>").startswith(f"Title {LONG} {LONG}")


def test_links_above_the_article_do_not_leak():
    for above in ("<div><a href='/'>Home</a></div><div><a href='/a'>About</a></div>", "<ul><li><a href='/'>Home</a><li><a href='/a'>About</a></ul>"):
        assert main_text(f"<body>{above}<div><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG} {LONG}"
    assert main_text(f"<div><h1><a href='/'>Linked</a></h1></div><div><p>{LONG}</p></div>") == f"Linked {LONG}"


def test_unclosed_and_unopened_tags_take_linear_time():
    begin = time.time()
    assert main_text("<b>" * 20_000 + "</i>" * 20_000 + "x") == "x"
    assert main_text("<b><p>" * 20_000 + "y") == "y"
    assert main_text("<div>" * 20_000 + "</p>" * 20_000 + "z") == "z"
    assert time.time() - begin < 3


def test_names_go_by_what_they_say():
    three, four = f"<p>{LONG}</p>" * 3, f"<p>{LONG}</p>" * 4
    for name in ("elementor-widget", "widget"):
        assert main_text(f'<div class="{name}">{three}</div><div class="{name}">{four}</div>') == " ".join([LONG] * 7)
    for inner in ('<div class="menu-recipe">{}</div>', '<section id="search-algorithms">{}</section>', '<div class="social-science">{}</div>', '<div class="comment-policy">{}</div>'):
        assert main_text(f"<article><p>{LONG}</p>{inner.format(three)}<p>End.</p></article>") == " ".join([LONG] * 4 + ["End."])
        assert main_text(f"<div><p>{LONG}</p>{inner.format(three)}<p>End.</p></div>") == " ".join([LONG] * 4 + ["End."])
    assert main_text(f'<article><p>{LONG}</p><p class="comment-policy">Be kind.</p></article>') == f"{LONG} Be kind."
    for name in ("site-header", "mainMenu", "cookieNotice", "ad-300x250", "comment-42", "related-posts", "share_buttons", "sidebar-left"):
        assert main_text(f'<div class="{name}">{four}</div><div><p>{LONG}</p></div>') == LONG, name


def test_a_list_between_paragraphs_stays_whole():
    items = "".join(f"<li><a href='/{k}'>l{k}</a></li>" for k in range(8))
    told = " ".join(f"l{k}" for k in range(8))
    assert main_text(f"<div><p>{LONG}</p><ul>{items}</ul><p>{LONG}</p></div>") == f"{LONG} {told} {LONG}"
    assert main_text(f"<div><p>{LONG}</p>{LINKS}<p>Brief.</p>{LINKS}<p>{LONG}</p></div>") == f"{LONG} One Two Three Four Brief. One Two Three Four {LONG}"
    assert main_text(f"<div><ul>{items}</ul></div><div><p>{LONG}</p></div><div><ul>{items}</ul></div>") == LONG
