import re
import time

import pytest
from gridsift.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="menu-open">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; line</h1><p>First  paragraph,
 with <b>bold</b>&nbsp;text &eacute; &#233;.<br>Second line.<p>Unclosed &lt;paragraph&gt;.<ul><li>one<li>two</ul>
<div class="ad">Buy now, buy now, buy now.</div><form><label>Mail</label><input></form><p>x</p></article>
<aside>Related things to read, many of them.</aside><div id="comments"><p>Nice article, thank you very much, really.</p></div><footer>&copy; Us</footer></body></html>"""


def test_article_only():
    assert html.main_text(PAGE) == "Head & line\nFirst paragraph, with bold text é é. Second line.\nUnclosed <paragraph>.\none\ntwo\nx"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a", "a"), ("<nav>m</nav>", ""), ("<main><p>b</main>", "b"), ("<!-- x --><div><p>c, d.</p><p>e</p></div>", "c, d.\ne"), ("<p>1 < 2", "1 < 2")])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_long_and_deep_pages():
    assert len(html.main_text("<article>" + "<p>some words, here.</p>" * 20000 + "</article>").split("\n")) == 20000
    assert html.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, len(html.main_text(PAGE)))] * 2 + [(2, 0)]
    assert html.extract(df.limit(0)).count() == 0


def paragraphs(name, n, words=25):
    return [" ".join(f"{name}{i}w{k}" for k in range(words)) + ", end." for i in range(n)]


def test_split_articles_and_long_lists_without_article():
    p = lambda texts: "".join(f"<p>{x}</p>" for x in texts)
    nav, foot = '<div class="nav"><a href="/">Home, sweet home, all pages.</a></div>', '<div class="footer"><p>All rights, of all kinds, reserved by all of us.</p></div>'
    a, b, items = paragraphs("a", 13), paragraphs("b", 7), paragraphs("item", 14)
    assert html.main_text(f"<body>{nav}<div>{p(a)}</div><div>{p(b)}</div>{foot}").split("\n") == [*a, *b]
    assert html.main_text(f"<body>{nav}<section>{p(a)}</section><div class='ad'>{p(b)}</div><h2>Next</h2><section>{p(b)}</section>{foot}").split("\n") == [*a, "Next", *b]
    assert html.main_text(f"<body>{nav}<h1>Title</h1><div><p>{a[0]}</p></div><div><div>{p(b)}</div></div>{foot}").split("\n") == ["Title", a[0], *b]
    for open_list, close_list, tag in (("<ul>", "</ul>", "li"), ("<ol>", "</ol>", "li"), ("<table><tbody>", "</tbody></table>", "td")):
        row = lambda x: f"<{tag}>{x}</{tag}>" if tag == "li" else f"<tr><td>{x}</td></tr>"  # noqa: B023, E731
        page = f"<body>{nav}<div><p>Short.</p>{p(b[:6])}{open_list}{''.join(map(row, items))}{close_list}</div>{foot}"
        assert html.main_text(page).split("\n") == ["Short.", *b[:6], *items]


def test_forms_that_frame_a_page():
    a = paragraphs("a", 6)
    body = "".join(f"<p>{x}</p>" for x in a)
    page = f'<body><form id="aspnetForm"><input type="hidden" value="x"><div class="nav"><a href="/">Home, all pages, more.</a></div><div><h1>Head</h1>{body}<label>Mail</label><select><option>one</option></select></div></form>'
    assert html.main_text(page).split("\n") == ["Head", *a]
    assert html.main_text(f"<body><div><h1>Head</h1>{body}<form><p>Write to us, please, at once, all of you.</p><input></form></div>").split("\n") == ["Head", *a]


def test_single_words_of_names_only_weigh():
    a, b = paragraphs("a", 5), paragraphs("b", 4)
    p = lambda texts: "".join(f"<p>{x}</p>" for x in texts)
    for part in ('<div class="social-history"><h2>Next</h2>{}</div>', '<section id="related-work"><h2>Next</h2>{}</section>', '<div class="ad-hoc-groups"><h2>Next</h2>{}</div>'):
        for frame in ("<article>{}</article>", "<div>{}</div>"):
            assert html.main_text("<body>" + frame.format(f"<h1>Head</h1>{p(a)}{part.format(p(b))}")).split("\n") == ["Head", *a, "Next", *b]


@pytest.mark.parametrize("name", ["thread", "comments", "comment-list", "reply_box", "disqus"])
def test_reader_comments_go(name):
    a, b = paragraphs("a", 8), paragraphs("b", 5, 14)
    p = lambda texts: "".join(f"<p>{x}</p>" for x in texts)
    assert html.main_text(f'<body><div><h1>Head</h1>{p(a)}</div><div class="{name}">{p(b)}</div>').split("\n") == ["Head", *a]
    assert html.main_text(f'<body><article><h1>Head</h1>{p(a)}</article><div class="{name}">{p(b)}</div>').split("\n") == ["Head", *a]


def test_time_grows_with_the_page_not_its_square():
    n = 100_000
    for page in ("<div></span>" * n + "deep text", "<p><button>" + "<i>" * n + "<ul></ul>" * n + "x", "<b>" * n + "<p>some text" * n, "<table><td>" * n + "t", "<li>x" * n):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 20


def test_equal_halves():
    """Where no element holds most of the content, that around both counts."""
    a, b = paragraphs("a", 3), paragraphs("b", 3)
    p = lambda texts: "".join(f"<p>{x}</p>" for x in texts)
    assert html.main_text(f"<body><div>{p(a)}</div><div>{p(b)}</div>").split("\n") == [*a, *b]
    assert html.main_text(f"<body><article>{p(a)}</article><article>{p(b)}</article>").split("\n") == [*a, *b]


def test_ratios_decide_without_names(spark):
    """Without article elements, class and id, at least 95 of 100 pages give the text that they give with them."""
    plain = lambda x: re.sub(r' (class|id)="[^"]*"', "", x).replace("<article", "<div").replace("</article>", "</div>")
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert 100 * sum(html.main_text(plain(x)) == html.main_text(x) for x in pages) >= 95 * len(pages)
    assert all("<" not in html.main_text(x) and html.main_text(x) for x in pages)
