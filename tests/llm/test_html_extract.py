import pytest
from tabwatch.llm import html_extract as H

PAGES = [
    ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy this now, it is really cheap and good for you</div><article><h1>A &amp; B</h1><p><b>First   line<br>of\ntext<br><p>Second.</article><footer>&copy; x</footer>", "A & B\n\nFirst line of text\n\nSecond."),
    ("<body><div id=wrap><div class=header>Site</div><ul class=menu><li><a href=x>Home</a></ul><div class=content><h1>Title</h1><p>Para one with quite some words in it, really.<p>Para two &amp; more.</div><div class=sidebar>links</div><div id=comments><p>nice post, I love it and would read more of it</div></div><div class=footer>c</div>", "Title\n\nPara one with quite some words in it, really.\n\nPara two & more."),
    ("<main><article><header><h1>T</h1><span class=byline>By x</span></header><p>a b c d e f g</p><aside>pull</aside><form>x<input></form><section class='comments'><article class='comment'>hey there</article></section></article></main>", "T\n\na b c d e f g"),
    ("plain text only", "plain text only"), ("", ""), ("<p>", ""), ("<div hidden>x</div><p>visible text here</p>", "visible text here"),
    ("<article><p>x &lt;tag&gt; &#233;&nbsp;y</p><div class='cookie-notice'>We use cookies</div><style>p{}</style><!-- c --></article>", "x <tag> é y"),
    ("<article>one<ul><li>two<li>three</ul></b>four</article>", "one\n\ntwo\n\nthree\n\nfour"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert H.extract(html) == text


LONG = "A long paragraph of the text, with many words in it and no tags at all inside. " * 6


@pytest.mark.parametrize("html, lost", [
    (f"<body><div class=content><h1>Title</h1><div class=body><p>{LONG}<p>{LONG}<p>{LONG}</div></div>", "Title"),
    (f"<body><div><h1>Title</h1></div><div><p>{LONG}<p>{LONG}<p>{LONG}<p>{LONG}<p>{LONG}<p>{LONG}<p>{LONG}</div>", "Title"),
    (f"<body><div><section><p>{LONG * 9}<p>{LONG * 9}</section><section><h2>More</h2><p>Other things are said here. {LONG}</section></div>", "Other things are said here."),
])
def test_no_part_of_the_text_is_lost_beside_the_largest(html, lost):
    got = H.extract(html + "<div class=menu><a href=x>Home</a></div>")
    assert lost in got and LONG.strip() in got and "Home" not in got


@pytest.mark.parametrize("part, kept", [
    (f"<section id=discussion><h2>Discussion</h2><p>Here we discuss. {LONG}</section>", ["Discussion", "Here we discuss."]),
    ("<h2 id=related-work>Related work</h2>", ["Related work"]), ("<h3 class=related>Related work</h3>", ["Related work"]),
    (f"<div class=section id=comments-on-x><p>On x. {LONG}</div>", ["On x."]), (f"<div class=social><p>Social life. {LONG}</div>", ["Social life."]),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>27</mn></math> holds.", ["So x=27 holds."]),
    ("<div class=related><ul><li><a href=a>Also read</a><li><a href=b>And this</a></ul></div>", []),
    ("<div class=share><a href=a>Send</a> <a href=b>Post</a></div>", []), (f"<div class=comments><p>Nice. {LONG}</div>", []),
    (f"<div class=social><p>Social life. {LONG}<div class=ad>Buy <a href=x>now</a></div><div class=share><a href=a>Send</a></div></div>", ["Social life."]),
])
def test_ordinary_words_in_class_and_id(part, kept):
    lines = [f"{LONG}First.", f"{LONG}Last."]
    for page in (f"<body><article>{{}}</article><footer>c</footer>", "<body><div>{}</div>"):
        got = H.extract(page.format(f"<p>{lines[0]}</p>{part}<p>{lines[1]}</p>")).split("\n\n")
        assert [g for g in got if g not in lines] == [g for g in got if any(g.startswith(k) for k in kept)] and len(got) == 2 + len(kept)


def test_articles_with_marks_in_their_ids():
    assert H.extract(f"<article id=comments-on-x><p>{LONG}</article>") == LONG.strip() == H.extract(f"<body id=search><p>{LONG}")


@pytest.mark.parametrize("wrap", ["<body>{}", "<body><main>{}</main>", "<body><div><div>{}</div></div>", "<body><form id=page><main>{}</main></form>"])
def test_sibling_articles_stay_together(wrap):
    two = f"<article><h1>One</h1><p>First. {LONG}</article><div class=ad>Buy</div><article><h1>Two</h1><p>Second. {LONG * 5}</article>"
    got = H.extract("<nav><a href=x>Home</a></nav>" + wrap.format(two) + "<footer>c</footer>").split("\n\n")
    assert got == ["One", f"First. {LONG}".strip(), "Two", f"Second. {LONG * 5}".strip()]


@pytest.mark.parametrize("box", ["<p class=notice>We change our terms soon.</p>", "<p class=promo>Buy two and pay for one only today.</p>", "<div class=share>Tell your friends</div>", "<div class='cookie-banner'>We use cookies, see below for all of them</div>", "<section class=newsletter><h2>Stay</h2><p>Letters every week for you</section>"])
def test_notices_and_adverts_in_an_article_go(box):
    for page in ("<body><article><h1>T</h1><p>{}</p>{}<p>End.</article>", "<body><div><h1>T</h1><p>{}</p>{}<p>End.</div>"):
        assert H.extract(page.format(LONG, box)) == f"T\n\n{LONG.strip()}\n\nEnd."


@pytest.mark.parametrize("tag", ["nav", "aside", "footer", "menu"])
def test_what_is_never_closed_does_not_swallow_the_article(tag):
    assert H.extract(f"<body><{tag}><a href=x>Home</a><article><p>{LONG}</article>") == LONG.strip()
    closed = H.extract(f"<body><{tag}><article><p>Card text. {LONG}</article></{tag}><article><p>{LONG}</article>")
    assert closed == LONG.strip()


def test_smoothing_keeps_mass_and_order():
    import numpy as np

    x = np.array([0.0, 0, 0, 10, 0, 0, 0])
    y = H.smooth(x)
    assert abs(y.sum() - 10) < 1e-9 and y.argmax() == 3 and y[2] > y[1] > y[0]


def test_tables(spark):
    rows = [(i, f"u{i}", h, "clash", 1) for i, (h, _) in enumerate(PAGES)] + [(50, None, None, "c", 2), (None, "u", "<p>" + "long words " * 50_000, "c", 3), (3, "u3", "plain text only", "c", 4)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert [(r.page_id, r.url) for r in got] == [(r[0], r[1]) for r in rows]
    assert [r.text for r in got][: len(PAGES)] == [t for _, t in PAGES] and got[len(PAGES)].text == ""
    assert all(r.n_chars == len(r.text) for r in got) and got[-2].n_chars == len("long words " * 50_000) - 1
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_planted_articles_come_back(spark):
    """Articles of the given pages, rebuilt from their own markup."""
    import html as escape
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in H.extract_pages(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(escape.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert found[r.page_id] == "\n\n".join(b for b in blocks if b)
