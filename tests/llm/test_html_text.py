import pytest

from gleaner.llm import html_text
from gleaner.llm.html_text import main_text

LONG = "This sentence, one of several, is long enough to count as running text of an article, surely."

PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>no";</script></head>
<body class="page has-sidebar"><header><h1>Site name</h1><p>{LONG}</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>{LONG}</p></div><!-- <p>comment</p> -->
<div id="wrap"><article><header><h1>Title &amp; more</h1></header>
<p>First,&nbsp;  one &lt;tag&gt; &#8364;<br>same block.<p>Second {LONG}
<ul><li>item one<li>item <b>two</b></ul><div class="ad">{LONG}</div><blockquote>Quoted</blockquote>
<p hidden>{LONG}</p><p style="display: none">{LONG}</p><form><p>{LONG}</p></form>
<table><tr><td>cell 1<td>cell 2</table><pre>x
 y</pre></article>
<div id="sidebar"><p>{LONG}</p><p>{LONG}</p></div>
<section class="comments"><article class="comment"><p>{LONG} {LONG}</p></article></section></div>
<aside><p>{LONG}</p></aside><footer>&copy; end</footer></body></html>"""


def test_article_without_clutter():
    assert main_text(PAGE).split("\n") == [
        "Title & more",
        "First, one <tag> € same block.",
        f"Second {LONG}",
        "item one",
        "item two",
        "Quoted",
        "cell 1",
        "cell 2",
        "x y",
    ]


def test_best_container_and_its_siblings():
    page = f"""<div class="top"><a href="/">Home</a> <a href="/x">Other</a></div>
    <div><h2>Story</h2><div class="part"><p>{LONG}</p><p>{LONG} Again.</p></div>
    <div class="part"><p>{LONG} Twice.</p></div><div class="links"><a href="/1">one</a><a href="/2">two</a></div>
    <p>Short end.</p></div>"""
    assert main_text(page).split("\n") == ["Story", LONG, f"{LONG} Again.", f"{LONG} Twice.", "Short end."]


PARTS = [
    "<section><h2>Result</h2><p>Good.</p></section>",
    "<div>Closing words</div>",
    "<p>Yes, indeed</p>",
    "<ul><li>one</li><li>two</li></ul>",
    "<blockquote>Quoted</blockquote>",
    "<pre>code here</pre>",
    "loose text",
    '<p class="market-share">Shares rose</p>',
    '<p class="notice-period">Two weeks</p>',
    '<div class="article-header"><p>The lead paragraph</p></div>',
    '<div class="related-work"><p>Earlier work, see <a href="/x">there</a> and more.</p></div>',
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="story">{}</div>', "{}"])
@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("part", PARTS)
def test_short_parts_beside_a_long_one_stay(wrap, tag, part):
    if "related" in part and "article" not in wrap and "main" not in wrap:
        pytest.skip("outside an article a container's name decides")
    import re

    body = f"<{tag}><p>{LONG}</p><p>{LONG} Again.</p></{tag}>"
    menu = '<nav><a href="/">Home</a></nav><div class="links"><a href="/1">one</a> <a href="/2">two</a></div>'
    text = " ".join(re.sub(r"<[^>]+>", " ", part).split())
    found = main_text(f"<html><body>{menu}{wrap.format(body + part)}</body></html>")
    assert " ".join(found.split()) == f"{LONG} {LONG} Again. {text}"
    found = main_text(f"<html><body>{menu}{wrap.format(part + body)}</body></html>")
    assert " ".join(found.split()) == f"{text} {LONG} {LONG} Again."


@pytest.mark.parametrize("clutter", [
    '<div class="social-share">Tell others</div>',
    '<p class="ad">Buy this now</p>',
    '<div class="related-stories"><a href="/1">A story</a> <a href="/2">Another story</a></div>',
    '<div id="newsletter"><p>Subscribe, it is free.</p></div>',
    '<section class="comments"><p>First, I agree.</p></section>',
])
def test_clutter_inside_an_article_goes(clutter):
    assert main_text(f"<article><p>{LONG}</p>{clutter}<p>{LONG} End.</p></article>") == f"{LONG}\n{LONG} End."


@pytest.mark.parametrize("html, text", [
    (None, ""),
    ("", ""),
    ("<nav>menu</nav>", ""),
    ("only text", "only text"),
    ("<p>a<p>b", "a\nb"),
    ("<p>cut off &amp", "cut off &"),
    ("<p>cut off</p><p cla", "cut off"),
    ("<p>one</b></i></div> still</p>", "one still"),
    ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
    ("<article><h1>Head</h1><p>x</p></article>", "Head\nx"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ("<script>if (a<b) { '<p>x</p>' }", ""),
])
def test_odd_pages(html, text):
    assert main_text(html) == text


def test_long_page():
    page = "<article>" + "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(20_000)) + "</article>"
    assert main_text(page).count("\n") == 19_999


def test_table(spark):
    schema = "page_id long, url string, html string, text string, N_CHARS int"
    rows = [(1, "u", PAGE, "old", 1), (1, "u", PAGE, "old", 1), (None, None, None, None, None), (2, "", "", "", 0)]
    out = html_text.extract(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in out.collect()))
    text = main_text(PAGE)
    assert got == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0)]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_generated_pages_keep_their_article(spark):
    """The test pages have one article each: all of its blocks come back, and nothing else."""
    import html
    import re

    for page in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        begin, end = page.html.index("<article>") + 9, page.html.find("</article>")
        body = re.sub(r"<[^>]*$", "", page.html[begin : end if end >= 0 else None])
        blocks = re.split(r"</?(?:p|h1)>", body)
        texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks]
        assert main_text(page.html) == "\n".join(t for t in texts if t)
