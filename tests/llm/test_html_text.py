"""Main text of pages: layouts with known articles, and odd pages."""

import html

import pytest

from quillon.llm import html_text

P = [f"Paragraph {i}, which goes on for a while, with commas, and ends after some {i * 7} words of prose." for i in range(6)]
PROSE = "".join(f"<p>{p}</p>" for p in P)
WANT = " ".join(P)
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
LINKS = '<div><a href="/1">One link here</a> <a href="/2">Another link</a> <a href="/3">And a third</a> <a href="/4">Fourth</a></div>'
COMMENTS = '<div id="comments"><h3>Comments</h3>' + "".join(f"<p>Reader {i} says, at great length, that this is, or is not, so, and so on and on.</p>" for i in range(30)) + "</div>"

LAYOUTS = {
    "article": (f"{NAV}<header><h1>Site</h1></header><article><h1>Title</h1>{PROSE}</article><aside><p>Aside, with, commas</p></aside><footer>&copy; me</footer>", f"Title {WANT}"),
    "div content": (f'{NAV}<div class="cookie-notice"><p>We use cookies, really, do you agree?</p></div><div id="main-content"><h2>Title</h2>{PROSE}</div><div class="sidebar"><p>Side, words</p></div><div id="footer">foot</div>', f"Title {WANT}"),
    "comments outweigh": (f'<div class="post">{PROSE}</div>{COMMENTS}', WANT),
    "comments inside": (f"<article>{PROSE}<section class='comments-area'><article class='comment'><p>Nice, very nice, I like it, much.</p></article></section></article>", WANT),
    "sections": (f"<main><section><h2>A</h2><p>{P[0]}</p><p>{P[1]}</p></section><section><h2>B</h2><p>{P[2]}</p></section></main>{LINKS}", f"A {P[0]} {P[1]} B {P[2]}"),
    "sections in divs": (f"<div><div><h2>A</h2><p>{P[0]}</p><p>{P[1]}</p></div><div><h2>B</h2><p>{P[2]}</p><p>{P[3]}</p></div></div>{LINKS}", f"A {P[0]} {P[1]} B {P[2]} {P[3]}"),
    "tables for layout": (f"<table><tr><td>{LINKS}</td><td><h1>T</h1>{PROSE}</td></tr></table>", f"T {WANT}"),
    "line breaks": (f"<body>{LINKS}<div class=story>{'<br><br>'.join(P)}</div></body>", WANT),
    "inside a form": (f"<form action=x><div id=nav>menu, x</div><h1>T</h1><div>{PROSE}</div><input name=q><button>Go</button></form>", f"T {WANT}"),
    "form in article": (f"<article>{PROSE}<form><p>Sign up, now, please</p><input></form></article>", WANT),
    "adverts between": (f'<article><p>{P[0]}</p><div class="ad-slot">Buy, buy</div><div class="article-share"><a>Share</a></div><p>{P[1]}</p></article>', f"{P[0]} {P[1]}"),
    "unclosed": (f"<ARTICLE><H1>T</h1><p><b>{P[0]}<br><p>{P[1]}<p>{P[2]}", f"T {P[0]} {P[1]} {P[2]}"),
    "lists, quotes, code": (f"<article><p>{P[0]}</p><ul><li>one<li>two</ul><blockquote>said, so</blockquote><pre>a\n  b</pre><table><tr><th>h<td>1</table></article>", f"{P[0]} one two said, so a b h 1"),
    "teasers": (f'<article>{PROSE}</article><article class="teaser"><p>Read, this, too</p></article><article><p>Short</p></article>', WANT),
    "article in the sidebar": (f'<div class="sidebar"><article>{PROSE} x</article></div><div class="entry-header"><h1>T</h1></div><div class="entry"><p>{P[5]}</p></div>', f"T {P[5]}"),
    "hidden": (f'<article>{PROSE}<div hidden>no</div><span style="display: none">no</span><template><p>no</p></template></article>', WANT),
    "frame named like a menu": (f'<div id="header">Site, with, a name</div><div class="menu-page sidebar-left"><article><h1>T</h1>{PROSE}</article></div>', f"T {WANT}"),
    "short": ("<article><p>Few words.</p></article>", "Few words."),
    "links in prose": (f'<article><p>{P[0]} See <a href="x">this</a>, <a href="y">that</a> and <a>more</a>.</p>{PROSE}</article>', f"{P[0]} See this, that and more. {WANT}"),
    "one div": (f"<div>{PROSE}</div>", WANT),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    whole = f'<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body><!-- x -->{page}</body></html>'
    assert html_text.main_text(whole) == html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""), (None, ""), ("plain text,\n of a page", "plain text, of a page"), ("a < b &amp;&lt;p&gt; &copy; &#x41;&#66;&nbsp;c", "a < b &<p> © AB c"), ("<p>in<b>li</b>ne</p><p>next", "inline next"), ("<!-- never closed <p>x", ""),
        ("<script>never closed <p>x", ""), ("<p title='a>b' class=\"x>y\">text", "text"), ("<p", ""), ("</p></div>x", "x"), ("<article></article>", ""), ("<p>a<![CDATA[b]]>", "ab"), ("<" * 50 + "p>x", "<" * 49 + " x"), ("<nav>only</nav>", ""), ("&" * 9, "&" * 9),
    ],
)
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_deep_and_long():
    assert html_text.main_text("<div>" * 30000 + "<p>deep, text</p>") == "deep, text"
    words = "word, " * 200_000
    assert html_text.main_text(f"<article><p>{words}</article>") == words.strip()
    assert html_text.main_text("<a " * 20000 + '"' * 3000) == ""
    assert html_text.main_text('<p a="' * 20000) == ""


def test_extract(spark):
    page = f"<article>{PROSE}&eacute;\U0001f600</article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, None, html.escape("<b>"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    out = sorted(html_text.extract(df).collect(), key=str)
    assert len(out) == 5 and html_text.extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert [(r.text, r.n_chars) for r in out if r.page_id == 1] == [(f"{WANT} é\U0001f600".replace(". é", ".é").replace(".é", ". é"), len(WANT) + 3)] * 2
    assert [(r.url, r.text, r.n_chars) for r in out if r.page_id is None] == [(None, "", 0)]
    assert {r.page_id: r.text for r in out if r.page_id in (2, 3)} == {2: "", 3: "<b>"}
    assert html_text.extract(df.limit(0)).count() == 0
