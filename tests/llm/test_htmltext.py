"""Main text of pages, made up and from the test tables."""

import html
import random
import re
import time

import pytest
from recordlens.llm import htmltext

BODY = ["First block of the article, quite long and plain.", "Then a second one & its <sign>.", "End."]


def page(main, tag="article"):
    inner = "".join(f"<p>{html.escape(b)}</p>" for b in BODY)
    return (
        f"<html><head><title>T</title><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body><header><h2>Site</h2></header>"
        f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad-box'>Buy now</div><!-- <p>no</p> --><{tag}>{inner}{main}</{tag}>"
        f"<div id='comments'><p>Nice post, thank you for it</p></div><aside>Side</aside><form><input>Search</form><footer>&copy; 2024</footer></body></html>"
    )


@pytest.mark.parametrize("tag", ["article", "main"])
def test_article(tag):
    assert htmltext.main_text(page("", tag)) == "\n".join(BODY)


def test_parts_inside_are_dropped():
    extra = "<div class='advert'>Advert <div>nested</div></div><p class='notice'>Notice<p>Last real block.</p><section class='reader-comments'><p>me too</p></section>"
    assert htmltext.main_text(page(extra)) == "\n".join([*BODY, "Last real block."])


def test_without_main_element():
    text = "Plain text of the story goes on. " * 8
    out = htmltext.main_text(f"<body><ul class=menu><li>a<li>b</ul><div class=story><h1>Title</h1><p>{text}<p>Short end.</div><div class=footer>c</div></body>")
    assert out == f"Title\n{text.strip()}\nShort end."


def test_short_block_between_adverts():
    text = "Plain text of the story goes on. " * 4
    out = htmltext.main_text(f"<body class=has-sidebar><div class='post no-sidebar'><p>{text}</p><div class=ad>x</div><p>Short.</p><div class=ad>y</div><p>{text}</p></div></body>")
    assert out == f"{text.strip()}\nShort.\n{text.strip()}"


def test_references_and_space():
    assert htmltext.main_text("<article><p> a&nbsp;b\n\t c &amp;lt; &#233;&eacute;<br>d </p></article>") == "a b c &lt; éé d"


@pytest.mark.parametrize(
    "text, want",
    [(None, ""), ("", ""), ("<p>", ""), ("no markup at all", "no markup at all"), ("<article>open <p>never closed", "open\nnever closed"),
     ("<article><div class=ad>never closed</article>", ""), ("a < b and <b>c</b>", "a < b and c"), ("<script>only", "")],
)
def test_edges(text, want):
    assert htmltext.main_text(text) == want


def test_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        article = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        assert htmltext.main_text(r["html"]) == "\n".join(b for b in blocks if b)


def test_rows(spark):
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, long, "y")], "page_id long, url string, html string, text string")
    found = sorted((len(r["text"]) for r in htmltext.extract_pages(pages).collect()))
    assert found == [0, 0, 50_000 * 5 - 1]
    assert htmltext.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("attributes", ["class='overflow-hidden'", "style='overflow:hidden'", "aria-hidden='false'", "hidden=until-found", "data-class='advert'", "title='a hidden place'"])
def test_parts_that_only_sound_hidden(attributes):
    assert htmltext.main_text(f"<article><p>One.</p><div {attributes}><p>Two.</p></div></article>") == "One.\nTwo."


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "aria-hidden=true", "style='color:red; display : none'", "style=\"display:none !important\"", "class='x advert'", "id=cookie-box"])
def test_hidden_parts(attributes):
    assert htmltext.main_text(f"<article><p>One.</p><div {attributes}><p>Two.</p></div></article>") == "One."


def test_short_areas_that_border_the_article():
    text = "Plain text of the story goes on. " * 20
    out = htmltext.main_text(f"<body><ul class=menu><li>Home</ul><div><h1>Title</h1></div><div><div><p>{text}</p></div></div><div><div><p>End.</p></div></div><div class=ad>x</div><p>Imprint</p></body>")
    assert out == f"Title\n{text.strip()}\nEnd."


def test_main_element_without_the_largest_area():
    text = "Plain text of the story goes on. " * 20
    out = htmltext.main_text(f"<body><div class=story><p>{text}</p><p>More.</p></div><div class=ad>x</div><article><p>A teaser.</p></article></body>")
    assert out == f"{text.strip()}\nMore."


LONG = ("word " * 60).strip()


@pytest.mark.parametrize(
    "source, want",
    [
        ("<script>if(a<!--b){}</script><article>x y</article>", "x y"),
        ("<title>a <!-- b</title><article>x</article>", "x"),
        ("<!--><article>x</article>", "x"),
        ("<!---><article>x</article>", "x"),
        ("<!-- a --!><article>x</article><!-- open <p>y", "x"),
        ("<article>a<![CDATA[ x > y ]]></article>", "a y ]]>"),
        ('<div style="overflow:hidden"><p>text</div>', "text"),
        ('<p title="hidden gem">t</p>', "t"),
        ('<article><p>Go to <a href="/hidden-valley">the valley</a> now</p></article>', "Go to the valley now"),
        ('<article><h2 id="discussion">D</h2><h2 id="search">S</h2><h2 class="section-header">H</h2><p data-id="ad-12">P</p></article>', "D\nS\nH\nP"),
        ('<article><p>A <span class="related">near</span> <em class=notice>by</em></p></article>', "A near by"),
        ("<article><p>Let <math><mi>x</mi></math> be</p></article>", "Let x be"),
        (f"<main><article><p>{LONG}</p></article><article class='teaser'><p>Other story</p></article></main>", LONG),
        (f"<main><h1>Title</h1><article><p>{LONG}</p><div class=ad>x</div><p>End.</p></article></main>", f"Title\n{LONG}\nEnd."),
        (f"<article>A teaser</article><main><p>{LONG}</p></main><article>One more</article>", LONG),
        (f"<form><div><p>{LONG}</p></div></form>", LONG),
        (f"<div class='social-page'><nav>Home</nav><p>{LONG}</p></div>", LONG),
        ("<article><div class=ad/>text</article>", "text"),
        ("<article>a<div class=ad>x<div>y</div></div>b<span hidden>c<b>d</b></span>e</article>", "a\nb\ne"),
        (f"<ul><li><a>Home</a><li><a>News</a></ul><h1><a>Title</a></h1><p>{LONG}</p><ul><li><a>more</a></ul>", f"Title\n{LONG}"),
        ("<table><tr><td class=ad>x<td>y</table>", "y"),
        ("<article>a &lt;b&gt; &amp;amp; c</article>", "a <b> &amp; c"),
    ],
)
def test_no_article_is_lost(source, want):
    assert htmltext.main_text(source) == want


def test_windows_decide(monkeypatch):
    """Without the heights of windows other main elements and stray areas come back."""
    teaser = f"<main><article><p>{LONG}</p></article><article><p>Other story</p></article></main>"
    stray = f"<div class=story><p>{LONG}</p></div><div class=ad>x</div><p>Imprint</p>"
    assert htmltext.main_text(teaser) == htmltext.main_text(stray) == LONG
    real = htmltext.areas
    monkeypatch.setattr(htmltext, "areas", lambda lines: [a._replace(peak=100) for a in real(lines)])
    assert htmltext.main_text(teaser) == f"{LONG}\nOther story" and htmltext.main_text(stray) == f"{LONG}\nImprint"


@pytest.mark.parametrize("piece", ["<article><div class=ad></article>", "<script ", "<div class=ad>", "<a hidden><div>", '<a b="', "<!--", "<b hidden></a>", "<x y='", "<svg><title>"])
def test_linear_in_length(piece):
    began = time.process_time()
    htmltext.main_text(piece * 10_000)
    assert time.process_time() - began < 3  # about half a second; a quadratic reading takes a minute


SENTENCES = [f"Sentence {k} of the article says a good deal about its matter, at some length and without a link." for k in range(8)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in SENTENCES)
TEXT = "\n".join(SENTENCES)
REST = '<div class="footer">Imprint and terms of a long footer that says who made the page, and when it was made, and why.</div>'


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="layout sidebar-right"><article>{PARAGRAPHS}</article></div>{REST}', TEXT),
        (f'<div class="page-with-sidebar"><article>{PARAGRAPHS}</article><div class="sidebar">Links of the side</div></div>{REST}', TEXT),
        (f'<article><div class="article-header"><h1>The Title</h1></div>{PARAGRAPHS}</article>', "The Title\n" + TEXT),
        (f'<article>{PARAGRAPHS}<p class="social-impact">Impact</p><p class="related-work">Work</p></article>', TEXT + "\nImpact\nWork"),
        (f"<h1>Headline</h1><article>{PARAGRAPHS}</article>", "Headline\n" + TEXT),
        (f"<nav>Menu</nav><p>Home</p><h1>Headline</h1><article>{PARAGRAPHS}</article>", "Headline\n" + TEXT),
        (f'<div class="wrapper sticky-header"><div>{PARAGRAPHS}</div><div class="comments">{"<p>A reader says this, and a lot more than that, at length and in anger.</p>" * 9}</div><div class="sidebar">Side</div></div>', TEXT),
        (f'<div class="page-with-sidebar">{PARAGRAPHS}<div class="sidebar">Side</div></div>{REST}', TEXT),
        (f"<article>{PARAGRAPHS}</article><article><h2>Other</h2><p>{'One long sentence that wants to be read on another page of this site. ' * 2}</p></article>", TEXT),
        (f'<article>{PARAGRAPHS}</article><section class="comments"><article class="comment">{PARAGRAPHS}{PARAGRAPHS}</article></section>', TEXT),
        (f'<div class="ad-300x250">{PARAGRAPHS}</div><article>{PARAGRAPHS}</article><div class="related-posts">{PARAGRAPHS}</div>', TEXT),
    ],
)
def test_wrappers_titles_and_teasers(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize("name, mark", [("sidebar-right", "marked"), ("social-impact", ""), ("post-comments", "comments"), ("ad-300x250", "marked"), ("no-sidebar", ""), ("page-with-sidebar", ""), ("comment-form", "comments"), ("related-posts", "marked"), ("headered", ""), ("", "")])
def test_name_marks(name, mark):
    assert htmltext.name_marks(name) == mark


def made_pages():
    """Pages without a main element: which of two stretches of text is the article only their lengths over lines tell."""
    draw = random.Random(4)
    for k in range(60):
        words = lambda n: " ".join(draw.choice(["plain", "words", "of", "some", "length", "here"]) for _ in range(n))  # noqa: E731,B023
        article = [words(draw.randrange(20, 60)) for _ in range(draw.randrange(3, 8))]
        short = [words(draw.randrange(1, 4)) for _ in range(draw.randrange(2, 6))]
        before, after = short[: len(short) // 2], short[len(short) // 2 :]
        gap = '<div class="menu">Menu</div>'
        yield gap.join(["".join(f"<div>{x}</div>" for x in part) for part in (before, article, after)]), "\n".join(article)


def test_windows_decide_on_pages_without_main_elements(monkeypatch):
    pages = list(made_pages())
    assert all(htmltext.main_text(page) == want for page, want in pages)
    monkeypatch.setattr(htmltext, "areas", lambda lines, own=htmltext.areas: [a._replace(peak=1000) for a in own(lines)])
    assert sum(htmltext.main_text(page) != want for page, want in pages) > 50
