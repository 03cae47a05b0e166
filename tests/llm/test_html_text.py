import html
import re

from storelens.llm.base import table
from storelens.llm.html_text import extract_main_text, main_text
from tests.llm.conftest import as_rows

LONG = "This is a paragraph with quite a few words in it, so that it is dense enough to be read."


def test_given_pages_equal_their_articles(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    assert len(got) == pages.count()
    for p in pages.collect():
        body = p.html.split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip()
                  for b in re.split("</?(?:p|h1)>", body)]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (text, len(text), p.url)


def test_what_is_left_out():
    page = f"""<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
      <header><h1>Site</h1><p>{LONG}</p></header><div class="menu"><a href=x>one</a></div>
      <div id="content"><h2>Head &amp; tail</h2><p>{LONG}</p><!-- <p>gone</p> --><p title="a > b">Second: {LONG}</p>
      <ul><li>first<li>second, {LONG}</ul><form><p>{LONG}</p></form></div>
      <div id="comments"><p>{LONG}</p></div><div class="cookie-notice">{LONG}</div><aside>{LONG}</aside>
      <footer><p>{LONG}</p></footer><p style="display: none">{LONG}</p></body>"""
    assert main_text(page) == "\n\n".join(["Head & tail", LONG, "Second: " + LONG, "first", "second, " + LONG])


def test_sections_beside_each_other_stay():
    page = f"<body><article><h1>A</h1><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG}</p></section></article>"
    assert main_text(page) == "\n\n".join(["A", LONG, LONG, LONG])


def test_broken_markup():
    assert main_text("") == "" and main_text(None) == "" and main_text("<") == "<"
    assert main_text("just text &lt;here&gt;") == "just text <here>"
    assert main_text(f"<p>{LONG}<p>{LONG}<b") == f"{LONG}\n\n{LONG}"
    assert main_text("<script>never ends <p>x</p>") == ""
    assert main_text("<div>" * 3000 + LONG) == LONG
    assert main_text(f"<p>a\n\t b&nbsp;c <i>d</i>e<br>f {LONG}</p>") == f"a b c de f {LONG}"


def test_odd_rows(spark):
    rows = [(1, "u", f"<p>{LONG}"), (1, "u", f"<p>{LONG}"), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "y " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract_main_text(pages)
    assert as_rows(got) == sorted([("1", "u", LONG, str(len(LONG)))] * 2 + [
        ("2", "None", "", "0"), ("None", "v", "", "0"), ("3", "w", ("y " * 200_000).strip(), str(399_999))])
    assert as_rows(extract_main_text(pages.selectExpr("*", "'c' AS text", "1 AS n_chars"))) == as_rows(got)
    assert extract_main_text(pages.limit(0)).count() == 0


def test_marks_are_whole_names():
    body = f"<h1>A</h1><p>{LONG}</p><p {{}}>Second: {LONG}</p><p>{LONG}</p>"
    want = "\n\n".join(["A", LONG, "Second: " + LONG, LONG])
    for attributes in ('title="The hidden costs"', 'data-overflow="hidden"', 'data-id="ad-12"', 'class="legal"',
                       'class="skip"', 'class="ad-free"', "title='display:none'", 'title="it\'s"', 'aria-hidden="false"'):
        assert main_text(f"<body><article>{body.format(attributes)}</article></body>") == want, attributes
    for wrapper in ("content no-sidebar", "has-sidebar", "content-sidebar-wrap", "legal"):
        page = f'<body><div class="{wrapper}"><article>{body.format("")}</article></div></body>'
        assert main_text(page) == want, wrapper
    assert main_text(f'<body><div class="content no-sidebar">{body.format("")}</div></body>') == want
    for link in ('href="/films/hidden-figures"', 'href="/page?id=comments"', 'href=/a?class=ad', 'title="a > hidden"'):
        page = f"<article><p>{LONG} See <a {link}>the film</a> now. {LONG}</p><p>{LONG}</p></article>"
        assert main_text(page) == f"{LONG} See the film now. {LONG}\n\n{LONG}", link
    for mark in ('class="comments"', 'class="post-comments"', "class='x share-buttons'", "id=ad-12", "hidden", "HIDDEN=''",
                 'style="color:red; display : none"', 'aria-hidden=true', 'role="navigation"', 'class="site-footer"'):
        page = f"<body><article>{body.format('')}<div {mark}><p>{LONG} Out.</p></div></article></body>"
        assert main_text(page) == want, mark


def test_the_article_is_never_left_out():
    article = f"<article><h1>A</h1><p>{LONG}</p><p>{LONG}</p></article>"
    want = "\n\n".join(["A", LONG, LONG])
    for opening, closing in (('<form id="page">', "</form>"), ('<div class="overlay">', "</div>"), ('<div id="menu">', "</div>")):
        assert main_text(f"<body>{opening}<nav>{LONG}</nav>{article}{closing}<footer>{LONG}</footer></body>") == want
    # but articles among related texts and comments are not the page's
    for part in ("aside", "section class=related"):
        page = f"<body>{article}<{part}><article><p>{LONG}</p></article></{part.split()[0]}></body>"
        assert main_text(page) == want
    comment = f'<div id="comments"><article class="comment"><p>{LONG * 9}</p></article></div>'
    assert main_text(f"<body>{article}{comment}</body>") == want


def test_self_closed_and_unclosed_drawings():
    for drawing in ('<svg width="5"/>', "<svg class='i' />", "<math/>", "<svg><path d=''/>", '<svg><title>t</title></svg>'):
        page = f"<body><article><h1>A</h1>{drawing}<p>{LONG}</p><p>{LONG}</p></article></body>"
        assert main_text(page).endswith("\n\n".join([LONG, LONG])) and main_text(page).startswith("A"), drawing


def test_nothing_of_the_article_is_dropped():
    blocks = ["<h1>A</h1>", "<p>Yes.</p>", f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>",
              "<section><h2>B</h2><p>Short.</p></section>", "<p>Short end note.</p>",
              '<section><h2>Sources</h2><p><a href="/1">First source</a></p><p><a href="/2">Second source</a></p></section>']
    want = ["A", "Yes.", LONG, LONG, LONG, "B", "Short.", "Short end note.", "Sources", "First source", "Second source"]
    nav = '<nav><ul><li><a href="/">Home</a></li></ul></nav>'
    page = f"<body>{nav}<article>{''.join(blocks)}</article><footer>F</footer></body>"
    assert main_text(page) == "\n\n".join(want)
    assert main_text(page.replace("<article>", "<main><article>").replace("</article>", "</article></main>")) == "\n\n".join(want)


def test_second_article_and_heading_in_main():
    page = (f"<body><main><h1>Title</h1><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article>"
            f"<div><article><p>Shorter.</p></article></div><ul><li><a href=/x>Elsewhere</a></li></ul></main></body>")
    assert main_text(page) == "\n\n".join(["Title", LONG, LONG, LONG, "Shorter."])


def test_container_without_an_article():
    page = (f'<body><div class="top"><a href="/">Home</a></div><div id="content"><h1>Head</h1><div class="text"><p>{LONG}</p>'
            f'<p>{LONG}</p></div><div>Aha.</div><div class="text"><p>{LONG}</p><p>{LONG}</p></div><p>The end.</p></div>'
            f'<div><a href="/a">One</a> <a href="/b">Two</a></div></body>')
    assert main_text(page) == "\n\n".join(["Head", LONG, LONG, "Aha.", LONG, LONG, "The end."])


def test_marks_by_first_or_last_word():
    body = f"<h1>A</h1><p>{LONG}</p><p>{LONG}</p>"
    want = "\n\n".join(["A", LONG, LONG])
    for mark in ("reader-comments", "comment-thread", "sidebar-left", "left-sidebar", "cookie-notice-bottom", "adsbygoogle",
                 "ad-top", "sponsored-content", "site-notice", "share-count", "notice"):
        for key in ("class", "id"):
            part = f'<div {key}="{mark}"><p>{LONG} Out.</p><p>{LONG}</p></div>'
            assert main_text(f"<body><article>{body}{part}</article></body>") == want, mark
            assert main_text(f"<body>{part}<article>{body}</article>{part}</body>") == want, mark
            assert main_text(f'<body><div id="content">{body}</div>{part}</body>') == want, mark
    for name in ("without-comments", "has-ads", "ad-free", "article-header", "no-menu", "legal-history", "content-sidebar-wrap"):
        page = f'<body><article>{body}<div class="{name}"><p>{LONG} In.</p></div></article></body>'
        assert main_text(page) == want + f"\n\n{LONG} In.", name
