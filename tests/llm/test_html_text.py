import html
import random
import re
import time

import numpy as np
import pytest

from orderlens.llm.html_text import extracted, features, grow, is_text, labelled, main_text, blocks_of

PARA = "This is a paragraph of the article with quite a number of words in it, none of which is a link at all."


def page(*before, article, after=()):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6)) + "</ul></nav>"
ARTICLE = f"<article><h1>A title &amp; more</h1><p>{PARA}</p><p>Short.</p><p><b>{PARA}</b> <a href=x>A link</a>, and on.</p></article>"
TEXT = f"A title & more {PARA} Short. {PARA} A link, and on."
OTHERS = [
    "<header><h2>Site of the name</h2><p>A tagline that goes on for rather many words so that length alone can't tell it.</p></header>",
    '<div class="cookie-notice"><p>We use cookies to make everything better for all of you who come here. Accept them all now please.</p></div>',
    f'<div class="sidebar"><p>{PARA}</p><p>{PARA}</p></div>', f"<aside><p>{PARA}</p></aside>", '<div class="ad">Buy this now.</div>',
    f"<form><p>{PARA}</p><input name=q><select><option>One</option></select></form>", f"<!-- <p>{PARA}</p> -->",
    f"<script>var t='<p>{PARA}</p>';</script>", f'<section id="comments"><h3>Comments</h3><p>{PARA}</p></section>',
    f"<footer><p>{PARA}</p></footer>", f'<div style="display: none"><p>{PARA}</p></div>', f"<noscript><p>{PARA}</p></noscript>",
    "<ul><li><a href=1>One thing</a></li><li><a href=2>Another</a></li><li><a href=3>A third thing</a></li></ul>"]


@pytest.mark.parametrize("other", OTHERS)
@pytest.mark.parametrize("place", ["before", "after"])
def test_boilerplate_goes(other, place):
    got = main_text(page(MENU, other, article=ARTICLE) if place == "before" else page(MENU, article=ARTICLE, after=[other]))
    assert got == TEXT


@pytest.mark.parametrize("wrap", ["div", "main", "section", "body"])
def test_without_an_article_element(wrap):
    body = f"<{wrap}><h1>A title</h1>" + f"<p>{PARA}</p>" * 4 + f"</{wrap}>"
    assert main_text(page(MENU, article=body, after=[f"<footer>{PARA}</footer>"])) == " ".join(["A title"] + [PARA] * 4)


def test_white_space_and_references():
    got = main_text("<article><p>a\n\t b&nbsp;c &lt;d&gt; &#233;&#x20AC; &copy &unknown; x<br>y<p>z</article>")
    assert got == "a b c <d> é€ © &unknown; x y z"


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<"), (3, "u", "plain text only, no tags at all, " * 3), (4, "u", "<p"),
             (5, "u", "<article><p>cut off " + PARA), (5, "u", "<article><p>cut off " + PARA), (6, "u", "<script>x"),
             (7, "u", "</p></div></article>" + f"<article>{PARA}</article></nav>"), (8, "u", "<!--" + PARA)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, extracted(df).collect()), key=str)
    assert got == sorted(((i, u, t := main_text(h), len(t)) for i, u, h in pages), key=str)
    by = {r[0]: r[2] for r in got}
    assert by[1] == by[2] == by[4] == by[6] == by[8] == "" and by[5] == "cut off " + PARA and by[7] == PARA
    assert extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<p>", "<a href='x'>w ", "<div class=\"", "<b", "&amp;", "<!-- ", "<script>", "</p>", "word ", "<p attr='"])
def test_long_pages_take_linear_time(unit):
    began = time.time()
    main_text(unit * 40_000)
    assert time.time() - began < 20


def test_whole_table(spark):
    """The tables' pages hold their article in one element, whose blocks end at p, br and h1."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        a = r.html.partition("<article>")[2].partition("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", s)).split()) for s in re.split(r"</?(?:p|br|h1)>", a))
        want[r.page_id] = " ".join(filter(None, blocks))
    got = extracted(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_tree_on_held_out_rows():
    x, y = labelled()
    right = 0
    for k in range(5):
        out = np.arange(len(y)) % 5 == k
        right += (is_text(x[out], grow(x[~out], y[~out])) == y[out]).sum()
    assert right / len(y) >= 0.85


def test_features_of_neighbours():
    f = features(blocks_of("<p>one two</p><a href=x>three</a><p>four</p>"))
    assert f[0][:6].tolist() == [2, 0, 0, 0, 1, 1] and f[2][:6].tolist() == [1, 0, 1, 1, 0, 0]


@pytest.mark.parametrize("start", [
    "<html><head><meta charset=utf-8><body>", "<html><head><title>T</title><body>", "<head><title>Never closed<body>",
    '<body><nav><svg class="icon"/></nav>', '<body><nav><svg class="icon"></nav>', "<body><iframe src=x />", "<body><iframe src=x>",
    '<body><object data="x"/>', "<body><object data=x>", "<body><canvas/>", "<body><canvas>", "<body><math/>", "<body><math>",
    "<body><div><button>Menu</div>", "<body><button>Menu", "<body><select><option>One", "<body><textarea>", "<body><noscript>",
    "<body><template>", "<body><svg><path d=M0/><svg></svg>", "<title-bar>", "<object-list></object-list>"])
@pytest.mark.parametrize("end", ["", "<footer><svg><path/></svg><iframe src=y></iframe><button>Share</button></footer>"])
def test_elements_without_an_end_tag_take_no_text(start, end):
    assert main_text(start + ARTICLE + end) == TEXT


@pytest.mark.parametrize("name", ["template", "svg", "math", "object", "canvas", "select", "button", "title", "textarea", "iframe",
                                  "noscript"])
def test_closed_elements_are_left_out_whole(name):
    assert main_text(f"<body><{name} class=x><p>{PARA}</p><div>{PARA}</{name}>{ARTICLE}") == TEXT


@pytest.mark.parametrize("unit", ["<svg>", "<iframe>", "<title><iframe>", "<button>x<p>", "<b><svg/>", "<svg><b>"])
def test_unclosed_elements_take_linear_time(unit):
    began = time.time()
    main_text(unit * 40_000)
    assert time.time() - began < 20


@pytest.mark.parametrize(("start", "end"), [
    ('<body class="single has-sidebar">', ""), ('<html class="no-sidebar"><body>', ""), ('<body><div class="layout-sidebar-right">', "</div>"),
    ('<body><main class="search-results">', "</main>"), ("<body><form id=aspnetForm>" + MENU, f"</form><footer><p>{PARA}</p></footer>"),
    ('<body><form><div class="page-widget">', f'<section id="comments"><p>{PARA}</p></section></div></form>'),
    ('<body><p class="notice">', ""), ('<body><p class="notice"><b>', ""), ('<body><div data-id="menu" title="a role=search">', "</div>")])
@pytest.mark.parametrize("body", [ARTICLE, ARTICLE.replace("article>", "div>")])
def test_cues_around_the_whole_page(start, end, body):
    assert main_text(start + body + end) == TEXT


def test_comments_that_outweigh_the_article_stay_out():
    article = ARTICLE.replace("article>", "div>")
    assert main_text(page(MENU, article=article, after=['<section id="comments">' + f"<p>{PARA}</p>" * 9 + "</section>"])) == TEXT


def test_a_heading_or_div_ends_an_unclosed_p():
    got = main_text(page(article=f'<p class="notice">Closed on Monday.<h2>A title</h2><div><p>{PARA}</p></div>' + f"<p>{PARA}</p>" * 3))
    assert got == " ".join(["A title"] + [PARA] * 4)


def test_long_text_is_text_in_spite_of_a_cue():
    body = "<h1>A title</h1>" + f"<p>{PARA * 4}</p>" * 4
    assert main_text(page(MENU, article=f"<article>{body}<div class='social-post'>" + f"<p>{PARA * 3}</p>" * 3 + "</div></article>")
                     ).count(PARA) == 25


@pytest.mark.parametrize("words", [1, 5, 20])
@pytest.mark.parametrize("name", ["article", "div"])
def test_short_adverts_between_long_paragraphs_stay_out(words, name):
    ad = f'<div class="ad">{"Buy " * words}</div>'
    assert main_text(f"<{name}><h1>A title</h1><p>{PARA * 5}</p>{ad}<p>{PARA * 7}</p>{ad}<p>{PARA * 3}</p></{name}>"
                     ) == " ".join(["A title", PARA * 5, PARA * 7, PARA * 3])


@pytest.mark.parametrize("start", ["<aside>", '<div style="display: none">', "<footer>", '<div aria-hidden="true">'])
def test_long_text_in_elements_that_hold_none_stays_out(start):
    other = start + f"<p>{PARA * 9}</p>" * 3 + f"</{start[1:].split('>')[0].split()[0]}>"
    assert main_text(page(MENU, other, article=ARTICLE)) == TEXT


@pytest.mark.parametrize("unit", ["<form>x ", "<div class=menu>x ", "<p><b>", "<b><p></p>"])
def test_nested_cues_take_linear_time(unit):
    began = time.time()
    main_text(unit * 20_000)
    assert time.time() - began < 20


@pytest.mark.parametrize("tag", ['<img alt="5" tall">', '<span href="x"">', "<p title=it's>", "<p class=x title=\"a'b\">", "<br data-x='>'>",
                                 '<hr a=b"c>', '<img "quoted" x>', "<span href=x=\"y>", '<p x = "a > b">', "<p =\"x\">", '<p a="1"b=\'2\'">'])
def test_stray_quotes_take_no_text(tag):
    assert main_text(f'<body>{tag}{ARTICLE}<p class="x">') == TEXT
    assert main_text(f"<body><article><h1>A title</h1>{tag}<p>{PARA}</p><p>{PARA} it's \"so\"</p></article>").count(PARA) == 2


def test_tags_end_where_another_reader_ends_them():
    """Start tags and their attributes against the standard library's parser, on random attributes."""
    from html.parser import HTMLParser

    from orderlens.llm.html_text import ATTRIBUTE, tags_of
    rng = random.Random(6)
    for _ in range(500):
        parts = [rng.choice(["a", "b=1", 'c="x > y"', "d='>'", "e='\"'", 'f="\'"', "g=it's", "h = 5", 'i ="z"', "j=x/y", "k=\"\""])
                 for _ in range(rng.randrange(5))]
        page = f"<p {rng.choice([' ', '  ', chr(10)]).join(parts)}>text</p>"
        seen = []
        reader = HTMLParser()
        reader.handle_starttag = lambda tag, attrs: seen.append((tag, attrs))
        reader.feed(page)
        tokens, _ = tags_of(page)
        got = [(n, v[1:-1] if v[:1] in ("'", '"') else v) for n, v in ATTRIBUTE.findall(tokens[0]["attrs"])]
        assert tokens[0].end() == page.index(">text") + 1 and tokens[0]["tag"] == seen[0][0]
        assert got == [(n, v or "") for n, v in seen[0][1]], page


@pytest.mark.parametrize("unit", ['<a b="', "<a b='", "<a b = ", "<a =", '<a "', "<a b=c"])
def test_unclosed_quotes_take_linear_time(unit):
    began = time.time()
    main_text(unit * 50_000)
    assert time.time() - began < 20
