"""Main text: the given pages against their marked article, and pages of other shapes."""

import html
import re

import pytest

from shiftwise.llm import main_text as M
from tests.llm.conftest import SMALL

LONG = "A sentence of the story that is long enough to be told from a menu, with commas and all."


def marked(page):
    """The article of a given page, cut out by its known markup."""
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split("</?(?:p|h1)>", inside)
    lines = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in blocks]
    return "\n\n".join(x for x in lines if x)


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_given_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in M.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = marked(r["html"])
        assert got[r["page_id"]] == (r["url"], want, len(want))


def test_page_without_marks_by_its_lines():
    menu = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(12))
    page = (
        f"<html><body><ul>{menu}</ul><h2>The title</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>"
        f"<ul>{menu}</ul><p><a href='/x'>Imprint</a></p></body></html>"
    )
    assert M.main_text(page) == f"The title\n\n{LONG}\n\nShort one.\n\n{LONG}"


def test_two_passages_and_the_menu_between():
    menu = "".join(f'<div><a href="/{i}">Topic number {i}</a></div>' for i in range(5))
    assert M.main_text(f"<div><p>{LONG}</p></div>{menu}<div><p>{LONG}</p></div>") == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize(
    "part",
    [
        "<header><h1>The site</h1><p>Its motto</p></header>",
        "<nav><ul><li>Home<li>News</ul></nav>",
        "<aside><p>See also</p></aside>",
        '<div class="cookie-notice">We use cookies</div>',
        '<div id="sidebar"><p>Popular</p><div>More</div></div>',
        '<section class="comments"><h2>Comments</h2><article class="comment"><p>First!</p></article></section>',
        "<form><label>Name</label><input name=a><textarea>your words</textarea><button>Send</button></form>",
        "<script>if (a < b) { document.write('<p>no</p>') }</script>",
        "<style>p > a { color: red }</style>",
        "<noscript><p>Turn it on</p></noscript>",
        '<p class="advert">Buy now',
        "<div hidden>unseen</div><div style='display: none'>unseen</div>",
        "<!-- <p>a comment</p> -->",
        "<footer><p>&copy; The site</p></footer>",
        '<div role="navigation">Home</div>',
    ],
)
@pytest.mark.parametrize("box", ["article", "main", 'div class="post-content"', "section"])
def test_other_parts_go(part, box):
    end = box.split()[0]
    inside = part if end != "section" and "header" not in part else ""
    page = f"<body>{part}<{box}><h2>Title</h2><p>{LONG}</p>{inside}<p>{LONG} Again.</p></{end}>{part}</body>"
    assert M.main_text(page) == f"Title\n\n{LONG}\n\n{LONG} Again."


def test_references_space_and_inline_markup():
    page = "<article><p>Fish &amp; chips&nbsp;&#8212; <i>3 &lt; 5</i>,\n\t a<b>b</b>c &am &ampx</p><p> \n</p><p>x<br>y</p><hr>tail</article>"
    assert M.main_text(page) == "Fish & chips — 3 < 5, abc &am &x\n\nx y\n\ntail"


def test_markup_left_open_or_cut_off():
    assert M.main_text(f"<article><p><b>One<br><p>Two<footer>x</article><p>{LONG}") == "One\n\nTwo"
    assert M.main_text(f"<p>{LONG}<div class=ad>buy") == LONG
    assert M.main_text(f'<p>{LONG}</p><a href="x') == LONG
    assert M.main_text(f"<p>{LONG}</p><!-- open <p>y") == LONG
    assert M.main_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


def test_title_above_its_article():
    assert M.main_text(f"<h1>Title</h1><p>By me</p><article><p>{LONG}</p></article>") == f"Title\n\n{LONG}"


def test_short_page_keeps_its_best_passage():
    assert M.main_text("<body><p>Hi.</p></body>") == "Hi."
    assert M.main_text("") == M.main_text(None) == M.main_text("<html></html>") == ""


def test_passages_by_brute_force():
    """Every line lies in a passage if some window around it and no dive parts them."""
    import random

    rnd = random.Random(7)
    for _ in range(300):
        counts = [rnd.choice([0, 0, 0, 5, 40, 90]) for _ in range(rnd.randrange(0, 25))]
        for width in (1, 2, 3, 5):
            runs, own = [], []
            for i, n in enumerate(counts):
                if n:
                    if own and i - own[-1] > width:
                        runs.append(own)
                        own = []
                    own.append(i)
            runs += [own] if own else []
            want = [
                (r[0], r[-1])
                for r in runs
                if max(sum(counts[j] for j in r if i <= j < i + width) for i in range(r[0], r[-1] + 1)) >= 80
            ]
            assert M.passages(counts, width, 80) == want


def test_time_is_linear_on_hostile_pages():
    import time

    for unit in ("<", "<a \"", "<div><p class='ad'>", "</p>", "&amp", "<!--", "<a href='x'>"):
        t = time.perf_counter()
        M.main_text(unit * 20_000 + ">")
        assert time.perf_counter() - t < 5, unit


def test_edge_rows(table):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [
        (1, "u", None, "clash", "x"),
        (None, None, "", None, None),
        (2, None, f"<p>{LONG}", "clash", None),
        (2, None, f"<p>{LONG}", "clash", None),
        (3, "v", "<article>" + "<p>word</p>" * 50_000 + "</article>", None, None),
    ]
    got = sorted(((r[0], r[1], r[3], len(r[2])) for r in M.extract(table(rows, schema)).collect()), key=str)
    size = 6 * 50_000 - 2
    assert got == sorted([(1, "u", 0, 0), (None, None, 0, 0), *[(2, None, len(LONG), len(LONG))] * 2, (3, "v", size, size)], key=str)
    assert M.extract(table([], schema, files=1)).collect() == []
