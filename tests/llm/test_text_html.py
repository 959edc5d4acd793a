import itertools
import random
import time

import pytest

from panelspark.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>Title of all</title><style>p{margin:0}</style></head><body class="has-sidebar">
<header><h1>Site</h1><p>A slogan that is long enough to look like text of an article, really.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now, it is good and cheap.</div>
%s
<form>Name <input name="n"> <button>Send</button></form><script>var t = "</p><p>no</p>"; if (a < b) {}</script>
<footer>&copy; 2020 &middot; Some words here.</footer></body></html>"""
ARTICLE = """<h1>Cats &amp; dogs</h1><p>First  paragraph\n of <b>bold</b>ness &lt;here&gt;.<br>And on.<p>Second &#39;one&#x27;.</p>
<ul><li>item one<li>item two</ul><blockquote>said so</blockquote><table><tr><td>a<td>b</table>"""
TEXT = "Cats & dogs\nFirst paragraph of boldness <here>. And on.\nSecond 'one'.\nitem one\nitem two\nsaid so\na\nb"


@pytest.mark.parametrize("frame", [
    "<article>%s</article>", "<main><div>%s</div></main>", '<div id="wrap"><div class="post-content">%s</div></div>',
    "<article>%s<aside>Related: something that is long enough to count as a text by itself, with a full stop.</aside></article>",
    '<article>%s</article><section class="comments"><p>A reader says many things here that go on and on, as readers do, you know.</p></section>',
    '<div class="sidebar"><p>Many words of the side column that would pass for an article if one looked at nothing but words.</p></div><main>%s</main>',
    '<div role="alert">This site is closed on Mondays, please come again.</div><article>%s<div class="advert">Ad text</div></article>',
    '<div class="cookie-notice"><p>We use cookies for this and that, and more.</p></div><article><header>%s</header></article>',
])
def test_article_without_the_rest(frame):
    assert H.main_text(PAGE % (frame % ARTICLE)) == TEXT


def test_page_without_frames():
    long = "This paragraph has enough words and stops to be seen as content where nothing else in the page says what is what."
    assert H.main_text(f"<nav><a href=x>Home</a></nav><p>{long}</p><p>Short one.</p><p>{long}</p><ul><li><a href=y>Next</a></li></ul>") == \
        f"{long}\nShort one.\n{long}"


@pytest.mark.parametrize("seed", range(40))
def test_cut_is_of_least_cost(seed):
    rng = random.Random(seed)
    for _ in range(30):
        n = rng.randint(1, 8)
        scores = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(a, b, rng.randint(1, 4)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        cost = lambda x: sum(max(s, 0) if not y else max(-s, 0) for s, y in zip(scores, x)) + sum(w for a, b, w in edges if x[a] != x[b])
        assert cost(H.minimum_cut(scores, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_flow_alone_is_of_least_cost():
    rng = random.Random(99)
    for _ in range(200):
        n = rng.randint(2, 7)
        scores = [rng.choice([-5, -3, -1, 0, 1, 3, 5]) for _ in range(n)]
        near = [{} for _ in range(n)]
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                near[a][b] = near[b][a] = rng.randint(1, 4)
        cost = lambda x: sum(max(s, 0) if not y else max(-s, 0) for s, y in zip(scores, x)) + sum(
            w for a in range(n) for b, w in near[a].items() if a < b and x[a] != x[b])
        got = H._source_side(scores, {i: i for i in range(n)}, list(range(n)), near)
        assert cost(got) == min(map(cost, itertools.product([False, True], repeat=n)))


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "</", "<!--", "<!-- a", "<script>x", "<p class='", "&amp", "</p></p></x>", "<a><b><c>", "<p><p><p>"])
def test_broken_pages(html):
    assert "<" not in H.main_text(html)


@pytest.mark.parametrize("inline", ["<span>", "<b><i>", "<p>", "<div>"])
def test_an_end_tag_finds_its_element_at_any_depth(inline):
    """Unclosed elements in a closed menu don't take the article with them."""
    article = "The harvest was late this year, and the mill stood still until the rain had stopped for good."
    page = f"<nav>{(inline + 'Home ') * 700}</nav><article><p>{article}</p></article><aside>{inline * 300}More</aside>"
    assert H.main_text(page) == article


def test_cut_page_keeps_what_is_there():
    whole = H.main_text("<body><article><p>One two three.</p><p>Four five six")
    assert whole == "One two three.\nFour five six"


@pytest.mark.parametrize("unit", ['<p class="', "<div>", "<p>word word</p>", "<", "<!--", "<script>", "</b>", "<b>", "<li><a href=x>a</a>"])
def test_long_pages_take_linear_time(unit):
    began = time.process_time()
    H.main_text(unit * 40_000)
    assert time.process_time() - began < 20


def test_rows(spark):
    long = "<article>" + "<p>word after word.</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE % f"<article>{ARTICLE}</article>"), (1, "u", PAGE % f"<article>{ARTICLE}</article>"), (2, None, None), (None, "v", ""), (3, "w", long)]
    df = spark.createDataFrame([(*r, "mine", "x") for r in rows], "page_id long, url string, html string, text string, _html string").repartition(2)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extracted(df).collect()), key=str)
    want = [(i, u, H.main_text(h)) for i, u, h in rows]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str) and got[0][2] == TEXT
    assert max(r[3] for r in got) == 17 * 20_000 - 1 and H.extracted(df.limit(0)).count() == 0
