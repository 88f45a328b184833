import html
import itertools
import random
import re

import pytest

from scriptoria.llm import html_extract as H
from scriptoria.llm import html_samples as S

PAGE = """<html><body><header class="site-header"><h1>Site</h1></header><div id="cookie-banner">We use cookies.</div><div class="wrap"><div class="menu"><a href=x>Home</a> <a href=y>About</a></div>
<div class="post-content"><h2>Title here</h2><p>First para with <a href=q>a link</a> inside it, and more words.</p><p>Second one &eacute;t&eacute; 5 &lt; 6.</p><ul><li>one item</li><li>two item</li></ul><table><tr><td>a<td>b</table><p class="share">Share this</p><script>var a="<p>no</p>";</script></div>
<div class="comments"><p>Nice article, really nice one indeed.</p></div><aside>Related</aside></div><form><label>Email</label><input name=e><button>Go</button></form><div id=footer>(c) x</div></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "Title here First para with a link inside it, and more words. Second one été 5 < 6. one item two item a b"


def test_odd_pages():
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text(" \n ") == ""
    assert H.main_text("just words here") == "just words here"
    assert H.main_text("<div><p>a <b>b</p><p>c</b> d.</p></div>") == "a b c d."
    assert H.main_text("<nav>x</nav>") == ""
    assert H.main_text("<p>Text that stays, with an unclosed <script>var x = 1;") == "Text that stays, with an unclosed"
    assert H.main_text("<p>open <a href='x>y</p>") in ("open", "open y")
    assert H.main_text("<div>" * 5000 + "<p>Deep text that is still there.</p>") == "Deep text that is still there."


def test_against_the_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extracted(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        m = re.search(r"<article>(.*?)</article>", r.html, re.S)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub("</?(b|i|em|strong|a|span)>", "", m[1]))).split())
        assert got[r.page_id] == (want, len(want))


def test_tables(spark):
    schema = "page_id long, url string, html string, text string, HTML string"
    assert H.extracted(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, "x", "y"), (1, "u", "<p>A whole sentence is here.</p>", None, None), (1, "u", "<p>A whole sentence is here.</p>", None, None)]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in H.extracted(spark.createDataFrame(rows, schema)).collect()) == [(0, "", 0)] + [(1, "A whole sentence is here.", 25)] * 2


def test_cut_is_minimum():
    r = random.Random(0)
    for _ in range(200):
        n = r.randint(1, 7)
        scores = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda side: sum(abs(x) for x, s in zip(scores, side) if (x > 0) != s) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023, E731
        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert abs(cost(H.cut(scores, edges)) - best) < 1e-6


def test_elements_left_open():
    body = "<p>" + "A long sentence of the article that says a thing or two. " * 5 + "</p>"
    want = H.main_text(f"<html><head><title>T</title></head><body>{body}</body></html>")
    assert want
    for page in (f"<html><head><title>T</title><meta charset=utf-8>\n<body>{body}", f"<head><title>T</title>\n{body}", f"<html><head>\n<script>x</script></head><body>{body}"):
        assert H.main_text(page) == want
    for left in ("<button>Go", "<select><option>a<option>b", "<select><optgroup label=x><option>a"):
        assert want in H.main_text(f"<html><head></head><body><div>{left}{body}</div></body></html>")
    assert "Label" not in H.main_text(f"<body><button><div>Label</div></button>{body}</body>")


STORY = """<h1>Title here</h1><p>First paragraph of the story, which has a few words. And more of them.</p><p class="tagline legal">A line below it says more.</p>
<section id="discussion"><h2>Discussion</h2><p>We find that birds build nests in spring. They do so each year.</p></section><ul><li>One more</li></ul><p>Last words.</p>"""
WANT = "Title here First paragraph of the story, which has a few words. And more of them. A line below it says more. Discussion We find that birds build nests in spring. They do so each year. One more Last words."
AROUND = [
    '<div class="sponsored-post"><p>Buy this new thing today, it is great.</p></div>',
    '<div class="cookie-content"><p>We use cookies to make this site better for you.</p></div>',
    '<div class="newsletter-body">Sign up to get all our stories every week.</div>',
    '<div class="modal-text"><p>Please log in to go on reading this story.</p></div>',
    '<form><div><form><label>Mail</label><input></form><p>Tell us your name.</p></div></form>',
    '<div id="main-menu"><a href=a>News</a><a href=b>Sport today</a></div>',
    '<section class="comments"><h3>Two comments</h3><div><p>What a good story this is, thank you all.</p></div></section>',
    '<aside><h3>Related</h3><ul><li><a href=z>Another story</a></li></ul></aside>',
    '<div style="display:none"><p>Nobody sees this sentence at all.</p></div>',
]


@pytest.mark.parametrize("part", AROUND)
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main><div>{}</div></main>", '<div class="post-content">{}</div>', '<div role="main">{}</div>'])
def test_varied_pages(part, shell):
    story = shell.format(STORY)
    for body in (part + story, story + part):
        page = f'<html><head><title>T</title></head><body><div class="site-header"><a href=/>Site</a></div><nav><a href=x>Home</a> <a href=y>About us</a></nav>{body}<footer>(c) Site</footer></body></html>'
        assert H.main_text(page) == WANT


def test_form_around_the_page():
    assert H.main_text(f"<body><form><nav><a href=x>Home</a></nav><article>{STORY}</article><label>Search here</label></form></body>") == WANT


def test_the_cut_changes_labels_and_betters_them():
    m = H.model()
    assert m.smooth > 0
    changed = before = after = total = 0
    for k in range(H.LABELLED + H.TUNING, H.LABELLED + H.TUNING + 400):  # pages that the fit has not seen
        blocks = H.blocks_of(S.page(k))
        alone, together = (H.labels(blocks, H.Model(m.weights, x)) for x in (0.0, m.smooth))
        truth = [S.is_content(b.text) for b in blocks]
        changed += sum(a != b for a, b in zip(alone, together))
        before += sum(a != b for a, b in zip(alone, truth))
        after += sum(a != b for a, b in zip(together, truth))
        total += len(blocks)
    assert changed > 20 and after < before and after < 0.04 * total


def test_end_tags_match_at_any_depth():
    for n in (10, 3000, 20_000):
        page = "<div>" * n + f"<nav><a href=x>Home page</a></nav><article>{STORY}</article>" + "</div>" * n + "<footer>(c) Site</footer>"
        assert H.main_text(page) == WANT
    assert H.main_text("</p></nav></div>" * 5000 + f"<article>{STORY}</article>") == WANT


def test_very_long_pages():
    many = "".join(f"<p>Sentence number {i} of a very long story.</p>" for i in range(20_000))
    text = H.main_text(f"<body><nav><a href=x>Home</a></nav><article>{many}</article></body>")
    assert text.startswith("Sentence number 0 of") and text.endswith("19999 of a very long story.") and text.count("Sentence") == 20_000
    assert len(H.main_text("<p>" + "word " * 500_000 + "</p>")) == 2_499_999
