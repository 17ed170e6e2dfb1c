"""Main text against the pages' own article element, and against hand-made pages."""

import html as entities
import re
import time

from hazardframe.llm import html, queries

DATA = "/root/testdata/sf0.001"


def article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    lines = (" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.QUERIES["op3_main_text"](spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<!doctype html><HTML><head><title>T</title><style>a{}</style></head><body class="has-sidebar">
<div id=top-banner>Sign up now for our weekly letter and more</div>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News of the day</a></ul></nav>
<main><article><header><h1>Head&nbsp;line &amp; more</h1></header>
<p class="lead">First   <em>para</em>graph<br>goes on &lt;here&gt; &eacute;
<p>Second one, with a <a title="x>y" href="?a=1&amp;b=2">link</a>.</p>
<div class="ad-slot"><p>Buy this thing right now, it is very cheap indeed</p></div>
<script>if (a < b) document.write("</p><p>no")</script>
<aside>Side remarks that nobody needs at all</aside>
<form><input name=q><label>Search for words</label></form>
<ul><li>one item</li><li>another item</li></ul>
<table><tr><td>cell</td><td>other</td></tr></table>
<blockquote>Quoted words.</blockquote><p>End.</p></article>
<section class="comments"><p>First! great post, thanks for it, I like it a lot</p></section></main>
<div class="cookie-notice">We use cookies and other things to make this better</div>
<footer>&copy; 2024 some company with a long name and address</footer></body>"""


def test_boilerplate_goes_and_content_stays():
    want = ["Head line & more", "First paragraph goes on <here> é", "Second one, with a link.", "one item", "another item",
            "cell", "other", "Quoted words.", "End."]
    assert html.main_text(PAGE, html.Weights()).split("\n") == want


def test_region_is_the_best_of_all_runs():
    weights = html.Weights()
    found = list(html.tokens(PAGE))
    value = [-weights.cost(t.tag) if t.tag else 0 if t.apart else len(t.text.split()) for t in found]
    best = max(sum(value[i:j]) for i in range(len(value)) for j in range(i, len(value) + 1))
    i, j = html.region(found, weights)
    assert abs(sum(value[i:j]) - best) < 1e-9


def test_odd_pages(spark):
    odd = [None, "", "   ", "plain words only", "<", "a < b and <b>c", "<p", "<!-- never closed <p>x", "</p></div>x", "<p>x</p><p",
           "<script>x", "<div " + "a='" * 3000, "<p>" * 5000 + "deep", "<i>" * 2000 + "x" + "</i>" * 2000, "<nav>only menu</nav>"]
    frame = spark.createDataFrame([(i, "u", p, "t") for i, p in enumerate(odd)] + [(3, None, odd[3], "t")],
                                  "page_id long, url string, html string, text string")
    assert html.learn(frame).of == {}
    got = html.extract(frame, html.Weights()).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(odd) + 1 and texts[0] == texts[1] == texts[2] == "" and texts[3] == "plain words only"
    assert texts[5] == "a < b and c" and texts[8] == "x" and texts[9] == "x" and texts[12] == "deep" and texts[14] == ""
    assert html.extract(frame.limit(0), html.learn(frame.limit(0))).count() == 0


def test_unmarked_page_keeps_its_paragraphs_with_learned_weights(spark):
    weights = html.learn(spark.read.parquet(f"{DATA}/pages.parquet"))
    assert weights.of["page>p"] == weights.of["content>p"] and weights.of["page>h1"] == weights.of["content>h1"]
    lines = ["A head line", "First paragraph of some ten words or so in all.", "Second one is a little longer than the first one was.", "Last."]
    page = "<html><body><nav><a>Home</a></nav><h1>{}</h1><p>{}</p><p>{}</p><p>{}</p></body></html>".format(*lines)
    assert html.main_text(page, weights).split("\n") == lines


def test_many_unmatched_end_tags_take_linear_time():
    page = "<div>" * 100_000 + "</x>" * 100_000 + "<p>words in the end</p>"
    start = time.perf_counter()
    found = [t.text for t in html.tokens(page) if t.text]
    assert found == ["words in the end"] and time.perf_counter() - start < 5
