"""HTML extraction on whole tables, hand-written pages, and cuts by brute force."""

import html
import itertools
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import html_extraction as H
from tests.llm import labelled_pages


def article(page):
    """The article element, for pages whose text lies in one: blocks end at h1 and p tags."""
    inner = page.split("<article>")[1].split("</article>")[0]
    parts = [re.sub(r"<[^>]+>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:h1|p)>", inner)]
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_all_pages_of_a_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = H.op6_html_extraction(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T</title><script>if (a < b) { x = "</p>" }</script></head><body class="page">
<header><a href=/>Site</a></header><nav><ul><li><a>One<li><a>Two</ul></nav>
<div id="cookie-notice">We use cookies. Accept them, please, all of them.</div>
<main><h1>A title &amp; more</h1><div class=post-body><p>First   paragraph,\nwith <a href='x>y'>a link</a> and <b>bold</b> text.<p>Short.
<ul><li>item one<li>item two</ul><table><tr><td>cell a<td>cell b</table>
<div class="ad-slot"><p>Buy this now. It is cheap, and good.</p></div><form><label>Name</label><input></form>
<p>Last&nbsp;one: 1 &lt; 2 &#233;.</div>
<section id="comments"><h2>Comments</h2><p>A reader wrote a long comment here, with marks, and so on.</p></section></main>
<aside><p>Something else, long enough to look like text. Really.</p></aside><footer>&copy; us</footer>"""


def test_a_page_with_everything():
    assert H.main_text(PAGE).split("\n") == [
        "A title & more",
        "First paragraph, with a link and bold text.",
        "Short.",
        "item one",
        "item two",
        "cell a",
        "cell b",
        "Last one: 1 < 2 é.",
    ]


def test_edges(spark):
    assert H.main_text(None) == H.main_text("") == H.main_text("<p") == H.main_text("<nav>a</nav>") == ""
    long = "<article>" + "<p>Some words, here and there.</p>" * 3000 + "</article>"
    assert H.main_text(long).count("\n") == 2999
    rows = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "<p>Words, and more words follow here.", 2)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in H.extract(rows).collect()) == ["", "", "Words, and more words follow here."]
    assert H.extract(rows.limit(0)).count() == 0


def test_weights_are_those_that_fit_finds():
    assert H.fit(labelled_pages.labelled(range(400))) == H.WEIGHTS.of


def test_labelled_pages_and_what_the_edges_change():
    """The cut on pages that the fit has not seen, against the sign of the classifier alone."""
    alone = H.Weights(H.WEIGHTS.of, 0.0, 0.0)
    right, signs, changed, n = 0, 0, 0, 0
    for blocks, want in labelled_pages.labelled(range(1000, 1300)):
        got, sign = H.label(blocks), H.label(blocks, alone)
        assert sign == [x > 0 for x in H.log_odds(blocks)]
        right += sum(x == y for x, y in zip(got, want))
        signs += sum(x == y for x, y in zip(sign, want))
        changed += sum(x != y for x, y in zip(got, sign))
        n += len(want)
    assert changed > 20 and right > signs + 10 and right / n > 0.99


def without_telling_names(page):
    page = re.sub(r"<(/?)(?:article|nav|aside|footer|header|main|section|form)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"<(div|p|ul)\s[^>]*>", r"<\1>", page)


def test_given_pages_held_out_of_the_fit(spark):
    """Half of the given pages teach (label: the article element), the other half is judged,
    as it is and without the elements and names that tell: the cut mends blocks of the classifier."""
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for change in (lambda page: page, without_telling_names):
        halves = [], []
        for page_id, page in sorted(pages.items()):
            first, behind = (len(H.blocks_of(page[: page.index(tag)])) for tag in ("<article>", "</article>"))
            found = H.blocks_of(change(page))
            halves[zlib.crc32(str(page_id).encode()) % 2].append((found, [first <= i < behind for i in range(len(found))]))
        weights = H.Weights(H.fit(halves[1]))
        total = signs = right = 0
        for found, want in halves[0]:
            total += len(want)
            signs += sum((x > 0) == y for x, y in zip(H.log_odds(found, weights), want))
            right += sum(x == y for x, y in zip(H.label(found, weights), want))
        assert right > signs and right / total > 0.995


def test_no_text_is_lost():
    cases = {
        "<article><p>First one.</p><button>Go<p>Second paragraph.</article>": "First one.\nSecond paragraph.",
        "<article><p>Before <button>Go</button> and after.</article>": "Before and after.",
        "<article><p>Area is <math><mi>x</mi></math> wide.</article>": "Area is x wide.",
        "<article><p>One.<svg><text>Label</text></svg> Two.<object>Three.</article>": "One.Label Two.Three.",
        "<article><p hidden>Hidden words.<p style='display:none'>More.<p aria-hidden=true>Most.</article>": "Hidden words.\nMore.\nMost.",
        '<article><div class="social text"><p>A paragraph of the article.</div></article>': "A paragraph of the article.",
        "<article><select><option>a<option>b<p>Behind the options.</article>": "Behind the options.",
        "<article><p>Open <script>var a = '<p>'": "Open",
        "<article><ul><li>One<li>Two <b>bold<li>Three</ul><dl><dt>T<dd>D</dl><table><tr><td>a<td>b<tr><td>c</table></article>": "One\nTwo bold\nThree\nT\nD\na\nb\nc",
    }
    for page, want in cases.items():
        assert H.main_text(page) == want, page


def test_deep_nesting_takes_linear_time():
    import time

    for tag in ("div", "b", "p", "li", "a", "section"):
        began = time.process_time()
        page = "<article>" + f"<{tag}>x" * 50_000 + "</article>"
        assert sum(len(b.text) for b in H.blocks_of(page)) >= 50_000
        assert time.process_time() - began < 4, tag


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=6),
    st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(1, 6)), max_size=9),
)
def test_cut_is_minimal(terminals, edges):
    n = len(terminals)
    edges = [(a % n, b % n, c) for a, b, c in edges if a % n != b % n]
    flow = H.Flow(n + 2)
    for i, (s, t) in enumerate(terminals):
        flow.join(n, i, s, 0)
        flow.join(i, n + 1, t, 0)
    for a, b, c in edges:
        flow.join(a, b, c, c)
    cost = lambda side: sum(t if x else s for x, (s, t) in zip(side, terminals)) + sum(c for a, b, c in edges if side[a] != side[b])
    assert cost(flow.cut(n, n + 1)[:n]) == min(map(cost, itertools.product((False, True), repeat=n)))
