import itertools
import time
import tracemalloc

import numpy as np
import pytest
from millrace.llm import htmltext as h

SCHEMA = "page_id long, url string, html string, text string, n_chars long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def field():
    return h.default_field(300)


def test_held_out_pages(field):
    right = total = 0
    for page, states in h.labelled(200, seed=77):
        found = h.blocks(page)
        assert len(found) == len(states)
        got = field.decode(h.features(found))
        right, total = right + sum(a == b for a, b in zip(got, states, strict=True)), total + len(states)
    assert right / total > 0.985


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<header><div class="logo">Site</div><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies to serve you.</p><button>Accept</button></div><!-- <p>hidden</p> -->
<article><h1>A &amp; B&nbsp;title</h1><p>First   paragraph with <b>bold</b>
and <a href="/x">a link</a> inside, long enough to read.<p>Second &lt;one&gt; is not closed &#233;&#x4e2d;.<br>It goes on.</p>
<div class="ad">Buy this thing now.</div><p>Third paragraph follows the advert here.</p>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I disagree with this.</p></div></section></article>
<aside class="sidebar"><h3>Related</h3><p><a href="/y">Another story</a></p></aside>
<form class="newsletter"><label>E-mail</label><input><button>Subscribe</button></form>
<footer><p>&copy; 2020 Site</p></footer></body></html>"""


def test_a_page(field):
    assert h.main_text(PAGE, field).split("\n") == [
        "A & B title",
        "First paragraph with bold and a link inside, long enough to read.",
        "Second <one> is not closed éä¸­. It goes on.".replace("ä¸­", "中"),
        "Third paragraph follows the advert here.",
    ]


@pytest.mark.parametrize("page", [None, "", "<", "<div", "<p>", "<!-- open", "<script>never closed", "</p></div>", "<a href='x>y</a>", "\x00<b>&#0;&bogus;</b>", "plain text only", "<p " + "x" * 1000])
def test_broken_pages(field, page):
    text = h.main_text(page, field)
    assert "\n\n" not in text and text == text.strip()


def read(page):
    return [b.text for b in h.blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be<p>next", ["let x=2 be", "next"]),
        *((f"<p>a<{tag} class='y'>b<p>c", ["ab", "c"]) for tag in ("svg", "noscript", "template")),
        *((f"<p>a<{tag}>b<p>c", ["a", "b", "c"]) for tag in ("select", "object")),
        ("<p>a<svg><text>no</text></svg>b<noscript>no</noscript>", ["a b"]),
        ("<p>a<svg/>b", ["a b"]),
        ("<script src=/js/>alert(1)</script><p>text", ["text"]),
        ("<p>a<script>never closed <p>b", ["a"]),
        ("<div/>a<div/>b", ["a", "b"]),
        ("<title>no</title><p>yes<title>kept", ["yes", "kept"]),
        ("a <b <p>c > d 1 < 2 and <3", ["a c > d 1 < 2 and <3"]),
        ("<p title='a > b'>x<p data-y=\"<p>no</p>\">z", ["x", "z"]),
        ("<ul><li>1<ul><li>1.1<li>1.2</ul><li>2</ul>tail", ["1", "1.1", "1.2", "2", "tail"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("x&amp;y &lt;b&gt; &nbsp;&#8212; &unknown; &#x41;", ["x&y <b> \u2014 &unknown; A"]),
        ("<p>a<br>b\n\tc<img src=x>d<b>e</b>f", ["a b c def"]),
    ],
)
def test_reading_by_hand(page, want):
    assert read(page) == want


def test_paths_by_hand():
    def path(node):
        return [*path(node.parent), node.tag] if node else []

    found = h.blocks("<body><div id=a><ul><li>1<li>2</ul></nav><p>3<div>4</div>5</body>6")
    assert [(b.text, path(b.node)) for b in found] == [
        ("1", ["body", "div", "ul", "li"]), ("2", ["body", "div", "ul", "li"]), ("3", ["body", "div", "p"]), ("4", ["body", "div", "div"]), ("5", ["body", "div"]), ("6", []),
    ]
    assert found[0].node is found[1].node


UNITS = ["<div>x", "<div><p>x", "<header><li></li>x", "<li>x", "<dt><ul>x<dd></dd>", "<svg>x", "<a '>'", "<a =\">\"", "<a", "<a '", "</div>", "<b>x</p>", "<!-", "<!--x", "<select><option>x", "<td>x</nav>", "&amp;", "<h1 class=a>x", "<p id='"]


@pytest.mark.parametrize("unit", UNITS)
def test_reading_takes_time_in_proportion(field, unit):
    """30,000 repetitions in good time and little memory: nesting costs nothing."""
    page = unit * 30_000
    tracemalloc.start()
    began = time.process_time()
    found = h.blocks(page)
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and took < 12  # tracing slows it about fivefold
    states = field.decode(h.features(found[:1000]))
    assert len(states) == len(found[:1000])


def test_training_gradient_and_viterbi_against_all_paths():
    r = np.random.default_rng(0)
    field = h.Field({f"f{k}": tuple(r.normal(size=2)) for k in range(6)}, r.normal(size=(2, 2)).tolist())
    for n in (1, 2, 5, 8):
        page = [[f"f{k}" for k in r.choice(6, 2)] for _ in range(n)]

        def score(path):
            return sum(field.emit[f][s] for own, s in zip(page, path, strict=True) for f in own) + sum(field.step[a][b] for a, b in itertools.pairwise(path))

        assert tuple(field.decode(page)) == max(itertools.product((0, 1), repeat=n), key=score)
    assert field.decode([]) == []


def test_query_rows(spark, field):
    long = "<article>" + "<p>word and word again.</p>" * 5_000 + "</article>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", PAGE), (None, "u", long)]
    got = {r["page_id"]: r for r in h.extracted(pages(spark, rows), field).collect()}
    assert got[1]["text"] == got[4]["text"] and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[2]["n_chars"], got[2]["url"]) == ("", 0, None) and got[3]["text"] == ""
    assert got[None]["text"].count("\n") == 4_999
    assert h.extracted(pages(spark, []), field).collect() == []
