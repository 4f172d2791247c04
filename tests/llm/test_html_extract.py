import html
import itertools
import re

import numpy as np
from pyspark.sql import types as T

from peerlens.llm import html_extract as he
from peerlens.llm.queries import QUERIES
from peerlens.session import ship_package


def article_of(page):
    """The text of the one article of a page of the given tables."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><script>var t="</p>";</script>
      <nav><ul><li><a href="/a">Home</a><li>About &amp; more</ul></nav><!-- <p>no</p> --><p>One<br>two <b>bold</b><p>Three &lt;x&gt;
      </div></p><div class="Ad-box">Buy</div><textarea>no</textarea></body></html>"""
    found = he.blocks(page)
    assert [b.text for b in found] == ["Home", "About & more", "One two bold", "Three <x>", "Buy"]
    assert found[0].linked == 4 and "under:nav" in found[0].path and "near in:advert" in found[4].near
    for odd in (None, "", "plain", "<", "<p", "<a <b <c", "<p class='x>y</p>", "</p></div>", "<script>never closed", "<!-- open", "<p>" * 3000):
        he.trained().text(odd)
    assert he.trained().text(None) == he.trained().text("") == ""


def test_elements_that_are_no_raw_text():
    said = lambda page: [b.text for b in he.blocks(page)]
    for tag in ("svg", "math", "object", "canvas", "template"):
        assert said(f"<p>One</p><{tag}><p>Two</p><p>Three</p>") == ["One", "Two", "Three"]
    assert said("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then</p>") == ["If x=1 then"]
    assert said("<p>One</p><object data=a><p>No film here</p></object><p>Two</p>") == ["One", "No film here", "Two"]
    assert said("<p>One<svg><svg><text>no</text></svg><title>no</title></svg> two</p><canvas>no</canvas><template>no</template>") == ["One two"]


def test_viterbi_equals_all_sequences():
    rng = np.random.default_rng(5)
    page = he.blocks("<p>One two.</p><div class=ad>Buy</div><ul><li>a<li>b</ul><p>Again, long text here.</p>")
    names = he.features(page)
    chain = he.Chain({f: float(rng.normal()) for x in names for f in x}, rng.normal(size=(2, 2)))

    def total(classes):
        return sum(c * sum(chain.weights[f] for f in x) for c, x in zip(classes, names)) + sum(
            chain.moves[a, b] for a, b in zip(classes, classes[1:]))

    assert tuple(chain.decode(page)) == max(itertools.product((0, 1), repeat=len(page)), key=total)


def test_likelihood_slope():
    """After a fit the expected counts of features equal those seen, up to the penalty."""
    maker = he._Maker(3)
    pages = [maker.page() for _ in range(30)]
    chain = he.fit(pages, rounds=600, rate=0.05, penalty=1e-2)
    seen, expected, n = 0.0, 0.0, 0
    for found, classes in pages:
        names = he.features(found)
        gain = np.array([sum(chain.weights[f] for f in x) for x in names])
        ahead = [np.array([0.0, gain[0]])]
        for g in gain[1:]:
            ahead.append(np.logaddexp(*[ahead[-1][k] + chain.moves[k] for k in (0, 1)]) + [0, g])
        behind = [np.zeros(2)]
        for g in gain[:0:-1]:
            behind.append(np.logaddexp(*[chain.moves[:, k] + (g * k) + behind[-1][k] for k in (0, 1)]))
        one = [np.exp(a[1] + b[1] - np.logaddexp(*ahead[-1])) for a, b in zip(ahead, behind[::-1])]
        seen, expected, n = seen + sum(classes), expected + sum(one), n + len(classes)
    assert abs(seen - expected) / n < 0.01 + 1e-2 * abs(chain.weights["bias"])


def test_labelled_pages_not_trained_on():
    maker, chain = he._Maker(12345), he.trained()
    pages = [maker.page() for _ in range(150)]
    wrong = sum(a != b for found, classes in pages for a, b in zip(classes, chain.decode(found)))
    assert wrong / sum(len(c) for _, c in pages) < 0.03


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op4_html"](spark, sf).collect()
    assert len(rows) == len(pages)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)
    assert sum(r.text != article_of(pages[r.page_id].html) for r in rows) <= 0.01 * len(rows)


def test_layouts_of_other_kinds():
    text = he.trained().text
    say = "A river runs past the old mill, and the miller counts his sacks of flour. Then he goes home."
    page = f"""<body><div class="site-header"><p>My site</p></div><ul class="menu"><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>
      <div id="content"><h1>The old mill</h1><p>{say}</p><div class="advert">Buy flour now, cheap and good.</div><p>{say} Again.</p></div>
      <div class="comments"><h3>Comments</h3><div class="comment"><p>I liked this one, thank you so much.</p></div></div>
      <div class="sidebar"><p>Other stories of the week.</p></div><div class="cookie-notice">We use cookies.</div>
      <form><label>Mail</label><button>Send</button></form><div class="footer">Copyright by us.</div></body>"""
    assert text(page) == f"The old mill\n\n{say}\n\n{say} Again."


def test_odd_pages(spark):
    ship_package(spark)
    schema = T.StructType().add("page_id", "long").add("html", "string").add("text", "string")
    rows = [(1, None, "x"), (2, "", "y"), (None, "<article><p>Some words, and some more of them here.</p></article>", None)] * 2
    out = he.extract_pages(spark.createDataFrame(rows, schema), out="main").collect()
    assert sorted(r.main for r in out) == [""] * 4 + ["Some words, and some more of them here."] * 2
    assert {r.text for r in out} == {"x", "y", None}
    assert he.extract_pages(spark.createDataFrame([], schema)).count() == 0
