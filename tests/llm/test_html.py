"""Operator 12: blocks against written-out pages, gradients against differences, labels on held-out pages."""

import random
from collections import Counter

import numpy as np
import pytest

from trajet.llm import html_blocks, html_extraction as H

SF = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<p>b<p>c", ["a", "b", "c"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>f", ["a", "b", "c", "d", "e", "f"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("<p>one<br>two \n\t three <b>bo</b>ld</p>", ["one two three bold"]),
        ("<p>a &amp; b &copy; &#39;x&#39; &lt;p&gt; &am", ["a & b © 'x' <p> &am"]),
        ("<p>&<b>lt;</b></p>", ["&lt;"]),
        ("<script>var t='</p>';</script><style>p{}</style><title>t</title><p>x", ["x"]),
        ("a<!-- <p>no</p> -->b<!-- open", ["ab"]),
        ("<p>x</p><script>never closed <p>y", ["x"]),
        ("<p title='a>b'>x</p><p title=\"a>b\">y</p><p title='open>z</p>", ["x", "y", "z"]),
        ("1 < 2 and 3 > 2<p", ["1 < 2 and 3 > 2"]),
        ("<P>A</P><DIV>B</DIV>", ["A", "B"]),
        ("<div>a<div>b</div>c</div></div></div>d", ["a", "b", "c", "d"]),
        ("<p>a\xa0b</p>", ["a b"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_follow_implied_ends_and_links_are_counted():
    got = html_blocks.blocks('<body><article class="postBody x"><p>one<p>two <a href=x>li&amp;k</a></article><nav id=Top><ul><li>m<li>n')
    assert [b.path for b in got] == [("body", "article post body x", "p")] * 2 + [("body", "nav top", "ul", "li")] * 2
    assert [b.linked for b in got] == [0, 4, 0, 0]


def test_long_and_broken_pages_take_linear_time():
    for page in ("<p " * 200_000, "<div>" * 3000 + "x", '<p title="' * 100_000, "<!--" * 100_000, "&" * 300_000, "<li>a" * 50_000):
        html_blocks.blocks(page)


def test_gradients():
    r = np.random.default_rng(0)
    m = H.Labeller(5, 3)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    x, lengths = r.normal(size=(4, 6, 5)), np.array([6, 1, 3, 5])
    y = r.integers(0, 2, (4, 6)).astype(float)
    loss, grads = m.gradients(x, lengths, y)
    for k, w in m.weights.items():
        for at in [tuple(r.integers(0, n) for n in w.shape) for _ in range(6)]:
            old = w[at]
            w[at] = old + 1e-4
            up, _ = m.gradients(x, lengths, y)
            w[at] = old - 1e-4
            down, _ = m.gradients(x, lengths, y)
            w[at] = old
            assert abs((up - down) / 2e-4 - grads[k][at]) < 2e-3


def test_padding_and_company_change_no_label():
    pages = [[b for b, _ in p] for p in [next(html_blocks.layouts(random.Random(i), [])) for i in range(12)]]
    m = H.Labeller(H.PATH_DIMS + H.WORD_DIMS + H.FIGURES)
    for together, page in zip(m.label([*pages, []]), pages):
        assert np.allclose(together, m.label([page])[0], atol=1e-5)


def article(page):
    return "\n\n".join(b.text for b in html_blocks.blocks(page) if any(e.split()[0] == "article" for e in b.path))


REST = "<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div class='cookie-notice'><p>We use cookies. Accept?</p></div><form><label>Search</label><input name=q><button>Go</button></form>"
AFTER = "<aside class=related><h3>Read on</h3><ul><li><a href=c>One more thing</a><li><a href=d>And another</a></ul></aside><section id=comments><h3>2 comments</h3><p>I do not agree with a word of this, sorry.</p><p>Well said, thank you for it.</p></section><footer><p>© 2020 The paper</p></footer>"
BODY = "<h1>What the harbour was for</h1><p>The harbour was built in a hurry, when ships had grown too long for the river. Nobody asked who would pay.</p><p>It took nine years, and three firms went under on the way.</p><h2>After</h2><p>Today it holds a market, two schools and a long row of boats that never leave.</p>"


@pytest.fixture(scope="module")
def fitted(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    return pages, H.fit(pages)


def test_pages_outside_the_sample(spark, fitted):
    pages, labeller = fitted
    rows = pages.collect()
    got = {r["page_id"]: r["text"] for r in H.extract(pages, labeller=labeller).collect()}
    wrong = [r["page_id"] for r in rows if got[r["page_id"]] != article(r["html"] or "")]
    assert len(got) == len(rows) and len(wrong) <= 0.01 * len(rows), wrong


@pytest.mark.parametrize("holder", ["<article>%s</article>", "<main class=content>%s</main>", "<div class='post-body clearfix'>%s</div>", "<div id=story><div class=inner>%s</div></div>"])
def test_unseen_layouts_with_names(fitted, holder):
    page = f"<html><head><title>T</title></head><body>{REST}{holder % BODY}{AFTER}</body></html>"
    assert next(H.main_texts([page], fitted[1]))[0] == "\n\n".join(texts(BODY))


def test_invented_layouts_held_out(fitted):
    layouts = html_blocks.layouts(random.Random(4242), [])
    pages = [next(layouts) for _ in range(300)]
    labels = fitted[1].label([[b for b, _ in p] for p in pages])
    wrong = sum(int(((p >= 0.5) != np.array([y for _, y in page])).sum()) for p, page in zip(labels, pages))
    assert wrong / sum(map(len, pages)) < 0.05


def test_edges(spark, fitted):
    rows = [(1, "u", "<article><p>x y z.</p></article>", 1), (1, "u", "<article><p>x y z.</p></article>", 1), (None, None, None, None), (2, "v", "", 2), (3, "w", "<p>" + "Long words go on, and on. " * 200_000 + "</p>", 3)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, n_chars int")
    got = H.extract(df, labeller=fitted[1])
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_blocks"]
    out = got.collect()
    assert Counter(r["page_id"] for r in out) == Counter(r[0] for r in rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert len({r["text"] for r in out if r["page_id"] == 1}) == 1 and {r["text"] for r in out if r["page_id"] in (None, 2)} == {""}


def test_empty_table_and_reruns(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    small = H.fit(empty, layouts=40)
    assert H.extract(empty, labeller=small).count() == 0
    again = H.fit(empty, layouts=40)
    assert all((small.weights[k] == again.weights[k]).all() for k in small.weights)
