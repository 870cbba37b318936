"""Text of pages as the page tool gives it."""

import pytest

from trajet.operators import pages


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<p>b<p>c", "a\n\nb\n\nc"),
        ("<ul><li>a<li>b</ul>", "a\n\nb"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "abc\n\nb\n\nc\n\nd"),
        ("<table><tr><td>a<td>b<tr><th>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("<table><tr><td><p>x<td>y</table>", "x\n\nx\n\ny"),
        ("<p>one<div>two</div>three<p>four", "one\n\nfour"),
        ("<p>a <b>bold</p><p>next</b> end</p>", "a bold\n\nnext end"),
        ("<b><p>in</b> and out</p>", "in and out"),
        ("<h1>a<h2>b</h2>", "a\n\nb"),
        ("<pre>  keep\n   these\n\n\n lines </pre><p> and  inner   blanks\n</p>", "keep\n   these\n\n\n lines\n\nand  inner   blanks"),
        ("<nav><p>menu</nav><p>text<footer><p>f</footer><aside>s</aside><script>x</script>", "text"),
        ("<header><h1>No</h1></header><h1>Yes</h1>", "Yes"),
        ("<blockquote><p>q</p></blockquote>", "q\n\nq"),
        ("<div>only \n\n\n\n divs</div> \n<div>here</div>", "only\n divs\nhere"),
        ("<p/>a<p>b", "a\n\nb"),
        ("", ""),
        ("<p></p></p></li>", ""),
    ],
)
def test_text(html, want):
    assert pages.extract(html)[1] == want


def test_titles():
    assert pages.extract("<title> A &amp; B </title><h1>H</h1>")[0] == "A & B"
    assert pages.extract("<h1> H <b>x</b></h1>")[0] == "H x" and pages.extract("<p>t</p>")[0] == ""
    assert pages.extract("<title>T</title><div>rest</div>")[1] == "Trest"


def test_long_pages_name_their_length():
    text = pages.extract(f"<p>{'x' * 60_000}</p>")[1]
    assert text == "x" * 50_000 + "\n\n[... truncated; original length 60000 chars]"
    text = pages.extract(f"<p>{'🙂' * 30_000}</p>")[1]
    assert text == "🙂" * 25_000 + "\n\n[... truncated; original length 60000 chars]"
