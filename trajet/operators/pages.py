"""HTML to text, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

# Fixed values, which must equal those of the page tool whose answers are matched: elements that are dropped, and those
# whose text counts.
SKIPPED = frozenset({"script", "style", "noscript", "iframe", "svg", "nav", "header", "footer", "aside"})
BEARING = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "blockquote", "pre"})
MOST_CHARS = 50_000
NOTE = "\n\n[... truncated; original length {} chars]"


# Fixed values of HTML: elements without an end tag, those whose start ends an open paragraph, and those of inline text,
# whose end tags close nothing else.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
INLINE = frozenset("a abbr b big cite code em font i kbd label mark nobr q s samp small span strike strong sub sup tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends these open elements, up to the innermost of those that hold them.
_ROW, _CELL = ("tr", "td", "th"), ("td", "th")
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (_CELL, ("table", "tr")), "th": (_CELL, ("table", "tr")), "tr": (_ROW, ("table",)), "tbody": ((*_ROW, "thead", "tbody"), ("table",)), "tfoot": ((*_ROW, "thead", "tbody"), ("table",)),
}
_PARAGRAPH_SCOPE = ("table", "td", "th", "caption", "button", "object")


class _Reader(HTMLParser):
    """Open elements as (tag, the texts of the block it is or None); a block's text is that of all that stands in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.blocks: list[list[str]] = []
        self.titles: list[list[str]] = []
        self.heading: list[str] | None = None
        self.all: list[str] = []

    def _end(self, tags, scope=()) -> None:
        """Ends the outermost open element of these tags inside the scope, and all in it."""
        cut = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in scope:
                break
            if self.open[i][0] in tags:
                cut = i
        if cut is not None:
            del self.open[cut:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._end(("p",), _PARAGRAPH_SCOPE)
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.open.pop()
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in VOID:
            return
        block = None
        if not any(t in SKIPPED for t, _ in self.open) and tag not in SKIPPED:
            if tag == "title":
                self.titles.append(block := [])
            elif tag in BEARING:
                # blocks stand in the order of their start, nested ones once more for themselves
                self.blocks.append(block := [])
                if tag == "h1" and self.heading is None:
                    self.heading = block
        self.open.append((tag, block))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at : at + 1 if tag in INLINE else None]

    def handle_data(self, data):
        if any(t in SKIPPED for t, _ in self.open):
            return
        self.all.append(data)
        for _, block in self.open:
            if block is not None:
                block.append(data)


def extract(html: str) -> tuple[str, str]:
    """(title, text): text-bearing blocks, trimmed, joined by blank lines; without any, all text with its empty lines
    thinned. Lengths are in UTF-16 units; a character is not cut in two. Null and empty pages give empty texts."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    text = "\n\n".join(b for b in ("".join(parts).strip() for parts in reader.blocks) if b)
    if not text:
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\s+\n", "\n", "".join(reader.all).strip()))
    units = text.encode("utf-16-le", "surrogatepass")
    if len(units) > 2 * MOST_CHARS:
        text = units[: 2 * MOST_CHARS].decode("utf-16-le", "ignore") + NOTE.format(len(units) // 2)
    # the first title, else the first main heading
    title = "".join(reader.titles[0]) if reader.titles else ""
    return (title or "".join(reader.heading or [])).strip(), text


def page_text(html):
    """A column of HTML as a struct of title and text."""

    @F.pandas_udf("title string, text string")
    def text(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(h or "") for h in values], columns=["title", "text"])

    return text(html)
