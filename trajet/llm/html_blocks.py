"""The text blocks of a page with their tag paths, and pages of invented layouts for training.

A block is a run of text between block-level tags; inline tags belong to it, a line break in it is white space. End tags
that HTML implies are added: a block closes an open paragraph, a list item the one before, and so on. Text of elements
that are not shown is no block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from random import Random
from typing import NamedTuple

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'<]|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[A-Za-z/][^>]*+\Z|<[!?/][^>]*+(?:>|\Z)""", re.DOTALL)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements that start and end a block, those whose text is not shown, void ones, and what a start tag closes.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul button label".split()
)
_HIDDEN = frozenset("script style title textarea noscript noembed noframes iframe object template svg math xmp".split())
_VOID = frozenset("hr".split())
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
         "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"), "thead": ("caption",)}
#: An implied end does not reach beyond these.
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "optgroup": ("select",)}
_raw_ends: dict[str, re.Pattern] = {}


class Block(NamedTuple):
    path: tuple[str, ...]  #: open block-level elements, outermost first: the tag and the words of its class, id and role
    text: str
    linked: int  #: characters inside links


@lru_cache(65536)
def _element(tag: str, attributes: str) -> str:
    words = [w.lower() for m in _MARKS.finditer(attributes) for w in _WORD.findall(m[2] or m[3] or m[4] or "")]
    return " ".join([tag, *words])


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    open_: list[str] = []  # tags of block-level elements
    paths: list[tuple[str, ...]] = [()]  # their paths, the empty one first
    parts: list[str] = []
    links = linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(paths[-1], text, linked))
            parts.clear()
            linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece)

    def close(tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        """Ends the outermost open element of these tags inside the scope, with all in it."""
        cut = None
        for i in range(len(open_) - 1, -1, -1):
            if open_[i] in scope:
                break
            if open_[i] in tags:
                cut = i
                if len(tags) == 1:
                    break
        if cut is not None:
            del open_[cut:], paths[cut + 1 :]

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ending = tag.lower(), bool(m[1] or m[4])
        if tag == "a":
            links = 0 if ending else 1
        elif tag == "br":
            parts.append("\n")
        elif tag in _HIDDEN:
            if not ending:
                if tag not in _raw_ends:
                    _raw_ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE)
                end = _raw_ends[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag in _BLOCKS:
            flush()
            if ending:
                close((tag,))
                continue
            if tag in _ENDS_PARAGRAPH and "p" in open_:
                close(("p",), ("button", "td", "th", "caption"))
            if tag in _ENDS:
                close(_ENDS[tag], _SCOPE.get(tag, ("table",)))
            if tag not in _VOID:
                open_.append(tag)
                attributes = m[3] or m[6]
                paths.append((*paths[-1], _element(tag, attributes) if attributes else tag))
    flush()
    return out


# What layouts call their parts: fixed lists of usual class names.
CONTENT_NAMES = "article article-body article-content content entry entry-content main main-content post post-body post-content story story-body text body-text page-content blog-post news-text prose read".split()
CHROME_NAMES = {
    "nav": "nav navbar menu main-menu site-nav navigation topnav breadcrumb breadcrumbs links tabs pagination pager".split(),
    "header": "header site-header masthead top topbar branding logo banner page-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal foot credits imprint".split(),
    "aside": "aside sidebar side widget related related-posts recommended trending popular rail more-news tags toc".split(),
    "ad": "ad ads advert advertisement adsbox sponsor sponsored promo promotion banner-ad commercial".split(),
    "notice": "notice cookie cookies cookie-notice consent gdpr alert popup modal newsletter subscribe paywall privacy warning disclaimer".split(),
    "form": "form search search-form login signup contact-form subscribe-form comment-form filter".split(),
    "comments": "comments comment comment-list comment-body replies discussion disqus responses reader-comments reply".split(),
    "share": "share sharing social social-links buttons toolbar meta byline print".split(),
}
_OPENINGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "ad": ("div", "aside", "section"), "notice": ("div", "section", "aside"), "form": ("form",), "comments": ("section", "div", "ol", "aside"), "share": ("div", "ul")}
_NOISE = "wrap wrapper container row col grid inner outer box block section left right center layout module panel group item unit clearfix".split()


class Texts:
    """Words to fill layouts with: from a sample of pages, or invented."""

    def __init__(self, rng: Random, words: list[str]):
        self.rng = rng
        self.words = words if len(words) >= 200 else ["".join(rng.choices("an be ci du el fo gra hi in ju ka lo me nor os pi qua re sti tor un ver".split(), k=rng.randint(1, 4))) for _ in range(3000)]

    def some(self, least: int, most: int) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randint(least, most)))

    def sentence(self) -> str:
        return self.some(4, 22).capitalize() + self.rng.choice("...!?")

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 1, 2, 3, 5, 8, 12))))


def layouts(rng: Random, words: list[str]) -> Iterator[list[tuple[Block, bool]]]:
    """Endless pages as labelled blocks: an article among menus, notices, adverts, comments and the like, with usual or
    meaningless names, with or without telling elements."""
    texts = Texts(rng, words)
    noise = lambda: " ".join(rng.sample(_NOISE, rng.randint(0, 2)) + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8)))] * (rng.random() < 0.3))
    element = lambda tag, *names: " ".join([tag, *(w.lower() for n in names for w in _WORD.findall(n))])

    def chrome(kind: str, around: tuple[str, ...], blind: bool) -> list[tuple[Block, bool]]:
        tag = rng.choice(_OPENINGS[kind])
        tag = "div" if blind and tag in ("nav", "header", "footer", "aside") and rng.random() < 0.5 else tag
        path = (*around, element(tag, "" if blind or rng.random() < 0.25 and tag != "div" else rng.choice(CHROME_NAMES[kind]), noise() if rng.random() < 0.2 else ""))
        out = []
        for _ in range({"nav": rng.randint(2, 14), "aside": rng.randint(1, 8), "footer": rng.randint(1, 4), "comments": rng.randint(1, 10), "share": rng.randint(1, 5), "form": rng.randint(1, 5)}.get(kind, rng.randint(1, 2))):
            linked = kind in ("nav", "share") or kind in ("aside", "footer") and rng.random() < 0.6
            text = {"comments": texts.paragraph, "ad": texts.sentence, "notice": texts.sentence, "aside": lambda: texts.some(2, 12), "footer": lambda: rng.choice(("©", "", "·")) + " " + texts.some(1, 14)}.get(kind, lambda: texts.some(1, 3))()
            leaf = {"nav": ("li", "li", "div", ""), "aside": ("li", "p", "h3", "div", ""), "comments": ("p", "div", "li", "h3"), "form": ("label", "button", "p", ""), "share": ("li", ""), "footer": ("p", "li", "", "")}.get(kind, ("p", "", "", "div"))
            leaf = rng.choice(leaf)
            inner = ((element("ul"),) if leaf == "li" and rng.random() < 0.8 else ()) + ((element(leaf, noise() if rng.random() < 0.1 else ""),) if leaf else ())
            out.append((Block(path + inner, text.strip(), len(text) if linked else 0), False))
        return out

    while True:
        blind = rng.random() < 0.15  # no telling names: length, links and neighbours must do
        around = ["html", "body"] + [element("div", noise()) for _ in range(rng.choice((0, 0, 1, 2, 3)))]
        tag = rng.choice(("article", "article", "main", "div", "div", "section"))
        holder = [element(tag, "" if blind or tag in ("article", "main") and rng.random() < 0.5 else rng.choice(CONTENT_NAMES), noise() if rng.random() < 0.3 else "")]
        if rng.random() < 0.25:
            holder.append(element(rng.choice(("div", "section")), rng.choice(CONTENT_NAMES) if rng.random() < 0.5 else noise()))
        path = tuple(around + holder)
        page: list[tuple[Block, bool]] = []
        for kind in rng.sample(("header", "nav", "notice", "ad", "form", "share", "aside", "nav"), rng.randint(0, 4)):
            page += chrome(kind, tuple(around), blind)
        if rng.random() < 0.8:
            page.append((Block((*path, "h1"), texts.some(3, 14), 0), True))
        for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 8, 12, 20))):
            leaf, roll = "p", rng.random()
            if roll < 0.06:
                leaf = rng.choice(("h2", "h3"))
                page.append((Block((*path, leaf), texts.some(1, 9), 0), True))
            elif roll < 0.12:
                for _ in range(rng.randint(2, 6)):
                    page.append((Block((*path, rng.choice(("ul", "ol")), "li"), texts.some(1, 18), 0), True))
            elif roll < 0.16:
                page.append((Block((*path, *rng.choice((("blockquote",), ("blockquote", "p"), ("pre",), ("figure", "figcaption"), ("table", "tbody", "tr", "td")))), texts.sentence(), 0), True))
            elif roll < 0.22:
                page.append((Block(path, texts.paragraph(), 0), True))
            elif roll < 0.28:
                page += chrome(rng.choice(("ad", "share", "aside", "notice", "form")), path, blind)
            else:
                text = texts.paragraph()
                page.append((Block((*path, leaf), text, rng.choice((0, 0, 0, 0, len(text) // 5))), True))
        if rng.random() < 0.3:
            page += chrome(rng.choice(("comments", "share", "aside")), path, blind)
        for kind in rng.sample(("footer", "footer", "aside", "comments", "form", "ad", "notice"), rng.randint(0, 4)):
            page += chrome(kind, tuple(around), blind)
        yield page
