"""Main text of pages by a recurrent block labeller: a bidirectional LSTM over a page's text blocks.

A block is seen as its tag path (elements, with the words of their classes, hashed), its words (hashed) and a few figures
(length, share of links, marks). The network runs over all blocks of a page in both directions and labels every one, so a
block's label depends on the whole document. Its labels for training come from two places: sampled pages whose elements
say what they are (`article`, `main`), and invented layouts, filled with the sample's words, in which the parts of a page
have other elements, usual class names, or no telling names at all.

The fit is numpy on the driver over a bounded sample; the pages are labelled in Arrow batches, whole, each once, with no
shuffle. The weights (under half a megabyte) go to the tasks.

Defined cases: null and empty html give an empty text; null and repeated ids are pages of their own; pages without content
blocks give an empty text; text after a cut tag is dropped as browsers do, a cut script or comment takes the rest; very long
pages are sequences of all their blocks; equal pages have equal texts; other columns are not read, whatever their names; an
empty table gives an empty result, and too small a sample leaves the invented layouts to fit on.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_blocks
from .common import arrow_rows
from .html_blocks import Block

#: Pages sampled for the fit, their largest size in characters, and invented layouts.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS = 150, 50_000, 1_500
EPOCHS, SEED = 10, 12
PATH_DIMS, WORD_DIMS, FIGURES = 384, 24, 8
HIDDEN = 16
#: Blocks (padded) that are labelled together.
CELLS = 20_000
REMEMBERED = 300_000

_CONTENT = ("article", "main")
#: Inside an article, these are not its text.
_ASIDES = ("nav", "aside", "footer", "header", "form", "button", "label", "menu")
_OUT = "page_id long, url string, text string, n_chars long, n_blocks long"


class _Hashes(dict):
    """Places of words; a bounded table."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = crc32(word.encode("utf-8", "surrogatepass")) * 2654435761 % 2**32 * self.dims >> 32
        return h


_words = _Hashes(WORD_DIMS)
#: Kinds of characters: bits for ends of sentences, commas, usual marks of imprints, ends of text.
_KINDS = np.zeros(2**16, np.uint8)
for _bit, _chars in enumerate((".!?", ",", "©|·", ".!?:\"'”»…")):
    _KINDS[[ord(c) for c in _chars]] |= 1 << _bit


@lru_cache(REMEMBERED // 100)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Tags and names of a path, each hashed, weaker with the distance from the block."""
    found = np.zeros(PATH_DIMS, np.float32)
    for depth, element in enumerate(reversed(path)):
        tag, *names = element.split()
        weight = max(0.5, 1 - 0.1 * depth)
        for kind, word in [("leaf" if not depth else "tag", tag), *(("name", n) for n in names)]:
            place = crc32(f"{kind}:{word}".encode("utf-8", "surrogatepass")) * 2654435761 % 2**32 * PATH_DIMS >> 32
            found[place] = max(found[place], weight)
    return found


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: its path, its words, its figures."""
    n = len(blocks)
    out = np.empty((n, PATH_DIMS + WORD_DIMS + FIGURES), np.float32)
    for row, b in zip(out, blocks):
        row[:PATH_DIMS] = path_vector(b.path)
    # blocks have single blanks between words
    words = [b.text.lower().split(" ") for b in blocks]
    lengths = np.fromiter(map(len, words), np.int64, n)
    places = np.fromiter(map(_words.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(lengths.sum()))
    bags = np.bincount(np.repeat(np.arange(n) * WORD_DIMS, lengths) + places, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = bags / lengths[:, None]
    chars = np.fromiter((len(b.text) for b in blocks), np.int64, n)
    linked = np.fromiter((b.linked for b in blocks), np.int64, n)
    codes = np.frombuffer("".join([b.text for b in blocks]).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _KINDS[np.minimum(codes, len(_KINDS) - 1)]
    ends = np.cumsum(chars)
    count = lambda bit: np.add.reduceat(kinds >> bit & 1, ends - chars, dtype=np.int64)
    figures = (np.log1p(chars) / 4, np.log1p(lengths) / 3, np.minimum(1, linked / chars), np.minimum(1, count(0) * 8 / lengths), np.minimum(1, count(1) * 8 / lengths), kinds[ends - 1] >> 3 & 1, count(2) > 0, lengths < 4)
    out[:, PATH_DIMS + WORD_DIMS :] = np.stack(figures, 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _turned(lengths: np.ndarray, steps: int) -> np.ndarray:
    """For each sequence the order of steps that reverses it within its length."""
    t = np.arange(steps)[None, :]
    return np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)


class Labeller:
    """A bidirectional LSTM with one output a step. Parameters: per direction input, recurrent and bias weights for the
    four gates (in, forget, out, candidate), then the output weights."""

    def __init__(self, dims: int, hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1
        self.weights = {}
        for d in "fb":
            self.weights["x" + d] = r.normal(0, 0.15, (dims, 4 * hidden)).astype(np.float32)
            self.weights["h" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.weights["c" + d] = bias.copy()
        self.weights["out"] = r.normal(0, 0.2, 2 * hidden).astype(np.float32)
        self.weights["bias"] = np.zeros(1, np.float32)

    def _scan(self, d: str, z: np.ndarray, mask: np.ndarray, keep: bool):
        """z: inputs times weights, (sequences, steps, gates); hidden states, and what the way back needs."""
        n, steps, _ = z.shape
        k, wh = self.hidden, self.weights["h" + d]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.zeros((n, steps, k), np.float32)
        saved = []
        for t in range(steps):
            g = z[:, t] + h @ wh
            gates, new = _sigmoid(g[:, : 3 * k]), np.tanh(g[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            m = mask[:, t, None]
            was = c
            c = (f * c + i * new) * m
            squashed = np.tanh(c)
            if keep:
                saved.append((h, was, i, f, o, new, squashed))
            h = o * squashed * m
            out[:, t] = h
        return out, saved

    def _unscan(self, d: str, grad: np.ndarray, mask: np.ndarray, saved: list):
        """Gradients of the gate inputs and of the recurrent weights."""
        n, steps, k = grad.shape
        wh = self.weights["h" + d]
        dz, dwh = np.zeros((n, steps, 4 * k), np.float32), np.zeros_like(wh)
        dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        for t in range(steps - 1, -1, -1):
            before, was, i, f, o, new, squashed = saved[t]
            m = mask[:, t, None]
            dh = (dh + grad[:, t]) * m
            dc = (dc + dh * o * (1 - squashed**2)) * m
            dg = np.concatenate((dc * new * i * (1 - i), dc * was * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)), 1)
            dz[:, t] = dg
            dwh += before.T @ dg
            dh, dc = dg @ wh.T, dc * f
        return dz, dwh

    def _forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        n, steps, _ = x.shape
        mask = (np.arange(steps)[None, :] < lengths[:, None]).astype(np.float32)
        turn = _turned(lengths, steps)[:, :, None]
        z = {d: x @ self.weights["x" + d] + self.weights["c" + d] for d in "fb"}
        f, saved_f = self._scan("f", z["f"], mask, keep)
        b, saved_b = self._scan("b", np.take_along_axis(z["b"], turn, 1), mask, keep)
        states = np.concatenate((f, np.take_along_axis(b, turn, 1)), 2)
        return _sigmoid(states @ self.weights["out"] + self.weights["bias"]), (mask, turn, states, saved_f, saved_b)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the blocks, and its gradients."""
        p, (mask, turn, states, saved_f, saved_b) = self._forward(x, lengths, True)
        total = mask.sum()
        loss = -float((mask * (labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))).sum() / total)
        d = ((p - labels) * mask / total).astype(np.float32)
        grads = {"out": np.einsum("nt,ntk->k", d, states), "bias": np.array([d.sum()], np.float32)}
        back = d[:, :, None] * self.weights["out"]
        for name, grad, saved in (("f", back[:, :, : self.hidden], saved_f), ("b", np.take_along_axis(back[:, :, self.hidden :], turn, 1), saved_b)):
            dz, grads["h" + name] = self._unscan(name, grad, mask, saved)
            if name == "b":
                dz = np.take_along_axis(dz, turn, 1)
            flat = dz.reshape(-1, dz.shape[2])
            grads["x" + name], grads["c" + name] = x.reshape(len(flat), -1).T @ flat, flat.sum(0)
        return loss, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED, batch: int = 48) -> "Labeller":
        """pages: (vectors, labels) of each. Adam with a falling rate, over batches of like lengths."""
        r = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        order = np.argsort([len(x) for x, _ in pages], kind="stable")
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        step, steps = 0, epochs * len(batches)
        for _ in range(epochs):
            for b in r.permutation(len(batches)):
                x, lengths = padded([pages[i][0] for i in batches[b]])
                y, _ = padded([pages[i][1][:, None] for i in batches[b]])
                _, grads = self.gradients(x, lengths, y[:, :, 0])
                step += 1
                rate = 0.01 * (1 - step / (steps + 1))
                size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    m, v = moments[k]
                    g = g * min(1, 1 / (size + 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g**2 - v)
                    self.weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probability of each block to be content."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            steps = len(pages[order[-1]])
            held = [order.pop()]
            while order and (len(held) + 1) * steps <= CELLS and 2 * len(pages[order[-1]]) >= steps:
                held.append(order.pop())
            flat = vectors(list(itertools.chain.from_iterable(pages[i] for i in held)))
            x, lengths = padded(np.split(flat, np.cumsum([len(pages[i]) for i in held[:-1]])))
            p, _ = self._forward(x, lengths)
            for row, i, n in zip(p, held, lengths):
                out[i] = row[:n]
        return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), lengths.max(), sequences[0].shape[1]), np.float32)
    for row, s in zip(out, sequences):
        row[: len(s)] = s
    return out, lengths


def told(blocks: list[Block]) -> list[bool] | None:
    """Labels of a page whose elements say what they are; None if they do not."""
    tags = [[e.split()[0] for e in b.path] for b in blocks]
    if not any(t in _CONTENT for path in tags for t in path):
        return None
    out = []
    for path, b in zip(tags, blocks):
        inside = next((i for i, t in enumerate(path) if t in _CONTENT), None)
        names = {w for e in b.path[inside or 0 :] for w in e.split()[1:]}
        foreign = {w for k, words in html_blocks.CHROME_NAMES.items() if k != "header" for n in words for w in n.split("-")} - {"more", "news", "top", "read", "text", "print"}
        out.append(inside is not None and not any(t in _ASIDES for t in path[inside:]) and not names & foreign)
    return out


def examples(pages: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> list[tuple[list[Block], list[bool]]]:
    """Labelled pages: the sampled ones that tell, and invented layouts with their words."""
    parsed = [html_blocks.blocks(p) for p in pages]
    out = [(b, labels) for b in parsed if b and (labels := told(b)) is not None]
    words = sorted({w for b in parsed for x in b for w in x.text.split()})
    rng = Random(seed)
    for page in itertools.islice(html_blocks.layouts(rng, words), layouts):
        out.append(([b for b, _ in page], [y for _, y in page]))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS, seed: int = SEED) -> Labeller:
    """A labeller for these pages, from the sample of least hashes among the different pages up to SAMPLE_CHARS characters."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(html_col)), F.lit(2**53))
    fair = pages.filter(F.length(html_col).between(1, SAMPLE_CHARS)).select(F.col(html_col).alias("html"), place.alias("place"))
    share = 4 * sample / max(1, fair.count())
    # about four times the sample leave their tasks
    few = fair.filter(F.col("place") < int(2**53 * min(1, share))).dropDuplicates(["place"])
    chosen = [r["html"] for r in few.orderBy("place").limit(sample).collect()]
    return Labeller(PATH_DIMS + WORD_DIMS + FIGURES, seed=seed).fit([(vectors(b), np.array(y, np.float32)) for b, y in examples(chosen, layouts, seed) if b], seed=seed)


def main_texts(pages: list[str], labeller: Labeller) -> Iterator[tuple[str, int]]:
    """(text, number of blocks) of each page."""
    parsed = [html_blocks.blocks(p) for p in pages]
    for blocks, p in zip(parsed, labeller.label(parsed)):
        yield "\n\n".join(b.text for b, content in zip(blocks, p >= 0.5) if content), len(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, n_blocks."""
    labeller = labeller or fit(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[str] = []
            since = size = 0
            column = batch.column("html")
            for i in range(batch.num_rows):
                held.append(column[i].as_py())
                size += len(held[-1])
                if size >= 2_000_000 or i + 1 == batch.num_rows:
                    rows = [(text, len(text), n) for text, n in main_texts(held, labeller)]
                    part = batch.slice(since, len(held))
                    yield arrow_rows(rows, _OUT, page_id=part.column("page_id"), url=part.column("url"))
                    since, held, size = i + 1, [], 0

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return source.mapInArrow(run, _OUT)
