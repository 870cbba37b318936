"""Tokens of two tokenizers aligned by interval coalescing, and how usual each link of their ids is in the corpus.

The tokens of both vocabularies are byte intervals. All of them, of many texts at once, are sorted by start and end; a
running maximum of the ends shows where a start reaches what came before, and there a group begins: every byte offset at
which tokens of both sides end. Inside a group every token of one side is linked to every token of the other.

Neither tokenizer has tokens that go on from a word into the white space behind it, so texts are taken apart there and
each distinct chunk is encoded and aligned once per worker (a bounded table). A text with white space other than blank,
tab and line feed is one chunk.

1. Workers align their texts and write blocks of documents: each document's counts and digest, and its distinct id pairs.
2. A pair's documents are counted: a block sends each of its pairs once, with its number of documents. The counts go
   back to the blocks that hold the pair, and a block's documents add them up.

Defined cases: null and empty texts, and those whose tokens do not spell the text (normalised characters), have no tokens:
zeros and an empty digest; null and repeated ids are documents of their own; very long texts are a block of their own;
pairs with equal counts are all best; other columns are not read, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a block, about, and rows at most.
BLOCK_CHARS, BLOCK_ROWS = 2_000_000, 10_000
#: Chunks that a worker remembers (a few hundred bytes each); beyond, the table starts anew.
REMEMBERED = 400_000

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: One row a block. starts: of each document's pairs; which: their places among the block's pairs; times: links of each.
_BLOCK = "block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in _COUNTS) + ", sha array<string>, pairs binary, docs binary, starts binary, which binary, times binary"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_CHUNK = re.compile(r"[ \t\n]*[^ \t\n]+(?:[ \t\n]+\Z)?|[ \t\n]+")
_OTHER_SPACE = re.compile(r"[^\S \t\n]")
_workers: dict[tuple, "Aligner"] = {}


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders the non-empty intervals and numbers their groups: (order, group of each in that order).

    A group breaks where a start reaches the running maximum of the ends before it. The intervals of a side must not
    overlap; on one side they may leave gaps.
    """
    order = np.lexsort((side, ends, starts))
    if not len(order):
        return order, order
    reach = np.maximum.accumulate(ends[order])
    fresh = np.r_[True, starts[order][1:] >= reach[:-1]]
    return order, np.cumsum(fresh) - 1


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write bytes that do not print as the characters from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class Aligner:
    """Both tokenizers, and what is known of each chunk. path_a: a byte-level `tokenizers` file; path_b: a sentencepiece
    model that adds a blank in front."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, special = _byte_letters(), {i for i, t in vocabulary.get_added_tokens_decoder().items() if t.special}
        self.bytes_a = [b""] * vocabulary.get_vocab_size()
        for token, i in vocabulary.get_vocab().items():
            self.bytes_a[i] = token.encode() if i in special else bytes(map(letters.__getitem__, token))
        # the file's merges are in the order of its ids, so its vocabulary is a table of ranks; tests hold the ids against the file's own
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a) if i not in special}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        self.base = len(pieces)
        self.marked = np.array([[m + str(i) for i in range(max(len(self.bytes_a), self.base))] for m in ("", ",", "|", ";")], object)
        self.blank = pieces.index("▁") if "▁" in pieces else -1
        # chunks are independent if no piece goes on behind a letter with a blank, or holds a tab or line feed
        self.apart = not any(re.search("[^▁]▁|[ \t\n]", p) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)
        self.spelt = np.zeros(0, bool)
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """The blank in front and the text, cut before white space that follows something else."""
        text = " " + text
        return _CHUNK.findall(text) if self.apart and not _OTHER_SPACE.search(text) else [text]

    def _encode_a(self, chunks: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks and how many each has. Chunks that begin with white space and end without are encoded
        as one text; the others, behind them, one by one."""
        plain = next((i for i, c in enumerate(chunks) if self._odd(c)), len(chunks))
        flat = np.array(self.a.encode_ordinary("".join(chunks[:plain])), np.int64)
        n = np.diff(np.searchsorted(np.cumsum(self.lengths[0][flat]), ends[:plain], "right"), prepend=0)
        found = list(map(self.a.encode_ordinary, chunks[plain:]))
        more = np.fromiter(map(len, found), np.int64, len(found))
        return np.r_[flat, np.fromiter(chain.from_iterable(found), np.int64, int(more.sum()))], np.r_[n, more]

    def _odd(self, chunk: str) -> bool:
        return not self.apart or chunk[-1].isspace() or bool(_OTHER_SPACE.search(chunk))

    def _encode_b(self, chunks: list[str]) -> list[list[int]]:
        out = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [ids if c[0] == " " or ids[:1] != [self.blank] else ids[1:] for c, ids in zip(chunks, out)]

    def learn(self, chunks: list[str]) -> None:
        """Encodes and aligns chunks that are not known yet, all at once."""
        chunks = sorted(chunks, key=self._odd)
        raw = [c.encode() for c in chunks]
        origin = np.cumsum([0, *map(len, raw)])
        flat_a, n_a = self._encode_a(chunks, origin[1:])
        found = self._encode_b(chunks)
        spelt = np.ones(len(chunks), bool)  # byte-level tokens spell any text
        if b"".join(map(self.bytes_b.__getitem__, chain.from_iterable(found))) != b"".join(raw):
            spelt = np.array([b"".join(map(self.bytes_b.__getitem__, x)) == r for x, r in zip(found, raw)], bool)
            flat_a, n_a = flat_a[np.repeat(spelt, n_a)], n_a * spelt
            found = [x if s else [] for x, s in zip(found, spelt.tolist())]
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        flat_b = np.fromiter(chain.from_iterable(found), np.int64, int(n_b.sum()))
        chunk, starts, ends = [], [], []
        for flat, n, lengths in ((flat_a, n_a, self.lengths[0]), (flat_b, n_b, self.lengths[1])):
            size = lengths[flat]
            end = np.cumsum(size)
            of = np.repeat(np.arange(len(chunks)), n)
            # tokens follow each other; chunks that are not spelt leave a gap
            end += origin[of] - np.r_[0, end][np.cumsum(n) - n][of]
            chunk.append(of), ends.append(end), starts.append(end - size)
        ids, chunk, starts, ends = np.r_[flat_a, flat_b], *map(np.concatenate, (chunk, starts, ends))
        side = (np.arange(len(ids)) >= len(flat_a)).astype(np.int64)
        order, group = coalesce(starts, ends, side)
        ids, chunk, side = ids[order], chunk[order], side[order]
        n_groups = int(group[-1]) + 1 if len(group) else 0
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side)
        per_b = np.bincount(group[b], minlength=n_groups)
        owner = np.zeros(n_groups, np.int64)
        owner[group] = chunk
        # every A token of a group with every B token of it
        width = per_b[group[a]]
        left = np.repeat(np.arange(len(a)), width)
        right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + (np.cumsum(per_b) - per_b)[group[a]][left]
        span = len(self.bytes_a) * self.base
        links = np.sort(chunk[a][left] * span + ids[a][left] * self.base + ids[b][right])
        fresh = np.flatnonzero(np.r_[True, links[1:] != links[:-1]]) if len(links) else np.zeros(0, np.int64)
        count = lambda x: np.bincount(x, minlength=len(chunks))
        self.known.update(zip(chunks, range(len(self.texts), len(self.texts) + len(chunks))))
        self.texts += self._shown(ids, chunk, side, group, len(chunks))
        self.numbers = np.concatenate((self.numbers, np.stack((n_a, n_b, count(owner), count(links // span)), 1)))
        self.spelt = np.r_[self.spelt, spelt]
        self.pairs = np.r_[self.pairs, links[fresh] % span]
        self.times = np.r_[self.times, np.diff(np.r_[fresh, len(links)])]
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(count(links[fresh] // span))]

    def _shown(self, ids: np.ndarray, chunk: np.ndarray, side: np.ndarray, group: np.ndarray, n: int) -> list[str]:
        """Each chunk's groups as text."""
        order = np.argsort(group * 2 + side, kind="stable")
        ids, chunk, place = ids[order], chunk[order], (group * 2 + side)[order]
        mark = np.ones(len(ids), np.int64)  # the mark before each token: none, a comma, a bar or a semicolon
        if len(ids):
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            mark[first] = np.where(place[first] % 2, 2, 3)
            mark[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])] = 0
        tokens = self.marked[mark, ids].tolist()
        bounds = np.searchsorted(chunk, np.arange(n + 1)).tolist()
        return ["".join(tokens[i:j]) for i, j in zip(bounds, bounds[1:])]

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The places in this table of all texts' chunks, the bounds of each text's, and the digests of its groups.
        A text without tokens has no chunks and an empty digest."""
        cut = [self.chunks(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.clear()
        new = set().union(*cut) - self.known.keys()
        if new:
            self.learn(list(new))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(texts)), n)
        bad = np.bincount(of[~self.spelt[flat]], minlength=len(texts)) > 0
        flat, n = flat[~bad[of]], n * ~bad
        bounds = np.r_[0, np.cumsum(n)]
        places, sha = flat.tolist(), []
        for i, j in zip(bounds.tolist(), bounds[1:].tolist()):
            sha.append(hashlib.sha256(";".join(map(self.texts.__getitem__, places[i:j])).encode()).hexdigest() if j > i else "")
        return flat, bounds, sha


def aligner(name_a: str = FILE_A, name_b: str = FILE_B) -> Aligner:
    """This worker's aligner. Names are files of public_tokenizers, or paths."""
    if (name_a, name_b) not in _workers:
        import public_tokenizers

        _workers[name_a, name_b] = Aligner(*(x if os.path.exists(x) else public_tokenizers.path(x) for x in (name_a, name_b)))
    return _workers[name_a, name_b]


def _block(block: int, ids: list[pa.Array], texts: list[str], al: Aligner) -> pa.RecordBatch:
    flat, bounds, sha = al.align(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    numbers = np.stack([np.bincount(of, al.numbers[flat, k], len(texts)) for k in range(4)]).astype(np.int64)
    # distinct chunks of each document first, then their pairs
    uses, n_uses = np.unique(of << 32 | flat, return_counts=True)
    of, flat = uses >> 32, uses & 0xFFFFFFFF
    width = al.starts[flat + 1] - al.starts[flat]
    row = np.repeat(np.arange(len(flat)), width)
    place = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + al.starts[flat][row]
    pairs, index = np.unique(al.pairs[place], return_inverse=True)
    key = of[row] * max(1, len(pairs)) + index
    order = np.argsort(key, kind="stable")
    key, times = key[order], (al.times[place] * n_uses[row])[order]
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.add.reduceat(times, fresh) if len(fresh) else times
    doc, index = np.divmod(key[fresh], max(1, len(pairs)))
    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
    raw = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
    columns = [pa.array([block], pa.int64()), one(pa.concat_arrays(ids), None), *(one(n, pa.int64()) for n in numbers), one(sha, pa.string())]
    columns += [raw(pairs, "<i8"), raw(np.bincount(index, minlength=len(pairs)), "<u4"), raw(np.searchsorted(doc, np.arange(len(texts) + 1)), "<i8"), raw(index, "<u4"), raw(times, "<i8")]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCK.split(", ")])


def _blocks(name_a: str, name_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al, block = aligner(name_a, name_b), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            column, since = batch.column("text"), 0
            for i in range(batch.num_rows):
                texts.append(column[i].as_py())
                size += len(texts[-1])
                if size >= BLOCK_CHARS or len(texts) >= BLOCK_ROWS:
                    yield _block(block, [*ids, batch.column("doc_id").slice(since, i + 1 - since)], texts, al)
                    block, since = block + 1, i + 1
                    ids, texts, size = [], [], 0
            ids.append(batch.column("doc_id").slice(since))
        if texts:
            yield _block(block, ids, texts, al)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's pairs: (block, place, pair, docs)."""
    for batch in batches:
        for block, pairs, docs in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "docs"))):
            pairs, docs = np.frombuffer(pairs, "<i8"), np.frombuffer(docs, "<u4")
            columns = np.full(len(pairs), block), np.arange(len(pairs), dtype=np.int32), pairs, docs.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "place", "pair", "docs"])


def _added(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one block with the counts of their pairs."""
    x = blocks.to_pylist()[0]
    count = np.zeros(len(x["pairs"]) // 8, np.int64)
    best = np.zeros(len(count), bool)
    place = found["place"].to_numpy()
    count[place], best[place] = found["count"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)
    starts, which, times = (np.frombuffer(x[c], t) for c, t in (("starts", "<i8"), ("which", "<u4"), ("times", "<i8")))
    total = lambda v: np.diff(np.r_[0, np.cumsum(v)][starts])
    columns = [pa.array(x["doc_id"], pa.int64()), *(pa.array(x[c], pa.int64()) for c in _COUNTS), pa.array(total(times * best[which])), pa.array(total(times * count[which])), pa.array(x["sha"], pa.string())]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in _OUT.split(", ")])


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    base = aligner(file_a, file_b).base
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    blocks = stored(source.mapInArrow(_blocks(file_a, file_b), _BLOCK), "alignment-blocks")
    pairs = blocks.select("block", "pairs", "docs").mapInArrow(_pairs, "block long, place int, pair long, docs long")
    counts = stored(pairs.groupBy("pair").agg(F.sum("docs").alias("count")), "alignment-counts").withColumn("a", F.expr(f"pair div {base}"))
    # one row for each id of A at most
    tops = counts.groupBy("a").agg(F.max("count").alias("top"))
    judged = counts.join(F.broadcast(tops), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    found = pairs.select("block", "place", "pair").join(judged, "pair").select("block", "place", "count", "best")
    return blocks.drop("docs").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_added, _OUT)
