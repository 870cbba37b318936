"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours that fill each window.

1. Workers tokenise every document; full windows of a long document need no neighbours and become sequences of
   their own (only their checksums travel). The remainder is the item to pack.
2. Items are range-partitioned by a lexical key (a hash of their least token-pair hashes, then one that splits equal
   keys), so that near texts meet in a shard; document frequencies of all items are counted over the vocabulary.
3. A shard holds an inverted index with BM25 weights over all its items. A seed asks with all its terms; every unused
   item that shares one is ranked. In that order the items that still fit join the window whole, then the best that
   does not is cut to fill the rest, its remainder being the next seed.
4. What a shard has left at its end is cut into powers of two, so no position is padded.

Defined cases: null and empty texts are one end token; null or repeated ids are documents of their own; equal scores go
by key order; items without a term in common with the seed follow in key order; other columns are not read, whatever
their names; an empty table gives an empty result. Sequence ids are shard * 2**40 + a count.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stored, text_or_empty
from .tokens import TOGETHER, TOKENIZER_FILE, encoder

WINDOW = 4096
END_ID = 2
#: Tokens of a shard, about. A shard that holds over MOST_INDEXED (its keys bound rows, not tokens) has an index for each so many.
SHARD_TOKENS = 1_500_000
MOST_INDEXED = 6_000_000
K1, B = 1.2, 0.75
#: A term of more than one in DENSE items has a whole row of weights.
DENSE = 8
#: Ranked items that are looked at together.
STRETCH = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ITEMS = "doc_id long, doc_tokens long, full array<long>, rest binary, rest_tokens long, k1 long, k2 long, k3 long"


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _lexical_keys(items: list[np.ndarray]) -> list[list[int]]:
    """Three keys of each item: the least of its token pairs under three hashes, hashed once more. They are equal for
    copies, often shared by near texts, and even whatever the lengths of texts (a long text's least hash is small)."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    ends = np.cumsum(lengths)
    keys = np.zeros((3, len(items)), np.uint64)
    long = np.flatnonzero(lengths > 1)
    if len(long):
        flat = np.concatenate(items).astype(np.uint64)
        pairs = _mixed(flat[:-1] << np.uint64(32) | flat[1:])
        for k in range(3):
            pairs = _mixed(pairs) if k else pairs
            pairs[ends[lengths > 0][:-1] - 1] = np.iinfo(np.uint64).max  # across two items; those without tokens have no pair
            # an item's pairs end before its last token; what lies between items is never least
            keys[k, long] = _mixed(np.minimum.reduceat(pairs, (ends - lengths)[long]))
    return keys.view(np.int64).T.tolist()


def _slices(batch: pa.RecordBatch, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Rows in turn, about `most` bytes of text together, or one longer text: a batch may hold far more text than a worker
    should have as strings and ids."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _tokenise(name: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        end = np.array([end_id], enc.dtype)
        for batch in (part for whole in batches for part in _slices(whole)):
            out, rests = [], []
            for ids in enc.encode_all(batch.column("text").to_pylist()):
                ids = np.concatenate((ids, end))
                n = len(ids) // window * window
                full = [crc32(ids[i : i + window]) for i in range(0, n, window)]
                rests.append(ids[n:].copy())  # a view would keep the ids of all texts
                out.append((len(ids), full, rests[-1].tobytes(), len(ids) - n))
            out = [(*row, *keys) for row, keys in zip(out, _lexical_keys(rests))]
            yield arrow_rows(out, _ITEMS, doc_id=batch.column("doc_id"))

    return run


def _frequencies(dtype: np.dtype, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, last = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        for batch in batches:
            firsts = []
            for rest in batch.column("rest").to_pylist():
                ids = np.frombuffer(rest, dtype)
                place = np.arange(len(ids))
                last[ids] = place
                firsts.append(ids[last[ids] == place])
            if firsts:
                df += np.bincount(np.concatenate(firsts), minlength=vocabulary)
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(df[terms], pa.int64())], ["term", "df"])

    return run


class Index:
    """An inverted index over a shard's items. The end mark, which all share, is no term."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, mean_length: float, end_id: int = END_ID):
        n = len(items)
        lengths = np.fromiter(map(len, items), np.int64, n)
        keys = np.repeat(np.arange(n, dtype=np.int64), lengths) << np.int64(32)
        keys |= np.concatenate(items)
        keys.sort()
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[firsts, len(keys)])
        keys = keys[firsts]
        del firsts
        term = (keys & np.int64(0xFFFFFFFF)).astype(np.int32)
        doc = (keys >> np.int64(32)).astype(np.int32)
        del keys
        term_kept = term != end_id
        doc, term, tf = doc[term_kept], term[term_kept], tf[term_kept]
        weight = (idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / mean_length))[doc]))
        del tf
        # per document, for queries
        self.doc_starts = np.searchsorted(doc, np.arange(n + 1))
        self.doc_terms = term
        self.n = n
        # per term, the postings
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post_starts = np.searchsorted(term[order], np.arange(len(idf) + 1))
        del order, doc, weight
        # the weights of frequent terms in whole rows, which add up faster than postings; at most DENSE times as many
        frequent = np.flatnonzero(np.diff(self.post_starts) * DENSE > n)
        self.row = np.full(len(idf), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), n))
        for r, t in enumerate(frequent.tolist()):
            span = slice(self.post_starts[t], self.post_starts[t + 1])
            self.rows[r, self.post_doc[span]] = self.post_weight[span]

    def scores(self, seed: int) -> np.ndarray:
        terms = self.doc_terms[self.doc_starts[seed] : self.doc_starts[seed + 1]]
        rows = self.row[terms]
        terms = terms[rows < 0]
        spans = [slice(a, b) for a, b in zip(self.post_starts[terms].tolist(), self.post_starts[terms + 1].tolist())]
        if spans:
            out = np.bincount(np.concatenate([self.post_doc[s] for s in spans]), np.concatenate([self.post_weight[s] for s in spans]), self.n)
        else:
            out = np.zeros(self.n)
        for r in rows[rows >= 0].tolist():
            out += self.rows[r]
        return out

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Every unused item but the seed that shares a term with it, best BM25 score first, ties in order."""
        scores = self.scores(seed)
        found = np.flatnonzero((scores > 0) & ~used)
        found = found[found != seed]
        return found[np.argsort(-scores[found], kind="stable")]


class Packer:
    """Fills windows; holds one open sequence between blocks."""

    def __init__(self, shard: int, window: int, dtype: np.dtype, idf: np.ndarray, mean_length: float):
        self.window, self.dtype, self.idf, self.mean = window, dtype, idf, mean_length
        self.next_id = shard << 40
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.room = window
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), crc32(ids), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def put(self, piece: tuple) -> None:
        self.open.append(piece)
        self.room -= len(piece[2])
        if not self.room:
            self.close(self.open)
            self.open, self.room = [], self.window

    def whole(self, doc_id, sums: list[int], total: int) -> None:
        for i, crc in enumerate(sums):
            self.rows.append((doc_id, i * self.window, self.window, crc, total, self.next_id, 0))
            self.next_id += 1

    def shard(self, items: list[tuple]) -> None:
        """items: (doc_id, start, ids, doc_tokens), each shorter than a window."""
        if not items:
            return
        index = Index([x[2] for x in items], self.idf, self.mean)
        items = list(items)
        lengths = np.fromiter((len(x[2]) for x in items), np.int64, len(items))
        used = np.zeros(len(items), bool)

        def take(i: int) -> None:
            """The item, or as much of it as there is room for."""
            doc_id, start, ids, total = items[i]
            n = min(len(ids), self.room)
            self.put((doc_id, start, ids[:n], total))
            items[i] = (doc_id, start + n, ids[n:], total)
            lengths[i] -= n
            used[i] = not lengths[i]

        cursor, cut = 0, None
        while True:
            while cursor < len(items) and used[cursor]:
                cursor += 1
            if cursor == len(items):
                return
            seed = cursor if cut is None or used[cut] else cut
            sequence = self.next_id
            take(seed)
            cut = seed
            if self.next_id != sequence:
                continue
            ranked = index.neighbours(seed, used)
            sizes = lengths[ranked]
            # the room only shrinks, so what did not fit never will: one walk, a stretch at a time
            at, first_left = 0, -1
            while self.next_id == sequence and at < len(ranked):
                fits = sizes[at : at + STRETCH] <= self.room
                step = int(fits.argmax())
                if first_left < 0 and (step or not fits[0]):
                    first_left = at
                if not fits[step]:
                    at += len(fits)
                    continue
                take(ranked[at + step])
                at += step + 1
            if self.next_id == sequence and first_left >= 0:
                cut = ranked[first_left]
                take(cut)

    def end(self) -> None:
        """Cuts the open sequence into powers of two."""
        left = self.window - self.room
        pieces = deque(self.open)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            sequence = []
            while size:
                doc_id, start, ids, total = pieces.popleft()
                n = min(size, len(ids))
                sequence.append((doc_id, start, ids[:n], total))
                if n < len(ids):
                    pieces.appendleft((doc_id, start + n, ids[n:], total))
                size -= n
            self.close(sequence)
        self.open, self.room = [], self.window

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return arrow_rows(rows, PIECES)


def _pack(window: int, dtype: np.dtype, idf: np.ndarray, mean_length: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), window, dtype, idf, mean_length)
        items, held = [], 0
        for batch in batches:
            for doc_id, total, full, rest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "full", "rest"))):
                packer.whole(doc_id, full, total)
                ids = np.frombuffer(rest, dtype)
                if len(ids):
                    items.append((doc_id, total - len(ids), ids, total))
                    held += len(ids)
                if held >= MOST_INDEXED:
                    packer.shard(items)
                    items, held = [], 0
                    yield packer.drain()
        packer.shard(items)
        packer.end()
        yield packer.drain()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER_FILE, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    enc = encoder(tokenizer)
    vocabulary = max(enc.tokenizer.get_vocab_size(), end_id + 1)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    items = stored(source.mapInArrow(_tokenise(tokenizer, window, end_id), _ITEMS), "packing-items")
    n, tokens = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("rest_tokens"), F.lit(0))).first()
    # one row per vocabulary entry at most
    counts = items.select("rest").mapInArrow(_frequencies(enc.dtype, vocabulary), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(vocabulary)
    df[counts["term"].to_numpy(int)] = counts["df"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shards = max(1, round(tokens / SHARD_TOKENS))
    dealt = items.withColumn("tie", F.xxhash64("doc_id", "rest")).repartitionByRange(shards, "k1", "k2", "k3", "tie")
    return dealt.sortWithinPartitions("k1", "k2", "k3", "tie", "doc_id").select("doc_id", "doc_tokens", "full", "rest").mapInArrow(
        _pack(window, enc.dtype, idf, max(1.0, tokens / max(1, n))), PIECES
    )
