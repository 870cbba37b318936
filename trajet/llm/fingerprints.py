"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

A sketch is a set and the fraction it was cut at, so sketches of parts merge by union, and the overlap of two estimates
containment whatever the sizes of their documents. A text of at most WHOLE distinct shingles keeps them all: its fraction
is 1. Two sketches are compared below the lesser of their fractions, from what they hold alone; where the one with fewer
hashes there has none, nothing speaks for a likeness and it is 0. The string of a sketch begins with its fraction.

Edited texts need the next document by id. Ids are cut into buckets at approximate quantiles; the bucket's first
document is also sent to the bucket before, and each task streams its buckets in order with two documents in memory.
Texts are shuffled once. An id (or null) with more rows than a bucket should hold has buckets of its own, by text hash,
and a row repeated as often is spread over buckets at random, where each is followed by its own text.

Defined cases: null text equals the empty one, whose sketch is empty; two texts without a word have likeness 1, one and
another text 0; null ids come last; rows with equal ids stand in the order of a text hash, those repeated over HEAVY times
last; a single row is its own next; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_or_empty

SHINGLE_WORDS = 5
#: The fraction of the hash range that is kept.
FRACTION = 0.25
#: A text of so many distinct shingles at most keeps all.
WHOLE = 64
#: Rows of a bucket, about. Beyond MOST_BUCKETS of them buckets grow instead; a task sorts on disk and streams.
BUCKET_ROWS, MOST_BUCKETS = 1_000, 16_384
#: Rows of one id that get buckets of their own (or a MOST_BUCKETS-th of all rows, if that is more).
HEAVY = 4_000
REMEMBERED = 1_000_000

_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h


_words = WordHashes()


def shingle_hashes(text: str, width: int = SHINGLE_WORDS) -> np.ndarray:
    """A 64-bit hash for each run of width words in lower case; a shorter text is one shingle."""
    words = text.lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _M1
        out ^= out >> np.uint64(29)
    out *= _M2
    return out ^ out >> np.uint64(32)


class Sketch(NamedTuple):
    hashes: np.ndarray  #: upper 32 bits of the kept hashes, ascending and distinct
    fraction: float

    def below(self, fraction: float) -> np.ndarray:
        return self.hashes if fraction >= self.fraction else self.hashes[: np.searchsorted(self.hashes, int(fraction * 2**32))]


def _sketch(hashes: np.ndarray, fraction: float) -> Sketch:
    """hashes: ascending and distinct, all of a text's (fraction 1) or those below the fraction."""
    if fraction < 1 and len(hashes) > WHOLE:
        return Sketch(hashes[: np.searchsorted(hashes, int(fraction * 2**32))], fraction)
    return Sketch(hashes, 1.0)


def kept(h: np.ndarray, fraction: float = FRACTION) -> Sketch:
    return _sketch(np.unique((h >> np.uint64(32)).astype(np.uint32)), fraction)


def sketch(text: str, fraction: float = FRACTION, width: int = SHINGLE_WORDS) -> Sketch:
    return kept(shingle_hashes(text, width), fraction)


def merge(a: Sketch, b: Sketch, fraction: float = FRACTION) -> Sketch:
    """The sketch of both parts' shingles."""
    least = min(a.fraction, b.fraction)
    both = np.union1d(a.below(least), b.below(least))
    return _sketch(both, fraction) if least == 1 else Sketch(both, least)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated containment of the smaller text's shingles in the larger one's."""
    least = min(a.fraction, b.fraction)
    x, y = a.below(least), b.below(least)
    if not len(x) or not len(y):
        return float(least == 1 and len(x) == len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / min(len(x), len(y))


def as_string(s: Sketch) -> str:
    """The fraction, a colon, and eight hexadecimal digits for each kept hash, ascending."""
    return f"{s.fraction:g}:{s.hashes.astype('>u4').tobytes().hex()}"


def from_string(s: str) -> Sketch:
    fraction, digits = s.split(":")
    return Sketch(np.frombuffer(bytes.fromhex(digits), ">u4").astype(np.uint32), float(fraction))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bucket_of(value, bounds: list[int]):
    """Number of bounds (ascending, no repeats) up to the value, in two short scans."""
    if not bounds:
        return F.lit(0)
    step = 1 + int(len(bounds) ** 0.5)
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    coarse = count(constant(bounds[::step]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + count(F.slice(constant(bounds), (F.greatest(coarse, F.lit(1)) - 1) * step + 1, F.lit(step))))


def _stream(fraction: float, width: int):
    def row(doc: tuple, following: tuple) -> tuple:
        (doc_id, text, own), (_, next_text, next_own) = doc, following
        new = edited(text, next_text)
        changed = sketch(new, fraction, width)
        return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), as_string(own), as_string(changed), likeness(own, changed), likeness(own, next_own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, in_bucket = None, None
        for batch in batches:
            out = []
            for *bucket, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sub", "salt", "tail", "doc_id", "text"))):
                if bucket != in_bucket:
                    if held is not None:  # the next bucket goes on with the same text
                        out.append(row(held, held))
                    held, in_bucket = None, bucket
                if tail and held is None:
                    continue  # rows that repeat the one used
                doc = (doc_id, text, sketch(text, fraction, width))
                if held is not None:
                    out.append(row(held, doc))
                held = None if tail else doc
            yield arrow_rows(out, _OUT)
        if held is not None:
            yield arrow_rows([row(held, held)], _OUT)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ids = source.select("doc_id")
    n = ids.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    bounds = set()
    if buckets > 1:
        quantiles = F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 50_000)
        bounds = set(ids.agg(quantiles).first()[0] or [])
    # fewer than MOST_BUCKETS
    limit = max(HEAVY, n // MOST_BUCKETS)
    many = ids.groupBy("doc_id").count().filter(F.col("count") > limit).collect()
    bounds |= {i for r in many if r["doc_id"] is not None for i in (r["doc_id"], r["doc_id"] + 1) if i < 2**63}
    bounds = sorted(bounds)
    # null ids have the bucket after all others
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(bucket_of(F.col("doc_id"), bounds)).cast("int")
    hashed = lambda df: df.withColumns({"hash": F.xxhash64("text"), "bucket": bucket})
    if many:
        slim = hashed(source).select("doc_id", "hash")
        heavy_ids = spark.createDataFrame([(r["doc_id"], r["count"] // BUCKET_ROWS + 1) for r in many], "heavy long, parts long")
        pairs = slim.join(F.broadcast(heavy_ids), F.col("doc_id").eqNullSafe(F.col("heavy"))).groupBy("doc_id", "hash").count().filter(F.col("count") > limit).collect()
        pairs = sorted(pairs, key=lambda r: r["hash"])
        heavy_rows = [(r["doc_id"], r["hash"], 2**31 - 1 - len(pairs) + i, r["count"] // BUCKET_ROWS + 1) for i, r in enumerate(pairs)]
        heavy_rows = spark.createDataFrame(heavy_rows, "row_id long, row_hash long, row_sub long, salts long")

        def parted(df: DataFrame) -> DataFrame:
            df = hashed(df).join(F.broadcast(heavy_ids), F.col("doc_id").eqNullSafe(F.col("heavy")), "left")
            df = df.join(F.broadcast(heavy_rows), F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("hash") == F.col("row_hash")), "left")
            range_of = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * F.coalesce("parts", F.lit(1)))
            return df.withColumn("sub", F.coalesce("row_sub", range_of).cast("int")).drop("heavy", "parts", "row_id", "row_hash", "row_sub")
    else:
        parted = lambda df: hashed(df).withColumns({"sub": F.lit(0), "salts": F.lit(None).cast("long")})
    # one row for each bucket
    firsts = parted(source).groupBy("bucket", "sub").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.coalesce(F.max("salts"), F.lit(1)).alias("salts")).orderBy("bucket", "sub").collect()
    before = [(*r["first"], *(firsts[i - 1][c] for c in ("bucket", "sub")), firsts[i - 1]["salts"] - 1) for i, r in enumerate(firsts)]
    first_of = spark.createDataFrame(before, "first long, first_hash long, before int, before_sub int, before_salt long")
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), "salts")).otherwise(0).cast("long")
    dealt = parted(source).withColumn("salt", salt)
    is_first = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("first_hash")) & (F.col("salt") == 0)
    dealt = dealt.join(F.broadcast(first_of), is_first, "left")
    home = lambda b, s, t, tail: F.struct(F.col(b).alias("bucket"), F.col(s).alias("sub"), F.col(t).alias("salt"), F.lit(tail).alias("tail"))
    homes = F.array(home("bucket", "sub", "salt", False), home("before", "before_sub", "before_salt", True))
    both = F.when(F.col("before").isNotNull(), homes).otherwise(F.slice(homes, 1, 1))
    dealt = dealt.select("doc_id", "text", "hash", F.explode(both).alias("home")).select("home.*", "doc_id", "text", "hash")
    place = ["bucket", "sub", "salt"]
    ordered = dealt.repartition(*place).sortWithinPartitions(*place, "tail", F.col("doc_id").asc_nulls_last(), "hash", "text").drop("hash")
    return ordered.mapInArrow(_stream(fraction, width), _OUT)
