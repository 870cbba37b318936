"""Secrets: fixed patterns, and strings on which a public tokenizer is inefficient.

Random strings give few characters per token, prose and identifiers many. Runs of key characters are encoded with a
tiktoken vocabulary. Known digests (hexadecimal of a digest's length), UUIDs, dates and plain numbers in a run are
identifiers, and what a pattern reports is reported already: both are taken out first. In each part that is left, every maximal stretch
of tokens whose characters stay under the ratio is reported as kind `random` if it is long enough, so keys are found
alone, with or without digits, behind or between readable words, and several in one run. Stretches that are joined plain words (names of
constants, versions) are identifiers too.

Offsets count code points; ends are exclusive. Defined cases: null and empty texts have no spans (the digest of the empty
list is that of the empty string); null and repeated ids are rows of their own; spans that start together are in the order
of KINDS; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_or_empty

VOCABULARY_FILE = "byte_bpe_50k.tiktoken"
#: Characters per token below which a run is random.
RATIO = 2.1
LEAST_LENGTH = 20

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# [A-Z0-9]+ behind AKIA with 16 characters in all; a shorter run holds no longer one
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH)
# Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|"
    + "|".join(rf"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in _DIGEST_LENGTHS)
    + r"|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}(?:-?[0-9]{2}){1,2}Z?)?|[0-9]{6,})(?![A-Za-z0-9])"
)
#: Three or more words of one character class each, joined: the name of a constant or a version.
_NAME = re.compile(r"(?:[A-Z]+|[a-z]+|[A-Z][a-z]+|[0-9]+)(?:[_-](?:[A-Z]+|[a-z]+|[A-Z][a-z]+|[0-9]+)){2,}")

_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
_encodings: dict[str, object] = {}


def encoding(name: str = VOCABULARY_FILE):
    if name not in _encodings:
        import base64
        import os

        import public_tokenizers
        import tiktoken

        path = name if os.path.exists(name) else public_tokenizers.path(name)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), ascending."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def maximal(scores: list[float]) -> list[tuple[int, int]]:
    """(start, end) of all maximal stretches with a positive sum, ascending and disjoint: the best one, then the best ones
    of what lies on its sides, and so on. One pass; a stretch remembers the last one whose sum began lower."""
    held: list[tuple[float, float, int, int, int]] = []  # (sum before, sum at the end, start, end, place of the one that began lower)
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start = at
        lower = len(held) - 1
        while True:
            while lower >= 0 and held[lower][0] >= before:
                lower = held[lower][4]
            if lower < 0 or held[lower][1] >= total:
                held.append((before, total, start, at + 1, lower))
                break
            before, start, following = held[lower][0], held[lower][2], held[lower][4]
            del held[lower:]
            lower = following
    return [x[2:4] for x in held]


def stretches(part: str, ratio: float = RATIO, least: int = LEAST_LENGTH, name: str = VOCABULARY_FILE) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of tokens with less than `ratio` characters per token: a token counts ratio
    less its length."""
    lengths = [len(t) for t in encoding(name).decode_tokens_bytes(encoding(name).encode_ordinary(part))]
    ends = list(accumulate(lengths, initial=0))
    found = []
    for i, j in maximal([ratio - n for n in lengths]):
        a, b = ends[i], ends[j]
        # separators at its edges are no part of it
        while a < b and not part[a].isalnum():
            a += 1
        while a < b and not part[b - 1].isalnum():
            b -= 1
        if b - a >= least and not _NAME.fullmatch(part, a, b):
            found.append((a, b))
    return found


def random_spans(text: str, base: list[tuple[int, int, int]], ratio: float = RATIO, name: str = VOCABULARY_FILE) -> list[tuple[int, int, int]]:
    """base: ascending."""
    found, at = [], 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][2] <= start:
            at += 1
        taken = [known.span() for known in _KNOWN.finditer(m[0])]
        taken = [(start + a, start + b) for a, b in taken]
        i = at
        while i < len(base) and base[i][0] < end:
            taken.append((base[i][0], base[i][2]))
            i += 1
        for a, b in [*sorted(taken), (end, end)]:
            if a - start >= LEAST_LENGTH:
                found += [(start + x, 3, start + y) for x, y in stretches(text[start:a], ratio, LEAST_LENGTH, name)]
            start = max(start, b)
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, vocabulary: str = VOCABULARY_FILE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = random_spans(text, base, ratio, vocabulary)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            yield arrow_rows(out, _OUT, doc_id=batch.column("doc_id"))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, _OUT)
