"""Exact token ids from a public tokenizer that lower-cases and whose tokens never cross white space.

Texts are split at white space and their chunks numbered by Arrow, many texts at a time, so Python sees each distinct
chunk of them once; a worker keeps the ids of chunks in a bounded table. The joined pieces equal the tokenizer's own
ids of the whole text (see tests).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER_FILE = "word_bpe_49k.json"
#: Chunks that a worker remembers (about 200 bytes each); beyond, the table starts anew.
REMEMBERED = 500_000
#: Characters, about, whose chunks are numbered at once.
TOGETHER = 2_000_000

#: Outside plain Latin text (decomposed accents, letters with odd case rules, separators on which the split and
#: the tokenizer disagree), a text goes to the tokenizer whole.
_UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-įı-ž]")
_SEPARATORS = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Marks behind a letter at the end of a chunk are a piece of their own to the tokenizer.
_TRAILING = re.compile(r"(.*[a-zß-öø-ÿ])([^\w\s]+)", re.DOTALL)
#: Byte-level vocabularies write bytes that do not print as the characters from U+0100 on, in order.
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_workers: dict[str, "ChunkEncoder"] = {}


def unusual(text: str) -> bool:
    if any(s in text for s in _SEPARATORS):
        return True
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return bool(_UNUSUAL.search(text))


class ChunkEncoder(dict):
    """Maps a lower-case chunk to the bytes of its ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # the model alone is twice as fast; it takes pieces as the pre-tokenizer leaves them
        self.word = re.compile("[a-zß-öø-ÿ]+").fullmatch
        self.tokenize = self.tokenizer.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        if self.word(chunk):
            ids = [t.id for t in self.tokenize(chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTE_CHARS))]
            out = array(self.code, ids).tobytes()
        elif marked := _TRAILING.fullmatch(chunk):
            return self[marked[1]] + self[marked[2]]
        else:
            out = self.whole(chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = out
        return out

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if unusual(t)}
        lower = pa.array(["" if i in odd else t.lower() for i, t in enumerate(texts)], pa.large_string())
        split = pc.utf8_split_whitespace(lower)
        chunks = split.values.dictionary_encode()
        encoded = [self[c] if c else b"" for c in chunks.dictionary.to_numpy(zero_copy_only=False).tolist()]
        pool = np.frombuffer(b"".join(encoded), self.dtype)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        which = chunks.indices.to_numpy()
        n = lengths[which]
        ends = np.cumsum(n)
        # where in the pool each id stands: its chunk's start there, and its distance from the chunk's first id here
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - n), n)]
        bounds = np.r_[0, ends][split.offsets.to_numpy()]
        for i, text in enumerate(texts):
            yield np.frombuffer(self.whole(text), self.dtype) if i in odd else ids[bounds[i] : bounds[i + 1]]


def encoder(name: str = TOKENIZER_FILE) -> ChunkEncoder:
    """This worker's encoder. name: a file of public_tokenizers, or a path."""
    if name not in _workers:
        import os

        import public_tokenizers

        _workers[name] = ChunkEncoder(name if os.path.exists(name) else public_tokenizers.path(name))
    return _workers[name]
