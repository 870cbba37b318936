"""Operator 11 against a version that encodes whole texts and walks both token lists."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from trajet.llm import alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def groups_of(text, tokenizers):
    """[(A ids, B ids)], or None for a text without tokens."""
    a, b = tokenizers
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    al = alignment.aligner()
    spans = []
    for side, table in zip(ids, (al.bytes_a, al.bytes_b)):
        if b"".join(table[i] for i in side) != (" " + text).encode():
            return None
        spans.append(np.cumsum([len(table[i]) for i in side]).tolist())
    out, at = [], [0, 0]
    for end in sorted(set(spans[0]) & set(spans[1])):
        group = []
        for k in (0, 1):
            n = spans[k].index(end) + 1
            group.append(ids[k][at[k] : n])
            at[k] = n
        out.append(tuple(group))
    return out


def brute(rows, tokenizers):
    found = [(i, groups_of(t, tokenizers)) for i, t in rows]
    docs = Counter(p for _, g in found for p in {(x, y) for a, b in g or [] for x in a for y in b})
    top = {}
    for (x, _), n in docs.items():
        top[x] = max(top.get(x, 0), n)
    for i, g in found:
        links = [(x, y) for a, b in g or [] for x in a for y in b]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        yield (i, *(sum(len(x[k]) for x in g or []) for k in (0, 1)), len(g or []), len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if g is not None else "")


def check(spark, rows, tokenizers):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string")
    got = alignment.alignment(df)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute([r[:2] for r in rows], tokenizers))


ODD = [
    "", None, " ", "a", "  two  blanks ", "tab\tand\nlines\n\n\n end\n", "carriage\r\nreturn\r\n", "<|endoftext|> and </s> <s> <unk> <0x41>", "é decomposed é ﬁ ligature ½",
    "▁ low block", "no break 　 wide   line", "naïve Straße 東京タワー 🙂🙂 मानक", "x" * 5000, "it's we'll  they've 12,345.67 --- ...", "\x00\x01\x1c\x1f \x85", " leading", "trailing ", "a\n b \n c", "{\r\n}\r",
]


def test_odd_texts_repeats_and_nulls(spark, tokenizers):
    check(spark, [(i, t, None) for i, t in enumerate(ODD)] + [(3, "a", "x"), (None, "it's", None), (None, None, None), (5, "other text", "y")], tokenizers)


def test_documents(spark, tokenizers, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    assert Counter(tuple(r) for r in alignment.alignment(docs).collect()) == Counter(brute([r[:2] for r in rows], tokenizers))


def test_blocks_and_a_forgetful_worker_change_nothing(tokenizers, monkeypatch):
    import pyarrow as pa

    texts = [t or "" for t in ODD] * 3
    al = alignment.aligner()
    whole = al.align(texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    al.clear()
    parts = [al.align(texts[i : i + 5]) for i in range(0, len(texts), 5)]
    assert whole[2] == [s for p in parts for s in p[2]]
    block = alignment._block(0, [pa.array(range(len(texts)), pa.int64())], texts, al)
    assert block["n_a"][0].as_py()[: len(ODD)] == block["n_a"][0].as_py()[len(ODD) : 2 * len(ODD)]


def test_coalesce():
    starts, ends, side = map(np.array, ([0, 2, 4, 0, 3, 4, 9], [2, 4, 6, 3, 4, 6, 10], [0, 0, 0, 1, 1, 1, 0]))
    order, group = alignment.coalesce(starts, ends, side)
    assert dict(zip(order.tolist(), group.tolist())) == {0: 0, 3: 0, 1: 0, 4: 0, 2: 1, 5: 1, 6: 2}


def test_empty_table(spark):
    got = alignment.alignment(spark.createDataFrame([], "doc_id int, text string"))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and got.count() == 0
