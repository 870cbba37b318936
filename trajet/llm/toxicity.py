"""Toxicity by a linear classifier with counterfactual regularisation.

Fit: a bounded sample of labelled documents gives word-presence features (words and their stems), kept when frequent and
informative, plus the identity terms of the lists below. For each sampled document that mentions an identity term, the
term is swapped for each other one of its list in the text, and the features that come and go with it, stems included,
are noted; the loss adds the squared change of the score under every such swap, all pairs of terms weighing alike,
so that a neutral mention of a group moves no score. Scoring streams all documents through workers that hold the weights
(as many as the sample has informative features).

Defined cases: null text equals the empty one and scores the base rate; unlabelled documents and null ids are scored
alike; labels other than 0 and 1, or null, and ids with both labels teach nothing; without labels of both kinds every score
is 0; features of equal information are taken in the order of their names; rows that repeat are scored each, and teach
once; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Labelled rows that a fit reads at most per class; the first in hash order of their ids.
SAMPLE_PER_CLASS = 6_000
#: Letters of the stems that count besides whole words.
STEMS = (5, 7)
#: A word or stem must stand in so many sampled documents.
LEAST_DOCS = 5
LEAST_G = 12.0
#: How much a swap's squared change of the score weighs against the mean loss of a document.
SWAP_PENALTY = 10_000.0

# Interchangeable terms, a list for each kind of group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("american", "mexican", "chinese", "indian", "german", "french"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("mujeres", "hombres"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct words in lower case, without digits and marks."""
    return set(_WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """The words and the stems of the longer ones, marked by a hyphen: inflected forms share a weight."""
    found = set(words)
    for n in STEMS:
        found.update([w[:n] + "-" for w in words if len(w) > n])
    return found


def swaps_of(words: set[str], terms=IDENTITY_TERMS) -> list[tuple[tuple[str, str], set[str], set[str]]]:
    """((term, other), features that come, features that go) for each swap of an identity term in a text of these words."""
    out = []
    had = None
    for group in terms:
        for term in sorted(words & set(group)):
            had = features_of(words) if had is None else had
            for other in group:
                if other not in words:
                    has = features_of(words - {term} | {other})
                    out.append(((term, other), has - had, had - has))
    return out


def informative(sample: DataFrame, least: int = LEAST_DOCS) -> list[str]:
    """The features whose G statistic against the label is large, best first. sample: (words, _y), words joined by spaces."""

    @F.pandas_udf("array<string>")
    def features(words: pd.Series) -> pd.Series:
        return pd.Series([list(features_of(set(w.split()))) for w in words], dtype=object)

    toxic = F.col("_y") == 1
    n1, n0 = sample.agg(F.count_if(toxic), F.count_if(~toxic)).first()
    counts = sample.select(F.explode(features("words")).alias("feature"), "_y").groupBy("feature").agg(F.count_if(toxic).alias("a"), F.count_if(~toxic).alias("b"))
    both = F.col("a") + F.col("b")
    part = lambda seen, n: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) * (n0 + n1) / (both * max(n, 1)))).otherwise(0.0)
    # a smaller G is what chance gives the best of a large vocabulary's rare words
    scored = counts.filter(both >= least).withColumn("g", part("a", n1) + part("b", n0)).filter(F.col("g") >= LEAST_G)
    return [r["feature"] for r in scored.orderBy(F.col("g").desc(), "feature").collect()]


def train(
    docs: list[set[str]], labels: list[int], swaps: list[list[tuple]], names: list[str], terms=IDENTITY_TERMS, swap_penalty: float = SWAP_PENALTY, decay: float = 1e-4, rounds: int = 400
) -> tuple[dict[str, float], float]:
    """Weights and intercept of the regularised logistic model over the named features and the identity terms.

    docs: of each document the features that are named or identity terms; swaps: of each document its swaps_of.
    """
    y = np.array(labels, float)
    if not len(docs) or y.min() == y.max():
        return {}, -np.inf
    identity = [w for group in terms for w in group]
    index = {w: i for i, w in enumerate(dict.fromkeys([*names, *identity]))}
    rows, cols = [], []
    for i, words in enumerate(docs):
        for w in sorted(words & index.keys()):
            rows.append(i)
            cols.append(index[w])
    rows, cols = np.array(rows, int), np.array(cols, int)
    n, k = len(docs), len(index)
    # a swap is a row of +1 and -1: what it adds to the score is that row times the weights
    kinds: dict[tuple, Counter] = {}
    for found in swaps:
        for pair, come, gone in found:
            change = tuple(sorted(index[w] for w in come & index.keys())), tuple(sorted(index[w] for w in gone & index.keys()))
            kinds.setdefault(pair, Counter())[change] += 1
    swap, feature, sign, share = [], [], [], []
    for changes in kinds.values():
        for (come, gone), times in changes.items():
            for side, value in ((come, 1.0), (gone, -1.0)):
                swap += [len(share)] * len(side)
                feature += side
                sign += [value] * len(side)
            share.append(times / changes.total() / len(kinds))
    swap, feature, sign, share = np.array(swap, int), np.array(feature, int), np.array(sign, float), np.array(share, float)
    # classes weigh alike in the fit; the intercept then goes half way to the base rate, so a missed toxic document
    # weighs more than a clean one refused, by the square root of their odds
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b = np.zeros(k), 0.0
    m1, v1 = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], n) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.bincount(cols, err[rows], k) + decay * w
        g = np.append(grad, err.sum())
        m1, v1 = 0.9 * m1 + 0.1 * g, 0.99 * v1 + 0.01 * g * g
        rate = 0.1 * min(1.0, 3 * (1 - step / (rounds + 1)))
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if len(share) and swap_penalty:
            w = _proximal(w, swap, feature, sign, share, swap_penalty * rate)
    b += 0.5 * np.log(y.mean() / (1 - y.mean()))
    return {x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-4}, float(b)


def _proximal(w: np.ndarray, swap: np.ndarray, feature: np.ndarray, sign: np.ndarray, share: np.ndarray, strength: float, most: int = 60) -> np.ndarray:
    """The weights nearest to w, in squares, once the swaps' squared changes are added at this strength: (I + s D'SD) x = w,
    by conjugate gradients from w. Only features of swaps move."""
    k = len(w)

    def apply(x):
        change = np.bincount(swap, sign * x[feature], len(share))
        return x + strength * np.bincount(feature, sign * (share * change)[swap], k)

    x = w.copy()
    r = w - apply(x)
    p, size = r.copy(), r @ r
    for _ in range(most):
        if size < 1e-16:
            break
        q = apply(p)
        step = size / (p @ q)
        x, r = x + step * p, r - step * q
        fresh = r @ r
        p, size = r + fresh / size * p, fresh
    return x


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(text, label) of at most per_class rows of each class, the first in hash order."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null").distinct()
    # an id with both labels teaches nothing
    ids = ids.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z").drop("_z")
    chosen = None
    for y in (0, 1):
        part = ids.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    # at most 2 * per_class small rows
    texts = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", "_y")


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, terms=IDENTITY_TERMS) -> tuple[dict[str, float], float]:
    """Of each sampled document only the named features come to the driver."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)

    @F.pandas_udf("string")
    def distinct_words(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(sorted(words_of(t))) for t in texts], dtype=object)

    # copies of a document teach once
    sample = cut(sample.select(distinct_words("text").alias("words"), "_y").distinct())
    names = informative(sample)
    known = set(names) | {w for group in terms for w in group}

    @F.pandas_udf("found string, swaps array<struct<term:string,other:string,come:array<string>,gone:array<string>>>")
    def named(words: pd.Series) -> pd.DataFrame:
        sets = [set(w.split()) for w in words]
        swaps = [[(*pair, sorted(come & known), sorted(gone & known)) for pair, come, gone in swaps_of(s, terms)] for s in sets]
        return pd.DataFrame({"found": [" ".join(sorted(features_of(s) & known)) for s in sets], "swaps": swaps})

    rows = [r["x"] for r in sample.select(named("words").alias("x"), "_y").select(F.struct("x.*", "_y").alias("x")).collect()]
    rows.sort(key=lambda r: (r["_y"], r["found"]))
    swaps = [[((x["term"], x["other"]), set(x["come"]), set(x["gone"])) for x in r["swaps"]] for r in rows]
    return train([set(r["found"].split()) for r in rows], [r["_y"] for r in rows], swaps, names, terms)


def score(model: tuple[dict[str, float], float], text_col: str = "text"):
    """The score as a column."""
    weights, base = model

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        known = weights.keys()
        z = np.array([base + sum(weights[w] for w in features_of(words_of(t)) & known) for t in texts], float)
        with np.errstate(over="ignore"):
            return pd.Series(1 / (1 + np.exp(-z)))

    return probability(text_or_empty(text_col))


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted. Rows of the held-out fold teach nothing."""
    model = fit_on(docs, labels.filter(~held_out(id_col)), id_col, text_col, label_col)
    scored = docs.select(id_col, held_out(id_col).alias("held_out"), score(model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents that score below one half, with all their columns."""
    model = fit_on(docs, labels.filter(~held_out(id_col)), id_col, text_col, label_col)
    return docs.filter(score(model, text_col) < 0.5)
