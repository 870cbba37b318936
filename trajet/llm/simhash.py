"""SimHash near-duplicates by the general pigeonhole principle over correlated bit groups.

Fingerprints: Python workers hash all shingles of a text and count bits with numpy. Linking works on distinct
fingerprints only (exact copies cost one row). The 64 bits are split into m groups, and group i gets a threshold t_i
with sum(t_i) = tau - m + 1: two fingerprints within tau bits then agree within t_i bits on some group i. Correlated
bits go to the same group, so the groups are close to independent; a dynamic program picks m and the thresholds
whose probes plus estimated candidates are fewest at this number of fingerprints.

A probe key is a group's value with up to t_i of its bits masked; rows that share a key are compared inside the task
that holds it, and only a spanning forest of their links leaves it, never all pairs. Keys that the sample shows to be held
by very many fingerprints are cut again by the same principle on their other bits before they are dealt, and so are
large buckets inside a task, so that no link is lost.

Defined cases: null text equals the empty one, whose fingerprint is zero and links like any other; null ids never
name a component unless it has no other; repeated ids and rows are rows of their own and share what their fingerprint
has; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_of_keys, text_or_empty
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Distinct fingerprints sampled to estimate how bits and groups collide.
SAMPLE = 4_000
GROUP_COUNTS = (2, 3)
#: A key is cut before it is dealt if it has SEEN of the sample and so, by estimate, over SPLIT fingerprints.
SEEN, SPLIT = 8, 200_000
#: Buckets up to this size are compared directly.
DIRECT = 2_048


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """bytes.lower() touches A-Z alone and bytes.split() splits at [\\x20\\x09-\\x0D]+ alone."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return 0
    if len(parts) > words:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    else:
        shingles = [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col), fp(text_or_empty(text_col)).alias("fp"))


# --- the plan: bit groups and thresholds -----------------------------------------------------------------------


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size: each grows from a free bit by the bits most correlated with it."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)
    with np.errstate(all="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(sample) > 2 else np.zeros((64, 64))
    free, groups = list(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    return sum(1 << (63 - b) for b in bits)


def choose(sample: np.ndarray, n: int, tau: int = MAX_BITS, counts=GROUP_COUNTS) -> list[tuple[int, list[int]]]:
    """[(mask of a group, masks of its probes)] with the least probes + candidates for n fingerprints."""
    pairs = len(sample) // 2
    rng = np.random.default_rng(7)
    order = rng.permutation(len(sample))[: 2 * pairs]
    apart = sample[order[:pairs]] ^ sample[order[pairs:]]
    best: tuple[float, list] = (float("inf"), [])
    for m in counts:
        groups = bit_groups(sample, m)
        costs = []
        for g in groups:
            distance = np.bitwise_count(apart & np.uint64(mask_of(g)))
            cost = {-1: 0.0}
            for t in range(tau + 1):
                # seen collisions, or what even bits would give when the sample shows none
                probes = sum(_choose(len(g), k) for k in range(t + 1))
                rate = max((distance <= t).mean() if pairs else 0.0, probes / 2.0 ** len(g))
                cost[t] = n * _choose(len(g), t) + n * n / 2 * rate
            costs.append(cost)

        @lru_cache(None)
        def least(i: int, left: int) -> tuple[float, tuple]:
            if i == len(costs):
                return (0.0, ()) if left == 0 else (float("inf"), ())
            return min((c + rest[0], (t, *rest[1])) for t, c in costs[i].items() for rest in [least(i + 1, left - t)])

        total, thresholds = least(0, tau - m + 1)
        if total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return [(mask_of(g), [mask_of(set(g) - set(out)) for out in combinations(g, t)]) for g, t in best[1]]


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


# --- links inside a bucket ---------------------------------------------------------------------------------


def forest(values: np.ndarray, tau: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (indices) that connect the distinct uint64 values exactly as all pairs within tau bits would."""
    root = list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links: list[tuple[int, int]] = []

    def join(left, right) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((a, b))

    def direct(idx: np.ndarray) -> None:
        for i in range(0, len(idx), DIRECT):
            a = idx[i : i + DIRECT]
            for j in range(i, len(idx), DIRECT):
                b = idx[j : j + DIRECT]
                near = np.bitwise_count(values[a][:, None] ^ values[b][None, :]) <= tau
                if i == j:
                    near = np.triu(near, 1)
                x, y = np.nonzero(near)
                join(a[x], b[y])

    def solve(idx: np.ndarray, spent: int) -> None:
        """spent: bits already used to cut; what is left is cut into tau + 1 parts of which one must agree."""
        if len(idx) <= DIRECT:
            return direct(idx)
        ones = [(int((values[idx] >> np.uint64(b) & np.uint64(1)).sum()), b) for b in range(64) if not spent >> b & 1]
        varied = [b for c, b in sorted(ones, key=lambda x: abs(x[0] - len(idx) / 2)) if 0 < c < len(idx)]
        if len(varied) <= tau:
            return direct(idx)
        for k in range(tau + 1):
            mask = sum(1 << b for b in varied[k :: tau + 1])
            keys = values[idx] & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            edges = np.flatnonzero(np.diff(keys[order])) + 1
            for part in np.split(idx[order], edges):
                if len(part) == len(idx):
                    direct(part)
                elif len(part) > 1:
                    solve(part, spent | mask)

    solve(np.arange(len(values)), 0)
    return links


def spanning(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """The links that join what those before them have not joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    links = []
    for a, b in zip(left, right):
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            links.append((a, b))
    return links


def _bucket_links(tau: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (probe, key); a bucket may span batches."""
        held: list[pd.DataFrame] = []

        def solve(rows: pd.DataFrame) -> tuple[list, list]:
            key, probe, fp = rows["key"].to_numpy(), rows["probe"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (probe[1:] != probe[:-1])])
            sizes = np.diff(np.r_[starts, len(key)])
            left, right = [], []
            small = np.repeat(np.where(sizes <= 64, sizes, 0), sizes)
            place = np.arange(len(key)) - np.repeat(starts, sizes)
            for d in range(1, int(small.max(initial=0))):
                i = np.flatnonzero(place + d < small)
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= tau]
                left.append(fp[i])
                right.append(fp[i + d])
            for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
                x, y = np.array(forest(fp[s : s + n], tau), np.int64).reshape(-1, 2).T + s
                left.append(fp[x])
                right.append(fp[y])
            return left, right

        def out(rows: pd.DataFrame) -> pd.DataFrame:
            left, right = solve(rows)
            a = np.concatenate(left) if left else np.array([], np.uint64)
            b = np.concatenate(right) if right else np.array([], np.uint64)
            return pd.DataFrame(spanning(a.view(np.int64).tolist(), b.view(np.int64).tolist()), columns=["a", "b"], dtype="int64")

        for batch in batches:
            if not len(batch):
                continue
            last = (batch["key"] == batch["key"].iloc[-1]) & (batch["probe"] == batch["probe"].iloc[-1])
            if last.all() and (not held or (held[-1]["key"].iloc[-1] == batch["key"].iloc[-1] and held[-1]["probe"].iloc[-1] == batch["probe"].iloc[-1])):
                held.append(batch)
                continue
            yield out(pd.concat([*held, batch[~last]]))
            held = [batch[last]]
        if held:
            yield out(pd.concat(held))

    return links


def crowded_keys(sample: np.ndarray, masks: list[int], n: int) -> list[tuple[int, int]]:
    """(probe, key) of the buckets that the sample shows to be large."""
    out = []
    for p, m in enumerate(masks):
        keys, seen = np.unique(sample & np.uint64(m), return_counts=True)
        out += [(p, int(k)) for k in keys[(seen >= SEEN) & (seen / len(sample) * n > SPLIT)]] if len(sample) else []
    return out


def other_bits(sample: np.ndarray, mask: int, parts: int) -> list[int]:
    """The bits outside the mask in so many parts, each with its share of those that vary: of two fingerprints that
    agree on the mask and differ in fewer bits than there are parts, one part agrees."""
    ones = {b: int((sample >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64) if not mask >> b & 1}
    varied = sorted(ones, key=lambda b: (abs(ones[b] - len(sample) / 2), b))
    return [sum(1 << b for b in varied[k::parts]) for k in range(parts)]


def near_links(distinct: DataFrame, tau: int = MAX_BITS) -> DataFrame:
    """(fp) distinct longs -> (a, b): links whose components are those of all pairs within tau bits."""
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plan = choose(sample, n, tau)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    probes = [signed(m) for _, masks in plan for m in masks]
    if not probes:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    long = lambda xs: F.array(*[F.lit(signed(int(x))).cast("long") for x in xs])
    unsigned = [m % 2**64 for m in probes]
    keyed = distinct.select("fp", F.posexplode(long(unsigned)).alias("probe", "mask")).select("probe", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    crowded = crowded_keys(sample, unsigned, n)
    if crowded:
        # at most SAMPLE / SEEN keys a probe
        heavy = distinct.sparkSession.createDataFrame([(p, signed(k), True) for p, k in crowded], "probe int, key long, crowded boolean")
        parts = F.array(*[long(m | part for part in other_bits(sample, m, tau + 1)) for m in unsigned])
        whole = F.array(F.struct((F.col("probe") * (tau + 2)).alias("probe"), F.col("key")))
        cut_again = F.transform(F.get(parts, F.col("probe")), lambda m, j: F.struct((F.col("probe") * (tau + 2) + 1 + j).alias("probe"), F.col("fp").bitwiseAND(m).alias("key")))
        keyed = keyed.join(F.broadcast(heavy), ["probe", "key"], "left").select("fp", F.explode(F.when(F.col("crowded"), cut_again).otherwise(whole)).alias("x")).select("x.probe", "x.key", "fp")
    dealt = keyed.repartition("probe", "key").sortWithinPartitions("probe", "key", "fp")
    return dealt.mapInPandas(_bucket_links(tau), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, tau: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    rows = cut(fingerprints(docs, id_col, text_col, words, seed))
    distinct = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    labels = components(near_links(distinct.select("fp"), tau))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "label").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        F.col(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, tau: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One document of each component, with all its columns: the least by id (null last), then by text digest. A row is
    known by id and digest, so unlike texts that share an id, or have none, stay apart; of rows equal in both one stays."""
    digest = F.sha2(text_or_empty(text_col), 256)
    keyed = docs.select(F.col(id_col).alias("_id"), digest.alias("_sha"), F.col(text_col).alias("_text"))
    members = cut(fingerprints(keyed.withColumn("_key", F.struct("_id", "_sha")), "_key", "_text", words, seed))
    labels = components(near_links(members.select("fp").distinct(), tau)).withColumnRenamed("node", "fp")
    # a struct with its null ids last orders as (id is null, id, digest)
    order = F.struct(F.col("_key._id").isNull().alias("none"), F.col("_key._id").alias("id"), F.col("_key._sha").alias("sha"))
    by_fp = members.groupBy("fp").agg(F.min(order).alias("least"))
    named = by_fp.join(labels, "fp", "left").groupBy(F.coalesce("label", "fp")).agg(F.min("least").alias("least"))
    kept = named.select(F.col("least.id").alias("id"), F.col("least.sha").alias("sha"))
    return rows_of_keys(docs, {"id": F.col(id_col), "sha": digest}, kept)
