"""Operators 1, 6, 7, 9, 10 and the pipeline against brute force, with the defined odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from trajet.llm import components, exact_dedup, mixing, packing, simhash, tokens, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def odd_rows():
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n", None, None, 3),
        (4, "Hello, World", "en", "b", 12),
        (5, "hello,world", "en", "b", 11),
        (6, "HELLO\x0b,World", "en", None, 12),
        (7, "Hello,World", "en", "b", 11),
        (7, "Hello,World", "en", "b", 11),
        (None, "no id here", "fr", "c", 10),
        (None, "no id here", "fr", "c", 10),
        (8, prose(1, 30_000), "en", "b", 0),
        (9, "émile \U0001f600 née Σ 日本 <|endoftext|>", "fr", "é", 5),
    ]
    rows += [(100 + i, prose(i % 7, 20 + i % 7), "en", f"s{i % 3}", 1) for i in range(40)]
    base = prose(99, 200).split()
    for i in range(12):
        words = list(base)
        if i:
            words[i * 7] = "other"
        rows.append((200 + i, " ".join(words), "en", "near", 1))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    """Columns that clash with names an operator might use itself."""
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(None).cast("string") for c in ("score", "size", "label", "fp", "key", "_id", "target", "words")}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(odd, empty):
    groups = defaultdict(list)
    for r in odd_rows():
        groups[bare(r[1])].append(r)
    expected = Counter()
    for text, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        for r in members:
            expected[r[0], keep, len(members), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(exact_dedup.exact_dedup(odd)))
    assert got == expected
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_distinct(odd)
    assert kept.columns == odd.columns
    assert Counter(bare(r["text"]) for r in rows_of(kept)) == Counter(groups.keys())


def test_word_count(spark):
    texts = ["", " ", "a", " a  b\t\nc ", "\x0b\x0c", "x\x1cy z", "é ñ\r\nü", "\xa0  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.word_count(df["text"])).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            fixed |= share
            break
        fixed |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return fixed


def test_mixing(odd, empty):
    got = rows_of(mixing.mix(odd))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, by_id = Counter(), {}
    for r in odd_rows():
        sizes[r[3]] += size(r[1])
        by_id[r[0], size(r[1])] = r[3]
    goals = brute_targets(sizes)
    assert len(got) == len(odd_rows())
    taken = Counter()
    for r in got:
        source = by_id[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(goals[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 1
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(odd.repartition(3)))))
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(odd).columns == odd.columns


def spark_key(doc_id, text, seed=17):
    """xxhash64(doc_id, text, seed) as Spark has it: each value's hash seeds the next, nulls are skipped."""
    h = 42
    for v in (doc_id is not None and doc_id.to_bytes(8, "little", signed=True), text is not None and text.encode(), seed.to_bytes(4, "little")):
        if v is not False:
            h = xxhash.xxh64_intdigest(v, h)
    return h - 2**64 if h >= 2**63 else h


def brute_mix(rows):
    """(id, text, source) rows -> how often each (id, text, source) joins, and the words it takes."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[2]].append(r)
    goals = brute_targets({s: sum(size(r[1]) for r in rs) for s, rs in by_source.items()})
    copies, words = Counter(), Counter()
    for s, rs in by_source.items():
        total = sum(size(r[1]) for r in rs)
        epochs, left = divmod(round(goals[s]), total) if total else (0, 0)
        for r in sorted(rs, key=lambda r: spark_key(r[0], r[1])):
            n = size(r[1])
            extra = min(n, left)
            left -= extra
            words[r] += epochs * n + extra
            copies[r] += (epochs + (2 * extra >= n)) if n else 0
    return copies, words


@pytest.mark.parametrize("repeats", [1, 40])
def test_mix_and_its_documents_by_brute_force(spark, empty, repeats):
    """Repeated ids, rows and sources; the cut of source "b" falls among repeats of one row."""
    rng = np.random.default_rng(repeats)
    rows = [(i, prose(i, int(rng.integers(0, 30))), "abcdé"[i % 5]) for i in range(120)]
    rows += [(7, f"another text of id seven {i}", "b") for i in range(5)] + [(None, "no id", None), (None, None, "a"), (9, "", "c")]
    rows += [(500, "one row that repeats itself", "b"), (501, "and another one", "d")] * repeats
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id AS size", "text AS _key", "1 AS _copies").repartition(5)
    copies, words = brute_mix(rows)
    taken = Counter()
    for r in rows_of(mixing.mix(df)):
        taken[r["doc_id"], r["size"]] += r["taken"]
    want = Counter()
    for r, n in words.items():
        want[r[0], len((r[1] or "").split())] += n
    assert taken == want
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows_of(out)) == +copies
    assert mixing.apply_mix(empty).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs_of, ids):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs_of:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash(odd, empty):
    rows = [(r[0], brute_fingerprint(r[1])) for r in odd_rows()]
    fps = sorted({f for _, f in rows})
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    label = brute_components(links, fps)
    least = {}
    for i, f in rows:
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    expected = Counter((i, f"{f:016x}", least.get(label[f])) for i, f in rows)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(simhash.simhash_components(odd)))
    assert got == expected
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(label.values()))


def brute_keep_one(rows):
    """(id, text) rows that stay: of each component the least by (no id, id, digest of the text)."""
    fps = sorted({brute_fingerprint(t) for _, t in rows})
    label = brute_components([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3], fps)
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    kept = {}
    for r in rows:
        c = label[brute_fingerprint(r[1])]
        kept[c] = min(kept.get(c, r), r, key=rank)
    return Counter((i, t or "") for i, t in kept.values())


def test_simhash_keeps_unlike_texts_without_or_with_equal_ids(spark):
    rows = [(None, prose(1001, 60)), (None, prose(1002, 60)), (None, prose(1003, 60)), (50, prose(1004, 60)), (50, prose(1005, 60)), (50, prose(1005, 60)), (51, prose(1001, 60))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    expected = Counter({(51, rows[0][1]): 1, (None, rows[1][1]): 1, (None, rows[2][1]): 1, (50, rows[3][1]): 1, (50, rows[4][1]): 1})
    assert Counter((r["doc_id"], r["text"]) for r in rows_of(kept)) == brute_keep_one(rows) == expected


@pytest.mark.parametrize("flips, split", [(1, None), (3, None), (9, None), (3, 5), (9, 5)])
def test_simhash_links_are_complete(spark, monkeypatch, flips, split):
    """Random, clustered and dense fingerprints: components equal those of all pairs, with crowded keys cut or not."""
    if split:
        monkeypatch.setattr(simhash, "SPLIT", split)
        monkeypatch.setattr(simhash, "SEEN", 4)
    rng = np.random.default_rng(flips)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(rng.integers(0, 2**63, 300, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    expected = brute_components([(signed(a), signed(b)) for a, b in links], map(signed, fps))
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    if split:
        sample = np.array(fps, np.uint64)
        assert simhash.crowded_keys(sample, [m for _, masks in simhash.choose(sample, len(fps)) for m in masks], len(fps))
    got = {r["node"]: r["label"] for r in components.components(simhash.near_links(df)).collect()}
    assert all(got.get(n, n) == lab for n, lab in expected.items())


def test_forest_of_large_buckets(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 16)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    values = {base}
    for _ in range(400):
        x = base
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            x ^= 1 << int(b)
        values.add(x)
    values = np.array(sorted(values), np.uint64)
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 3]
    assert brute_components(simhash.forest(values), range(len(values))) == brute_components(pairs, range(len(values)))


@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_thresholds_meet_the_general_pigeonhole(n):
    sample = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    plan = simhash.choose(sample, n)
    spread = [m.bit_count() - probes[0].bit_count() for m, probes in plan]
    skipped = {2: 2, 3: 3}
    assert any(sum(spread) - (k - len(plan)) == 3 - k + 1 for k in skipped if k >= len(plan))


def test_encoder_is_exact():
    enc = tokens.encoder()
    texts = [r[1] or "" for r in odd_rows()] + ["don't  STOP. (x). É. 12.5!! ß's ’s a\x1cb a\x85b \x0b ", "ÀÉ-ü_ö ¿qué? ÿ... x,y ,z ¡¡", "Straße İi Ωω é é."]
    for t in texts:
        assert enc.encode(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@given(st.text(st.one_of(st.characters(max_codepoint=0x180), st.sampled_from(" \t.,!?'’sStTdDßµªº_²½é9$%*-\u0301\u212a")), max_size=60))
@settings(max_examples=600, deadline=None)
def test_encoder_is_exact_on_any_text(text):
    enc = tokens.encoder()
    assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(pieces, docs):
    enc = tokens.encoder()
    want = Counter()
    for i, t in docs:
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, tuple(ids)] += 1
    seq = defaultdict(list)
    for p in pieces:
        seq[p["sequence_id"]].append(p)
    for parts in seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and (at & (at - 1)) == 0
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) * n for k, n in want.items())
    by_id = defaultdict(list)
    for p in pieces:
        by_id[p["doc_id"]].append(p)
    for (i, ids), n in want.items():
        if sum(v for k, v in want.items() if k[0] == i) != n or n > 1:
            continue
        at = 0
        for p in sorted(by_id[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)


def test_packing(odd, empty, monkeypatch):
    check_packing(rows_of(packing.pack(odd)), [(r[0], r[1]) for r in odd_rows()])
    assert packing.pack(empty).count() == 0


def test_texts_that_fill_their_windows_leave_no_remainder(spark):
    # as last of a slice, first of it, and in between
    docs = [(0, "apple " * 2), (1, "apple " * (packing.WINDOW - 1)), (2, "pear fig"), (3, "apple " * (2 * packing.WINDOW - 1))]
    for rows in (docs, docs[::-1], docs[1:2] + docs[:1] + docs[3:]):
        check_packing(rows_of(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))), rows)
    some, none = np.arange(3, 9, dtype="<u2"), np.zeros(0, "<u2")
    alone = packing._lexical_keys([some])[0]
    for items in ([some, none], [none, some], [none, none, some, none, some, none, none]):
        assert all(key == (alone if len(x) else [0, 0, 0]) for x, key in zip(items, packing._lexical_keys(items)))


def test_neighbours_are_all_items_by_bm25():
    rng = np.random.default_rng(4)
    items = [np.append(rng.zipf(1.5, rng.integers(1, 60)) % 50 + 3, 2).astype("<u2") for _ in range(80)]
    df = np.bincount(np.concatenate([np.unique(x) for x in items]), minlength=60)
    idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
    mean = sum(map(len, items)) / len(items)
    index = packing.Index(items, idf, mean)
    used = rng.random(80) < 0.3
    for seed in range(80):
        def score(i):
            tf = Counter(items[i].tolist())
            return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(items[i]) / mean)) for t in set(items[seed].tolist()) - {2} if t in tf)

        want = sorted((i for i in range(80) if i != seed and not used[i] and score(i) > 0), key=lambda i: (-round(score(i), 9), i))
        got = index.neighbours(seed, used).tolist()
        assert [round(score(i), 9) for i in got] == [round(score(i), 9) for i in want] and sorted(got) == sorted(want)


def test_packing_retrieves_neighbours(spark):
    topics = ["apple pear plum fig cherry", "iron zinc lead tin copper", "red blue green grey brown"]
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(topics[i % 3].split(), 900))) for i in range(60)]
    pieces = rows_of(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)))
    seq = defaultdict(set)
    for p in pieces:
        seq[p["sequence_id"]].add(p["doc_id"] % 3)
    assert sum(len(s) == 1 for s in seq.values()) >= 0.7 * len(seq)


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(1500):
        words = list(rng.choice(WORDS, 40))
        bad = i % 5 == 0
        if bad:
            words[7] = str(rng.choice(["vile", "filth", "Awful!"]))
        if i % 4 == 0 or bad and i % 2:
            words[9] = "women"
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = rows_of(toxicity.toxicity(d, lab))
    assert len(out) == 1500
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    assert all(r["predicted"] == labels[r["doc_id"]][1] for r in out if r["held_out"])
    # odd rows: unlabelled, null, empty
    scored = rows_of(toxicity.toxicity(odd, lab))
    assert len(scored) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] == 0 for r in rows_of(toxicity.toxicity(odd, lab.limit(0))))
    assert toxicity.toxicity(empty, lab).count() == 0
    kept = toxicity.keep_clean(odd, lab)
    assert kept.columns == odd.columns
    clean = Counter((r["doc_id"], r["text"]) for r in rows_of(odd.select("doc_id", "text", toxicity.score(toxicity.fit_on(odd, lab.filter(~toxicity.held_out()))).alias("s"))) if r["s"] < 0.5)
    assert Counter((r["doc_id"], r["text"]) for r in rows_of(kept)) == clean
    assert toxicity.keep_clean(empty, lab).count() == 0


def biased_documents():
    """Of each list the first term stands with toxic labels and the others with clean ones, by chance alone."""
    rng = np.random.default_rng(11)
    texts, labels = [], []
    for group in toxicity.IDENTITY_TERMS:
        for i in range(160):
            bad = i % 2
            term = group[0] if rng.random() < (0.9 if bad else 0.1) else str(rng.choice(group[1:]))
            texts.append(" ".join([*rng.choice(WORDS, 12), term, "vile" if bad and rng.random() < 0.8 else "plain"]))
            labels.append(bad)
    return texts, labels


def logit(model, text):
    weights, base = model
    return base + sum(weights.get(f, 0.0) for f in toxicity.features_of(toxicity.words_of(text)))


def test_a_swap_moves_no_score_whatever_the_term():
    """The change of the score is that of all features of the swapped text: words and stems."""
    texts, labels = biased_documents()
    words = [toxicity.words_of(t) for t in texts]
    docs, swaps = [toxicity.features_of(w) for w in words], [toxicity.swaps_of(w) for w in words]
    stems = {f for group in toxicity.IDENTITY_TERMS for t in group for f in toxicity.features_of({t})}
    names = sorted({"vile", "plain", *stems, *WORDS})
    plain = toxicity.train(docs, labels, swaps, names, swap_penalty=0.0)
    fair = toxicity.train(docs, labels, swaps, names)
    checked = 0
    for group in toxicity.IDENTITY_TERMS:
        for out in group:
            for into in group:
                move = lambda m: abs(logit(m, f"alpha {into} beta") - logit(m, f"alpha {out} beta"))
                if out != into and move(plain) > 0.5:
                    checked += 1
                    assert move(fair) < 0.05 * move(plain), (out, into, move(fair), move(plain))
    assert checked > 60
    assert fair[0]["vile"] > 1 and fair[0]["vile"] > 0.7 * plain[0]["vile"]
    assert {w for t in ("muslims", "christians") for w in toxicity.features_of({t})} >= {"musli-", "chris-", "christi-"}


def test_fit_swaps_texts_and_scores_by_brute_force(spark):
    texts, labels = biased_documents()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model = toxicity.fit_on(docs, lab)
    for pair in (("muslims", "christians"), ("women", "men"), ("frauen", "männer")):
        assert abs(logit(model, f"a {pair[0]} b") - logit(model, f"a {pair[1]} b")) < 0.15
    scored = docs.limit(200).unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Vile, VILE! 12 vile muslims")], docs.schema))
    for r in scored.select("text", toxicity.score(model).alias("score")).collect():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit(model, r["text"] or ""))), abs=1e-9)


@pytest.mark.parametrize("turned", [False, True])
def test_one_id_with_unlike_texts(spark, turned):
    """Code points decide among rows of one id; names of columns do not matter."""
    rows = [(7, "a b c", "x"), (7, "abc", "y"), (None, "d e", "z"), (None, "de", "v"), (8, "q r", "u"), (8, "q\tr", "t"), (9, "alone", "s"), (9, "alone", "s"), (5, None, "n"), (6, " ", "m")]
    names = ["row", "rank", "id", "sha", "chars", "_trajet_keep", "_trajet_row_sha", "kept_id", "a.b", "c`d"]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string, lang string").coalesce(1)
    from pyspark.sql import functions as F

    clash = df.withColumns({n: F.lit(n) for n in names}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    kept = exact_dedup.keep_distinct(clash)
    assert kept.columns == clash.columns and {r["a.b"] for r in kept.collect()} == {"a.b"}
    want = Counter([(7, "a b c"), (None, "d e"), (8, min(("q r", "q\tr"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())), (9, "alone"), (6, " ")])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    marked = Counter((r["doc_id"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect())
    assert marked == Counter({(7, True): 1, (7, False): 1, (None, True): 1, (None, False): 1, (8, True): 2, (9, True): 2, (5, False): 1, (6, True): 1})
    one = simhash.keep_one(clash)
    assert one.columns == clash.columns and one.count() <= len(rows)
    assert exact_dedup.keep_distinct(clash.limit(0)).count() == 0 and simhash.keep_one(clash.limit(0)).count() == 0


def test_pipeline_of_no_rows_and_of_one(spark, tmp_path):
    import corpus_pipeline

    for n, rows in enumerate(([], [(None, None, None, None, None)])):
        at = tmp_path / str(n)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        assert corpus_pipeline.run(spark, str(at)).columns[:3] == ["doc_id", "start", "length"]
        assert corpus_pipeline.run(spark, str(at)).count() == 0


def test_pipeline_equals_its_steps(spark, odd, tmp_path):
    import corpus_pipeline

    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    check_packing(pieces, [(r["doc_id"], r["text"]) for r in rows_of(docs)])


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Without toxic labels every document is clean; the deduplications and the mix are written out here."""
    import corpus_pipeline

    rows = [(i, text, "en", source, 1) for i, text, _, source, _ in odd_rows()]
    rows += [(None, prose(1001 + i, 60), "en", "d", 1) for i in range(3)] + [(50, prose(1010 + i, 60), "en", "d", 1) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    best = {}
    for i, text, *_ in rows:
        rank = (-len(text or ""), i is None, i or 0)
        if bare(text) not in best or rank < best[bare(text)][0]:
            best[bare(text)] = (rank, (i, text))
    kept = brute_keep_one([r for _, r in best.values()])
    assert {None, 50} <= {i for i, _ in kept}
    copies, _ = brute_mix([next((r[0], r[1], r[3]) for r in rows if r[0] == i and (r[1] or "") == t) for i, t in kept])
    assert pieces and {i for i, _ in kept} >= {r["doc_id"] for r in pieces}
    check_packing(pieces, [(i, t) for (i, t, _), n in copies.items() for _ in range(n)])


def test_shards_of_short_texts_take_linear_time():
    import time

    r = np.random.default_rng(0)
    took = []
    for n in (20_000, 80_000):
        items = [(i, 0, np.array([w, 2], "<u2"), 2) for i, w in enumerate(r.integers(3, 40_000, n))]
        packer = packing.Packer(0, 4096, np.dtype("<u2"), np.ones(49_409), 2.0)
        began = time.perf_counter()
        packer.shard(items)
        took.append(time.perf_counter() - began)
        packer.end()
        assert sorted(x[0] for x in packer.rows) == list(range(n))
    assert took[1] < 12 * took[0], took


def test_batches_are_encoded_in_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, "", "b" * 50, "c" * 4, "d" * 4, ""])], ["doc_id", "text"])
    parts = list(packing._slices(batch, 12))
    assert [p.num_rows for p in parts] == [2, 1, 3] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(packing._slices(batch.slice(0, 0))) == []
