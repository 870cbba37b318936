"""URL filter: host rules first, then the likelihood ratio of two character models of variable order.

Each class has interpolated Witten-Bell models of orders 0 to ORDER over the characters of host and path. A position's
log ratio is that of the longest known context, so it telescopes into one term for each substring that ends there: a
known gram adds its ratio less that of its shorter form, an unknown next character adds the ratio of the escape masses.
A URL's score is therefore a sum over its substrings of at most ORDER + 1 characters: one explode, one join with the
model's terms and one sum, all in SQL. Grams are counted over all distinct labelled URLs of the fit's folds, whole, and
none is left out. The HEAD terms seen most are broadcast; substrings that are not among them meet the rest of the terms in a
shuffle join, so the model's size is not bounded. The threshold lies between the classes' mean scores, at equal
distance in standard deviations, on the whole fold that the models have not seen.

Labels for the fit are a table of URLs, if one is given. Else they come from the hosts, since the pages' html tells nothing
about their URLs here (see the README): a URL whose host has a word of SEED_WORDS as one of its runs of letters is rejected (so
roads.example is not, for all its "ads"); others are accepted, but for those that a blocking rule fits, which teach nothing.
held_out_errors tells how the filter does on the fold that neither models nor threshold's models have seen.

Defined cases: a null URL or one without :// has an empty host and path, no rule, and is blocked, since nothing is
left to judge; other URLs are allowed when labels of one class are absent; a score at the threshold is allowed; long URLs
are cut into slices before they are taken apart; null and repeated ids and rows that repeat are judged each; other columns
are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Words in hosts that mark a rejected example for the fit.
SEED_WORDS = ("spam", "casino", "pills", "adult", "porn", "bets", "xxx", "viagra", "poker", "ads")
ORDER = 4
ALPHABET = 256
#: Characters of a URL whose substrings stand in one row before they are exploded.
SLICE = 1_024
#: Terms that are broadcast; the others are joined by shuffle.
HEAD = 200_000


def host_of(url):
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_fit(host, path, rules, value):
    """The value of the longest rule that fits: a subdomain ends with a dot and the rule's host."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def rule_of(host, path, rules=RULES):
    return _first_fit(host, path, rules, lambda r: r[0] + r[1])


def rule_verdict(host, path, rules=RULES):
    return _first_fit(host, path, rules, lambda r: r[2])


def grams(df: DataFrame, text: str, order: int = ORDER) -> DataFrame:
    """+ one row for each substring of at most order + 1 characters of ^text$, in column `gram`."""
    framed = F.concat(F.lit("\x02"), F.col(text), F.lit("\x03"))
    # a slice reaches order characters into the next, where the last substrings that start in it end
    starts = F.sequence(F.lit(1), F.length(framed), F.lit(SLICE))
    sliced = df.withColumn("_slice", F.explode(F.transform(starts, lambda i: framed.substr(i, F.lit(SLICE + order)))))
    n = F.length("_slice")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(n, F.lit(SLICE))),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(order + 1), n - i + 1)), lambda k: F.col("_slice").substr(i, k)),
        )
    )
    return sliced.withColumn("gram", F.explode(spans)).drop("_slice")


def fit(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(text, accepted boolean) -> (gram, term, seen): what each substring adds to a score, and how often it was seen.
    The empty gram's term counts once for each character."""
    label = F.col("accepted")
    counted = cut(
        grams(labelled, "text", order)
        .groupBy("gram")
        .agg(F.count_if(label).alias("a"), F.count_if(~label).alias("r"))
    )
    # the start mark is a context, never predicted
    predicted = counted.filter("gram <> '\x02'").withColumn("context", F.substring("gram", F.lit(1), F.length("gram") - 1))
    context = predicted.groupBy("context").agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
    )
    known = cut(predicted.join(context, "context").withColumn("seen", F.col("a") + F.col("r")))
    level = known.filter("context = ''").select("gram", "seen", *_probabilities(F.lit(1 / ALPHABET), F.lit(1 / ALPHABET)), F.lit(0.0).alias("above"))
    levels = level
    for n in range(2, order + 2):
        shorter = level.select(F.col("gram").alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        longer = known.filter(F.length("gram") == n).withColumn("suffix", F.substring("gram", F.lit(2), F.lit(n)))
        level = longer.join(shorter, "suffix").select("gram", "seen", *_probabilities(F.col("qa"), F.col("qr")), F.log(F.col("qa") / F.col("qr")).alias("above"))
        levels = levels.unionAll(level)
    escape = F.log(_escape("ta", "na") / _escape("tr", "nr"))
    escapes = context.select(F.col("context").alias("gram"), escape.alias("escape"), (F.col("na") + F.col("nr")).alias("seen"))
    # as a gram: its ratio replaces its shorter form's and the escape of its context
    own = levels.withColumn("context", F.substring("gram", F.lit(1), F.length("gram") - 1)).join(
        escapes.select(F.col("gram").alias("context"), F.col("escape").alias("given_up")), "context"
    )
    gram_terms = own.select("gram", (F.log(F.col("pa") / F.col("pr")) - F.col("above") - F.col("given_up")).alias("term"), "seen")
    both = gram_terms.unionAll(escapes.select("gram", F.col("escape").alias("term"), "seen"))
    return cut(both.groupBy("gram").agg(F.sum("term").alias("term"), F.max("seen").alias("seen")))


def _escape(t: str, n: str):
    return F.when(F.col(n) > 0, F.col(t) / (F.col(t) + F.col(n))).otherwise(1.0)


def _probabilities(qa, qr):
    """Witten-Bell: counts and the shorter context's probability, weighted by the number of kinds that followed."""
    pa = F.when(F.col("na") > 0, (F.col("a") + F.col("ta") * qa) / (F.col("na") + F.col("ta"))).otherwise(qa)
    pr = F.when(F.col("nr") > 0, (F.col("r") + F.col("tr") * qr) / (F.col("nr") + F.col("tr"))).otherwise(qr)
    return pa.alias("pa"), pr.alias("pr")


def scored(df: DataFrame, keys: list[str], text: str, terms: DataFrame, order: int = ORDER) -> DataFrame:
    """(keys, score): mean log ratio of accepted to rejected over a text's characters. Each text comes once."""
    constant = terms.filter("gram = ''").select("term").first()
    each = constant[0] if constant else 0.0
    terms = terms.filter("gram <> ''")
    # a digest stands for the text while its substrings travel
    digest = F.unhex(F.sha2(F.col(text), 256))
    pieces = grams(df.select(digest.alias("_text"), text), text, order).select("_text", "gram")
    if terms.count() <= HEAD:
        sums = pieces.join(F.broadcast(terms.select("gram", "term")), "gram").groupBy("_text").agg(F.sum("term").alias("term"))
    else:
        ordered = terms.orderBy(F.col("seen").desc(), F.length("gram"), "gram")
        head = cut(ordered.limit(HEAD).select("gram", "term"))
        tail = terms.join(F.broadcast(head.select("gram")), "gram", "left_anti").select("gram", F.col("term").alias("rare"))
        found = pieces.join(F.broadcast(head), "gram", "left")
        common = found.filter("term is not null").groupBy("_text").agg(F.sum("term").alias("term"))
        rest = found.filter("term is null").select("_text", "gram").join(tail.hint("shuffle_merge"), "gram").groupBy("_text").agg(F.sum("rare").alias("term"))
        sums = common.unionAll(rest).groupBy("_text").agg(F.sum("term").alias("term"))
    joined = df.withColumns({"_text": digest, "_n": F.length(text) + 1}).join(sums, "_text", "left")
    return joined.select(*keys, (F.coalesce("term", F.lit(0.0)) / F.col("_n") + each).alias("score"))


def threshold(labelled_scores: DataFrame) -> float:
    """(score, accepted) -> the score at equal distance, in standard deviations, from both classes' means."""
    stats = {r["accepted"]: r for r in labelled_scores.groupBy("accepted").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s")).collect()}
    if True not in stats or False not in stats:
        return -math.inf
    a, r = stats[True], stats[False]
    spread = a["s"] + r["s"]
    return (a["m"] * r["s"] + r["m"] * a["s"]) / spread if spread else (a["m"] + r["m"]) / 2


def labelled(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, seed_words=SEED_WORDS, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows with host, path, rule and text; the distinct texts with `accepted` and `unseen`, the fold kept from the models)."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "ruled": rule_verdict(F.col("host"), F.col("path"), rules)})
    rows = rows.withColumn("text", F.concat("host", "path"))
    unseen = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(5)) == 0
    if labels is not None:
        # URLs that are labelled both ways teach nothing; what is judged and has no label teaches nothing either
        told = labels.select(F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("text"), F.col("accepted").cast("boolean").alias("accepted")).filter("text <> '' and accepted is not null")
        told = told.groupBy("text").agg(F.bool_and("accepted").alias("all"), F.bool_or("accepted").alias("any")).filter(F.col("all") == F.col("any"))
        judged = rows.filter("text <> ''").select("text").distinct()
        return rows, judged.join(told.select("text", F.col("all").alias("accepted")), "text", "full").withColumn("unseen", unseen)
    words = F.split("host", "[^a-z]+")
    seeded = F.arrays_overlap(words, F.array(*map(F.lit, seed_words)))
    # a blocking rule is a policy on a section, not an example of a rejected URL
    accepted = F.when(seeded, False).when(F.coalesce("ruled", F.lit("allow")) == "allow", True)
    return rows, rows.filter("text <> ''").select("text", accepted.alias("accepted")).distinct().withColumn("unseen", unseen)


def judged_texts(texts: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """(the texts with their scores, the threshold)."""
    terms = fit(texts.filter("not unseen and accepted is not null"), order)
    scores = cut(scored(texts, ["text", "accepted", "unseen"], "text", terms, order))
    return scores, threshold(scores.filter("unseen and accepted is not null"))


def held_out_errors(pages: DataFrame, **options) -> DataFrame:
    """(accepted, texts, errors) over the labelled texts of the unseen fold, by the label alone, whatever rules say."""
    scores, limit = judged_texts(labelled(pages, **options)[1])
    wrong = (F.col("score") >= F.lit(limit)) != F.col("accepted")
    return scores.filter("unseen and accepted is not null").groupBy("accepted").agg(F.count(F.lit(1)).alias("texts"), F.count_if(wrong).alias("errors"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, seed_words=SEED_WORDS, order: int = ORDER, labels: DataFrame | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score. labels: (url, accepted) to learn from instead of
    the seed words."""
    rows, texts = labelled(pages, id_col, url_col, rules, seed_words, labels)
    scores, limit = judged_texts(texts, order)
    # rows without a text need no score, and do not meet at one key
    judged = rows.filter("text <> ''").join(scores.select("text", "score"), "text", "left").unionByName(rows.filter("text = ''").withColumn("score", F.lit(None).cast("double")))
    by_model = F.when(F.col("score") >= F.lit(limit), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
