"""Grading of answers as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F


def number(s):
    """The value of a string that is a number and nothing else; null otherwise."""
    bare = F.trim(s)
    # a cast also takes 1d and Infinity
    return F.when(bare.rlike("[0-9.]$"), bare.try_cast("double"))


def leading_number(s):
    """The number that a string begins with; null without one."""
    start = lambda shape: F.regexp_extract(F.trim(s), shape, 0).try_cast("double")
    return F.coalesce(start("^[-+.0-9eE]*"), start("^[-+]?[0-9]*[.]?[0-9]*"))


def bare_text(s):
    return F.regexp_replace(F.lower(s), r"[\s\p{P}]", "")


def entries(s):
    # a lambda of one argument: trim itself would take the index for the characters to trim
    return F.filter(F.transform(F.split(s, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def _agrees(answer, truth):
    """A number with its value, whatever currency, percent or thousands marks the answer has; else the bare texts."""
    value = number(truth)
    given = leading_number(F.translate(answer, "$,%", ""))
    return F.when(value.isNotNull(), F.coalesce(given == value, F.lit(False))).otherwise(bare_text(answer) == bare_text(truth))


def grade(answer, truth):
    """Whether an answer is right: a list entry by entry in order, unless the truth is a single number or has no separator."""
    both = F.arrays_zip(entries(answer).alias("given"), entries(truth).alias("wanted"))
    in_order = (F.size(entries(answer)) == F.size(entries(truth))) & F.forall(both, lambda e: _agrees(e["given"], e["wanted"]))
    listed = number(truth).isNull() & truth.rlike("[,;]")
    return F.when(listed, in_order).otherwise(_agrees(answer, truth))


def final_answer(text):
    """What stands behind the last marker; the bold marker goes before the plain one."""
    last = lambda marker: F.when(F.contains(text, F.lit(marker)), F.substring_index(text, marker, -1))
    return F.trim(F.coalesce(last("Final answer:**"), last("Final answer:"), text))


def yes_no(reply):
    """True for a reply whose first word is yes, false for no; else null."""
    word = F.regexp_extract(F.lower(F.trim(reply)), "^[a-z0-9_]*", 0)
    return F.when(word == "yes", True).when(word == "no", False)


def three_level(reply):
    """A score of 0, 0.5 or 1 from the reply's JSON object; else null."""
    value = F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "$.score").cast("double")
    return F.when(value.isin(0.0, 0.5, 1.0), value)
