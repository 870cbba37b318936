"""Observation lines: parsing, and the note that carries them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The format of an observer's lines. A line is "- STAMP (LEVEL) STATEMENT"; the stamp is a date of either
# form or a whole number; details follow on lines of their own, indented by two blanks or more, with a dash.
LEVELS = ("high", "med", "low")
DATE_SHAPES = ("9999-99-99", "9999/99/99")
DETAIL_INDENT = 2


def _stamp(raw):
    """(whether it is a stamp, its epoch second). Whole numbers stay; dates are their midnight in UTC, null if there is no such day."""
    is_date = F.translate(raw, "0123456789", "9999999999").isin(*DATE_SHAPES)
    is_number = (raw != "") & (F.translate(raw, "0123456789", "") == "")
    day = F.unix_date(F.try_to_date(F.translate(raw, "/", "-"), "yyyy-MM-dd")).cast("long") * 86_400
    return is_date | is_number, F.when(is_number, raw.try_cast("long")).when(is_date, day)


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """(session_id, source_turn, text) -> one row per observation, or per line with an unknown confidence (`reason`).

    A line is split at its first three gaps: dash, stamp, level, statement. Details belong to the observation above
    them: the running count of observation lines is their parent.
    """
    lines = df.select("session_id", "source_turn", F.posexplode(F.split(text, "\r?\n")).alias("pos", "line")).filter(F.trim("line") != "")
    words = F.split("line", r"\s+", 4)
    lines = lines.withColumns({"dash": F.get(words, F.lit(0)), "stamp": F.get(words, F.lit(1)), "level": F.get(words, F.lit(2)), "statement": F.get(words, F.lit(3))})
    stamped, at = _stamp(F.coalesce("stamp", F.lit("")))
    headed = (F.col("dash") == "-") & stamped
    known = F.col("level").isin(*(f"({x})" for x in LEVELS)) & (F.coalesce("statement", F.lit("")) != "")
    lines = lines.withColumns(
        {
            "is_obs": F.coalesce(headed & known, F.lit(False)),
            "at": at,
            # some other word or words in brackets where the level belongs
            "odd": F.coalesce(headed & F.startswith("level", F.lit("(")) & (F.instr(F.concat_ws(" ", "level", "statement"), ")") > 2), F.lit(False)),
        }
    )
    inner = F.ltrim(F.translate("line", "\t", " "))
    detail = (F.length("line") - F.length(inner) >= DETAIL_INDENT) & F.startswith(inner, F.lit("- ")) & (F.length(F.trim(inner)) > 1)
    order = Window.partitionBy("session_id", "source_turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("parent", F.sum(F.when(F.col("is_obs"), 1).otherwise(0)).over(order))
    bad = marked.filter("odd and not is_obs").select(
        "session_id", "source_turn", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("timestamp"), F.lit(None).cast("string").alias("confidence"),
        F.col("line").alias("statement"), F.lit(0).cast("long").alias("n_details"), F.lit("unknown confidence").alias("reason"),
    )
    own = lambda c: F.max(F.when(F.col("is_obs"), c))
    good = (
        marked.filter("parent > 0")
        .groupBy("session_id", "source_turn", F.col("parent").cast("long").alias("seq"))
        .agg(
            own(F.col("at")).alias("timestamp"),
            own(F.translate("level", "()", "")).alias("confidence"),
            own(F.col("statement")).alias("statement"),
            F.count_if(detail).cast("long").alias("n_details"),
        )
        .withColumn("reason", F.lit(None).cast("string"))
    )
    return good.unionByName(bad)


def note(observations: DataFrame) -> DataFrame:
    """One note per session: observations numbered by time, ties in their order."""
    order = Window.partitionBy("session_id").orderBy("timestamp", "source_turn", "seq")
    numbered = observations.filter("reason is null").withColumn("i", F.row_number().over(order))
    line = F.format_string("- obs#%d ts=%d (%s) %s", "i", "timestamp", "confidence", "statement")
    grouped = numbered.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("l"))
    return grouped.select("session_id", F.concat(F.lit("## Observations from prior turns\n"), F.array_join(F.col("l")["line"], "\n")).alias("note"))
