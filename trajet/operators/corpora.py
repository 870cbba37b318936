"""Task corpora: flattening, placeholders, importers, validation, fixture baking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Extension to MIME type, and image links in a user's text.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}
IMAGE_LINK = r"(?i)(https?://\S+?\.(?:svg|png|jpe?g|gif|webp)(?:\?\S*)?)(?=\s|$)"
TEXT_CAP = 8_000


def sessions_of(tasks: DataFrame, id_col: str = "sample_id", column: str = "conversation") -> DataFrame:
    """A conversation whose sessions are keys session_<N> -> (id, n, date, turns), by number and not by name."""
    entry = F.explode(F.col(column).cast("map<string,variant>")).alias("key", "value")
    rows = tasks.select(id_col, F.col(column).cast("map<string,variant>").alias("all"), entry)
    n = F.regexp_extract("key", r"^session_(\d+)$", 1)
    found = rows.filter(n != "").withColumn("n", n.cast("int")).filter("n > 0")
    turns = F.try_variant_get("value", "$", "array<struct<speaker:string,text:string>>")
    date = F.try_variant_get(F.try_element_at("all", F.concat("key", F.lit("_date_time"))), "$", "string")
    return found.select(id_col, "n", F.coalesce(date, F.lit("")).alias("date"), turns.alias("turns")).filter("turns is not null")


def sessions_text(sessions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One text per task: a header and a line per turn, sessions in order, a blank line after each."""
    dated = F.col("date") != ""
    head = F.when(dated, F.format_string("[session_%d | %s]", "n", "date")).otherwise(F.format_string("[session_%d]", "n"))
    stamp = F.when(dated, F.concat(F.lit("["), "date", F.lit("] "))).otherwise("")
    lines = F.transform("turns", lambda t: F.concat(stamp, t["speaker"], F.lit(": "), t["text"]))
    block = F.array_join(F.concat(F.array(head), lines, F.array(F.lit(""))), "\n")
    ordered = F.array_sort(F.collect_list(F.struct("n", block.alias("block"))))
    return sessions.groupBy(id_col).agg(ordered.alias("b")).select(id_col, F.array_join(F.col("b")["block"], "\n").alias("text"))


def text_only(content):
    """Images and files become placeholders, tool parts go, nothing left is one empty text. content: array<struct<type, text, path, alt>>"""

    def one(p):
        alt = F.when(F.coalesce(p["alt"], F.lit("")) != "", F.concat(F.lit("; alt="), p["alt"])).otherwise("")
        return (
            F.when(p["type"] == "text", p["text"])
            .when(p["type"] == "image", F.concat(F.lit("[Image attachment: "), p["path"], alt, F.lit("]")))
            .when(p["type"] == "file", F.concat(F.lit("[File attachment: "), p["path"], F.lit("]")))
        )

    kept = F.filter(F.transform(content, one), lambda t: t.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))


def image_links(text):
    """(links in order, the text without them)"""
    return F.regexp_extract_all(text, F.lit(IMAGE_LINK), 1), F.trim(F.regexp_replace(F.regexp_replace(text, IMAGE_LINK, ""), r"[ \t]{2,}", " "))


def allocate_ids(tasks: DataFrame, used: DataFrame, most: int, category: str = "category", order: str = "source_id") -> DataFrame:
    """New ids at_<category>_<NNN> after those in use, at most `most` a category, first seen first; repeats of a source go."""
    top = used.groupBy(category).agg(F.max("number").alias("_top"), F.count(F.lit(1)).alias("_have"))
    once = tasks.dropDuplicates([category, order])
    rank = F.row_number().over(Window.partitionBy(category).orderBy(order))
    numbered = once.join(top, category, "left").withColumn("_rn", rank).filter(F.col("_rn") + F.coalesce("_have", F.lit(0)) <= most)
    number = F.lpad((F.col("_rn") + F.coalesce("_top", F.lit(0))).cast("string"), 3, "0")
    return numbered.withColumn("task_id", F.concat(F.lit("at_"), category, F.lit("_"), number)).drop("_rn", "_top", "_have")


def top_up(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(category, target) less what exists -> one row (category, k) for each task still to be made."""
    have = existing.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    gap = wanted.join(have, "category", "left").withColumn("gap", F.col("target") - F.coalesce("n", F.lit(0))).filter("gap > 0")
    return gap.select("category", F.explode(F.sequence(F.lit(1), F.col("gap").cast("int"))).alias("k"))


def palette_violations(required: DataFrame, available: DataFrame) -> DataFrame:
    """(task_id, tool_name) required calls whose tool the task does not offer, with the reason."""
    offers = available.select("task_id").distinct().withColumn("_any", F.lit(True))
    missing = required.join(available, ["task_id", "tool_name"], "left_anti").join(offers, "task_id", "left")
    reason = F.when(F.col("_any").isNull(), "tools_available is empty").otherwise(F.concat(F.lit("required tool not offered: "), "tool_name"))
    return missing.select("task_id", "tool_name", reason.alias("reason"))


def composite_violations(nodes: DataFrame) -> DataFrame:
    """(task_id, node_id, parent_id, strategy): composite nodes without a child."""
    children = nodes.filter("parent_id is not null").select("task_id", F.col("parent_id").alias("node_id"))
    return nodes.filter("strategy = 'composite'").join(children, ["task_id", "node_id"], "left_anti").select("task_id", "node_id", F.lit("composite without rules").alias("reason"))


def composite_scores(nodes: DataFrame, depth: int) -> DataFrame:
    """(task_id, node_id, parent_id, level, rule, score) trees, level 0 at the root -> the root's score, bottom up.

    Leaves carry scores; a node takes all, any or the mean of its children.
    """
    done = nodes.filter("rule is null").select("task_id", "node_id", "parent_id", "level", "score")
    for level in range(depth - 1, -1, -1):
        at = done.filter(F.col("level") == level + 1).groupBy("task_id", F.col("parent_id").alias("node_id")).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"))
        score = F.when(F.col("rule") == "all", F.when(F.col("lo") >= 1, 1.0).otherwise(0.0)).when(F.col("rule") == "any", F.when(F.col("hi") >= 1, 1.0).otherwise(0.0)).otherwise(F.col("mean"))
        inner = nodes.filter((F.col("level") == level) & F.col("rule").isNotNull()).drop("score").join(at, ["task_id", "node_id"])
        done = done.unionByName(inner.select("task_id", "node_id", "parent_id", "level", score.alias("score")))
    return done.filter("level = 0").select("task_id", "score")


def bake(fixtures: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries that need baking take a fresh output where there is one; order stays. + baked"""
    joined = fixtures.join(fresh.select("task_id", "position", F.col("output").alias("_new")), ["task_id", "position"], "left")
    baked = F.col("needs_bake") & F.col("_new").isNotNull()
    return joined.select("task_id", "position", F.when(baked, F.col("_new")).otherwise(F.col("output")).alias("output"), (F.col("needs_bake") & ~baked).alias("needs_bake"), baked.alias("baked"))


def inject_recall(tools: DataFrame, held: DataFrame, enabled: bool) -> DataFrame:
    """Both recall tools for sessions that hold something, unless the session already has a tool of that name."""
    if not enabled:
        return tools
    both = held.filter("entries > 0").select("session_id", F.explode(F.array(F.lit("recall_tool_summary"), F.lit("recall_tool_full"))).alias("name"))
    return tools.unionByName(both.join(tools, ["session_id", "name"], "left_anti"))


def recall_note(messages: DataFrame, note: str) -> DataFrame:
    """A system note right after each session's first system message: + position; sessions without one stay as they are."""
    first = messages.filter("role = 'system'").groupBy("session_id").agg(F.min("msg_idx").alias("msg_idx"))
    added = first.select("session_id", (F.col("msg_idx") + 0.5).alias("at"), F.lit("system").alias("role"), F.lit(note).alias("text"))
    every = messages.select("session_id", F.col("msg_idx").cast("double").alias("at"), "role", "text").unionByName(added)
    return every.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("at")) - 1).drop("at")


def cache_marks(parts: DataFrame) -> DataFrame:
    """+ cache_mark on the last part of each session's first user message."""
    users = Window.partitionBy("session_id")
    first_user = F.min(F.when(F.col("role") == "user", F.col("msg_idx"))).over(users)
    marked = parts.withColumn("_first", first_user)
    last = F.max("part_idx").over(Window.partitionBy("session_id", "msg_idx"))
    return marked.withColumn("cache_mark", F.coalesce((F.col("msg_idx") == F.col("_first")) & (F.col("part_idx") == last), F.lit(False))).drop("_first")


def system_prompt(header: str, style: str, policy: str, context, tools):
    """Sections joined by blank lines; the context and the tool list only where there is something to say."""
    n = F.size(tools)
    listed = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("- **"), t["name"], F.lit("** — "), t["line"])), "\n")
    block = F.when(n > 0, F.concat(F.format_string("# Available tools\n\nYou have %d tool%s.\n\n", n, F.when(n == 1, "").otherwise("s")), listed, F.lit("\n\n" + policy)))
    return F.concat_ws("\n\n", F.lit(header), F.nullif(F.trim(context), F.lit("")), block, F.lit(style))


def result_list(results):
    """Numbered search results as one text, capped. results: array<struct<title, url, snippet>>"""
    line = F.transform(results, lambda r, i: F.format_string("%d. %s\n   %s\n   %s", i + 1, r["title"], r["url"], r["snippet"]))
    return F.left(F.concat(F.format_string("Top %d results:\n", F.size(results)), F.array_join(line, "\n")), F.lit(TEXT_CAP))


def mock_search(query, n: int = 3):
    """Deterministic results for tests and offline runs."""
    one = lambda i: F.struct(F.format_string("Result %d for %s", i, query).alias("title"), F.format_string("https://example.com/%d", i).alias("url"), F.format_string("About %s", query).alias("snippet"))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), one)


def data_url(path, content):
    """Bytes as a data URL, the MIME type by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))])
    return F.concat(F.lit("data:"), F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream")), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def pick_by_index(wanted: DataFrame, listed, name: str = "task") -> DataFrame:
    """(task_idx) against a list column of one row: positions out of range are no rows."""
    items = listed.select(F.posexplode("items").alias("task_idx", name))
    return wanted.join(items, "task_idx")
