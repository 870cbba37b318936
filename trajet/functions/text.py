"""Column expressions over message text."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import functions as F

# The digest budgets in characters and the marker that stands for what is cut.
TRUNCATION_MARKER = "[…truncated…]"
#: Encodings that this worker has loaded.
_encodings: dict = {}
HEAD_CHARS, TAIL_CHARS = 300, 300
PAGE_HEAD, PAGE_TAIL = 800, 400


def char_tokens(text):
    """Four characters to a token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def vocabulary_tokens(text, path: str, pattern: str):
    """Tokens of a tiktoken vocabulary: path names its file of ranks, pattern the split that goes with it. Null has none."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        key = (path, pattern)
        if key not in _encodings:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            _encodings[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _encodings[key].encode_ordinary
        return pd.Series([len(encode(t or "")) for t in texts], dtype="int64")

    return count(text)


def byte_tokens(size):
    return F.ceil(size / 4).cast("long")


def head_tail(text, head: int, tail: int):
    """Text longer than head + tail + marker keeps its two ends around the marker."""
    most = head + tail + len(TRUNCATION_MARKER)
    cut = F.concat(F.left(text, F.lit(head)), F.lit(TRUNCATION_MARKER), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def text_content(text):
    """The JSON of a content list with one text part."""
    return F.to_json(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))))


def content_bytes(text):
    return F.octet_length(text_content(text)).cast("long")


def group_id(use_id, turn):
    return F.substring(F.sha2(F.concat(use_id, F.lit(":"), turn.cast("string")), 256), 1, 16)


def pointer_stub(recall_id, tool, size):
    return F.format_string(
        "[Offloaded #%s tool=%s size=%dB — summary: recall_tool_summary(%s); raw: recall_tool_full(%s)]", recall_id, tool, size, recall_id, recall_id
    )


def rule_digest(serialized):
    return head_tail(serialized, HEAD_CHARS, TAIL_CHARS)


#: How many entries of an array a projection shows, and what stands for the rest.
SHOWN_ENTRIES, REST = 5, "…"


def schema_digest(output, fields: list[str]):
    """The important fields of a JSON object as JSON, in the order of the list; what the object lacks is left out, nulls stay,
    and a longer array keeps its first entries and a mark. An array has no fields; anything else, also text that is no
    JSON, has the rule-based digest. Null stays null. Objects keep the order of their keys."""
    value = F.try_parse_json(output)
    kind = F.schema_of_variant(value)

    def shown(at, raw):
        """A variant as JSON: strings quoted, nulls named, the rest as it stands."""
        text = F.schema_of_variant(at) == "STRING"
        return F.when(F.is_variant_null(at), "null").when(text, F.to_json(at)).otherwise(raw)

    parts = []
    for field in fields:
        path = f"$['{field}']"
        at, raw = F.try_variant_get(value, path, "variant"), F.get_json_object(output, path)
        entries, texts = at.cast("array<variant>"), F.from_json(raw, "array<string>")
        first = F.array(*(shown(F.get(entries, F.lit(i)), F.get(texts, F.lit(i))) for i in range(SHOWN_ENTRIES)))
        cut = F.concat(F.lit("["), F.array_join(first, ","), F.lit(f',"{REST}"]'))
        is_long = F.startswith(F.schema_of_variant(at), F.lit("ARRAY")) & (F.size(texts) > SHOWN_ENTRIES)
        parts.append(F.when(at.isNotNull(), F.concat(F.to_json(F.lit(field).cast("variant")), F.lit(":"), F.when(is_long, cut).otherwise(shown(at, raw)))))
    projected = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return F.when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), projected).otherwise(rule_digest(output))


def page_digest(title, text):
    return F.to_json(F.struct(title.alias("title"), head_tail(text, PAGE_HEAD, PAGE_TAIL).alias("text_excerpt"), F.length(text).alias("full_length_chars")))


def canonical_json(s):
    """Sorted keys, no blanks: a variant prints itself so."""
    return F.parse_json(s).cast("string")


def config_id(s):
    return F.substring(F.sha2(canonical_json(s), 256), 1, 16)


def prefix_bytes(content):
    """Bytes of the canonical form: what a provider's prompt cache sees of a prefix."""
    return F.octet_length(canonical_json(content))


def prompt_date(stamp):
    """A stamp below 1e12 is in seconds, else in milliseconds; four-digit years print as a date, others as the number."""
    seconds = F.when(stamp < 10**12, stamp).otherwise(F.floor(stamp / 1000))
    date = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")
    return F.when((seconds >= 0) & (seconds < 253402300800), date).otherwise(stamp.cast("string"))
