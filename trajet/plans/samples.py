"""Samples that a seeded generator draws row by row, found without going through the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.generators import draw32, draws_sql
from ..operators import shuffles
from ..sources.derive import table
from .registry import query

SEED, TAKEN = 42, 100


def _swaps_sql(name: str, start: str, draws: str) -> str:
    """Recursive CTE: the pools' arrays, swapped step by step. start: (pool, base, arr)."""
    return f"""{name} AS (
        SELECT pool, base, arr, len(arr)::BIGINT AS i FROM ({start})
        UNION ALL
        SELECT pool, base, CASE WHEN j = i - 1 THEN arr ELSE list_transform(arr, lambda x, k: CASE k WHEN i THEN arr[j + 1] WHEN j + 1 THEN arr[i] ELSE x END) END, i - 1
        FROM (SELECT s.*, floor(d.u * s.i)::BIGINT AS j FROM {name} s JOIN {draws} d ON d.n = s.base + len(s.arr) - s.i WHERE s.i > 1))"""


@query(f"WITH {draws_sql('SELECT doc_id AS n FROM documents WHERE doc_id >= 0', SEED)} SELECT n AS doc_id, (u * 4294967296)::BIGINT AS drawn FROM dr")
def q_generator_draws(spark, d):
    return table(spark, d, "documents").filter("doc_id >= 0").select("doc_id", draw32(SEED, F.col("doc_id")).alias("drawn"))


@query(f"""WITH RECURSIVE {draws_sql('SELECT unnest(generate_series(0, (SELECT count(*) FROM documents))) AS n', SEED)},
    {_swaps_sql('sw', 'SELECT 0 AS pool, 0 AS base, list(doc_id ORDER BY doc_id) AS arr FROM documents', 'dr')}
    SELECT unnest(arr) AS doc_id, (generate_subscripts(arr, 1) - 1)::BIGINT AS place FROM sw WHERE i = 1""")
def q_swap_shuffle(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    rows = shuffles.numbered(docs, "doc_id").withColumns({"pool": F.lit(0), "size": F.lit(docs.count()), "base": F.lit(0)})
    return shuffles.shuffled(rows, SEED).select("doc_id", F.col("shuffled").alias("place"))


@query(f"""WITH RECURSIVE {draws_sql(f'SELECT unnest(generate_series(0, (SELECT count(*) FROM documents) + {TAKEN})) AS n', SEED)},
    st AS (SELECT lang, count(*) AS size, min(doc_id) AS first, list(doc_id ORDER BY doc_id) AS arr FROM documents GROUP BY 1),
    qt AS (SELECT *, coalesce(sum(size - 1) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, floor(size * {TAKEN} / sum(size) OVER ()::DOUBLE)::BIGINT AS whole, size * {TAKEN} / sum(size) OVER ()::DOUBLE - floor(size * {TAKEN} / sum(size) OVER ()::DOUBLE) AS rest, sum(size - 1) OVER () AS drawn FROM st),
    qu AS (SELECT *, whole + (row_number() OVER (ORDER BY rest DESC, first) <= {TAKEN} - sum(whole) OVER ())::INT AS quota FROM qt),
    {_swaps_sql('sw', 'SELECT first AS pool, base, arr FROM qu', 'dr')},
    tk AS (SELECT list(id ORDER BY first, nth) AS arr, any_value(drawn) AS drawn FROM (SELECT first, drawn, quota, unnest(sw.arr) AS id, generate_subscripts(sw.arr, 1) AS nth FROM sw JOIN qu ON qu.first = sw.pool WHERE sw.i = 1) WHERE nth <= quota),
    {_swaps_sql('fin', 'SELECT 0 AS pool, drawn AS base, arr FROM tk', 'dr')}
    SELECT lang, doc_id, place FROM (SELECT unnest(arr) AS doc_id, (generate_subscripts(arr, 1) - 1)::BIGINT AS place FROM fin WHERE i = 1) JOIN documents USING (doc_id)""")
def q_stratified_shuffle(spark, d):
    return shuffles.stratified_shuffle(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", TAKEN, SEED)
