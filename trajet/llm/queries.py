"""The queries of this subpackage: (spark, sf_dir) -> DataFrame over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from . import alignment, clustering, exact_dedup, fingerprints, html_extraction, mixing, packing, secret_scan, sharding, simhash, token_counts, toxicity, url_filter
from .common import table


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark, sf_dir):
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op13_clustering(spark, sf_dir):
    return clustering.centroid_clusters(table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_url_filter, op3_secret_scan, op4_sharding, op5_token_counts, op6_exact_dedup,
    op7_toxicity, op8_fingerprints, op9_mixing, op10_simhash, op11_alignment, op12_html_extraction, op13_clustering, pipeline,
)}

def _clustering_sql(k: int = clustering.CENTROIDS, rounds: int = clustering.ROUNDS, size: int = clustering.SIZE) -> str:
    """Each round as three steps: distances of all vectors to all centroids, the least one, floored means."""
    near = """n{r} AS MATERIALIZED (
        SELECT v.row, min({{'d': CAST(list_sum(list_transform(range(1, {size1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS BIGINT), 'c': c.c}}) AS best
        FROM v, c{r} c GROUP BY v.row)"""
    mean = """s{r} AS (
        SELECT c, i, sum(x) AS s, count(*) AS n FROM (
            SELECT n.best.c AS c, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM v JOIN n{r} n USING (row)) GROUP BY c, i),
    c{next} AS MATERIALIZED (
        SELECT o.c, coalesce(m.q, o.q) AS q FROM c{r} o LEFT JOIN (
            SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{r} GROUP BY c) m ON o.c = m.c)"""
    steps = [near.format(r=0, size1=size + 1)]
    for r in range(rounds):
        steps += [mean.format(r=r, next=r + 1), near.format(r=r + 1, size1=size + 1)]
    return f"""WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings
        WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
    c0 AS MATERIALIZED (
        SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS INTEGER) AS c, q FROM (
            SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k})),
    {", ".join(steps)}
    SELECT v.vec_id, n.best.c AS cluster, n.best.d AS distance,
           CAST(sum(n.best.d) OVER (PARTITION BY n.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.best.d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM v JOIN n{rounds} n USING (row) JOIN c{rounds} c ON c.c = n.best.c"""


ORACLES = {
    "op13_clustering": _clustering_sql(),
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY bare) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g""",
}
