"""A training-data pipeline of the operators in trajet.llm: each stage's output is written and read as the next one's input.

Defined cases: null and empty texts are one text, of which a row stays until mixing, where it takes nothing and goes; null ids
are an id of their own, and rows that share an id stay apart where their texts differ; equal texts leave the row with the most
code points, then the least id; very long texts are judged and packed whole; without toxic labels every document is clean;
other columns pass through to packing, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from trajet.llm import common, exact_dedup, mixing, packing, simhash, toxicity


def clean(spark, docs, sf_dir):
    """Operator 7: documents that score as toxic go."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def distinct(spark, docs, sf_dir):
    """Operator 6: of equal texts one document stays."""
    return exact_dedup.keep_distinct(docs)


def near_distinct(spark, docs, sf_dir):
    """Operator 10: of each group of near-duplicates one document stays."""
    return simhash.keep_one(docs)


def mixed(spark, docs, sf_dir):
    """Operator 9: sources in their target shares, documents repeated for whole epochs."""
    return mixing.apply_mix(docs)


def packed(spark, docs, sf_dir):
    """Operator 1: the pieces that fill the training sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("simhash", near_distinct), ("mixing", mixed), ("packing", packed)]

#: Packing and the fitted classifier are beyond SQL; tests hold the run against plain-Python
#: deduplications and the invariants of packing; mixing has a brute-force test of its own.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
