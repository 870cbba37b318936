"""Exact nearest neighbours: blocks of queries meet blocks of vectors in the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shuffles import _kept

#: Rows of a block at most, of queries and of vectors.
QUERY_BLOCK, VECTOR_BLOCK = 1_000, 10_000
#: Likenesses that a task holds at once, whatever the blocks: 8 MB, and as much again for each step on them.
TILE = 1_000_000
_PACKED = "ids binary, units binary"
_OUT = "query_id long, vec_id long, near double"


def _packed(block: int):
    """Vectors of length one, so many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
                matrix = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1)
                norm = np.linalg.norm(matrix, axis=1, keepdims=True)
                unit = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary())], ["ids", "units"])

    return run


def _best_of(k: int, digits: int):
    """For each pair of blocks the k best vectors of every query, ties by id."""

    def best_of(ids: np.ndarray, a: np.ndarray, vec: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        near = a @ b.T
        np.round(near, digits, out=near)
        near[ids[:, None] == vec[None, :]] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(ids), -2.0)
        q, v = np.nonzero(near >= np.maximum(least, -2.0)[:, None])
        near = near[q, v]
        order = np.lexsort((vec[v], -near, q))
        q, v, near = q[order], v[order], near[order]
        best = np.arange(len(q)) - np.searchsorted(q, np.arange(len(ids)))[q] < k
        return pa.RecordBatch.from_arrays([pa.array(ids[q[best]]), pa.array(vec[v[best]]), pa.array(near[best])], ["query_id", "vec_id", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, asked_units, known, known_units in zip(*(batch.column(c) for c in ("asked", "asked_units", "ids", "units"))):
                ids, vec = (np.frombuffer(x.as_buffer(), "<i8") for x in (asked, known))
                a, b = (np.frombuffer(u.as_buffer(), "<f8").reshape(len(i), -1) for u, i in ((asked_units, ids), (known_units, vec)))
                step = max(1, TILE // len(vec))
                for at in range(0, len(ids), step):
                    yield best_of(ids[at : at + step], a[at : at + step], vec, b)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """(vec_id, embedding) of both -> query_id, vec_id, rank: the k vectors of largest cosine, rounded, ties by id; a
    query is no neighbour of itself. Vectors without an id or an embedding are left out.

    Both sides are rows of whole blocks, and every block of queries meets every block of vectors in some task: Spark sends
    the query blocks along where they are below its broadcast limit, and pairs partitions beyond it. Nothing passes the
    driver; a pair of blocks leaves k rows a query.
    """
    known = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").dropna()
    # read again for every partition of vectors
    asked = _kept(known(queries).mapInArrow(_packed(block), _PACKED)).select(F.col("ids").alias("asked"), F.col("units").alias("asked_units"))
    pairs = known(vectors).mapInArrow(_packed(VECTOR_BLOCK), _PACKED).crossJoin(asked)
    found = pairs.mapInArrow(_best_of(k, digits), _OUT)
    order = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order).cast("long"))
    return best.filter(F.col("rank") <= k).select("query_id", "vec_id", "rank")
