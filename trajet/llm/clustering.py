"""Exact k-means over quantised vectors, with centroids filtered by N-simplex projection.

A few well-spread start centroids are pivots. A vector's distances to them, computed once and kept, fix the apex of a
simplex over the pivots: coordinates in the pivots' span and an altitude above it. Two apexes give bounds of the distance
of their vectors, the lower one with both altitudes on the same side, the upper one with them on opposite sides. A round
projects the centroids alike, drops every centroid whose lower bound lies above the least upper bound, and compares the
others in whole numbers, so results are exact whatever the bounds leave.

Vectors stay where they are: they are written once with their apexes, a round reads them, and a task returns one sum for
each centroid and component. Centroids are few and live on the driver.

Defined cases: vectors of another size, or with null, NaN or infinite components, are left out, null vectors too; a
component of over 2**18 in size counts as that (squares stay whole in a long); repeated ids are vectors of their own, and
where their hashes are equal the smaller vector starts first; null ids are kept and start last; with fewer vectors than
centroids there is one centroid each; equal distances go to the smaller number; inertia beyond a long is the largest
long; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stored

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1"
PIVOTS = 8
#: Largest whole component; a squared distance of SIZE of them stays far below 2**63.
MOST = 2**24
#: A pivot must stand this share of its squared distance above the span of those before it, so that apexes are
#: well conditioned; bounds are then right within SLACK of the squared distances they are made of.
SPREAD, SLACK = 1e-2, 1e-5
_LONG = 2**63 - 1

_KEPT = "vec_id long, whole binary, apex binary"
_ASSIGNED = "vec_id long, cluster int, distance long"


class Simplex:
    """Pivots and their simplex: apexes of vectors over it."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS):
        """candidates: whole vectors, of which the first is the origin and then the farthest from the span are taken."""
        rest = (candidates - candidates[0]).astype(float) if len(candidates) else np.zeros((0, 0))
        squares = (rest**2).sum(1)
        taken, left, rows = [0], squares.copy(), []
        while len(taken) < min(most, len(candidates)):
            far = int(np.argmax(left))
            if left[far] <= 0 or left[far] < SPREAD * squares.max():
                break
            taken.append(far)
            # the part of each candidate along the new direction
            part = rest[far] - sum((r @ rest[far]) * r for r in rows) if rows else rest[far]
            rows.append(part / np.sqrt(part @ part))
            left = np.maximum(0, squares - sum((rest @ r) ** 2 for r in rows))
            left[taken] = 0
        self.pivots = candidates[taken] if len(candidates) else candidates
        sides = (self.pivots[1:] - self.pivots[:1]).astype(float) if len(candidates) else np.zeros((0, 0))
        self.side_squares = (sides**2).sum(1)
        # the pivots' own coordinates, lower triangular
        self.corner = np.linalg.cholesky(sides @ sides.T) if len(sides) else np.zeros((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots, exact."""
        return np.stack([((x - p) ** 2).sum(1) for p in self.pivots], 1)

    def apexes(self, squares: np.ndarray) -> np.ndarray:
        """From squared distances to the pivots: the coordinates in their span, the altitude, and the scale of errors."""
        squares = squares.astype(float)
        along = (squares[:, :1] + self.side_squares - squares[:, 1:]) / 2
        base = np.linalg.solve(self.corner, along.T).T if len(self.corner) else along
        altitude = np.sqrt(np.maximum(0, squares[:, 0] - (base**2).sum(1)))
        return np.column_stack((base, altitude, squares[:, 0] + self.side_squares.max(initial=0)))


def bounds(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, rows by centres, widened by what rounding may take."""
    base = ((apexes[:, None, :-2] - centres[None, :, :-2]) ** 2).sum(2)
    up, up_c = apexes[:, -2][:, None], centres[:, -2][None, :]
    slack = SLACK * (apexes[:, -1][:, None] + centres[:, -1][None, :])
    return base + (up - up_c) ** 2 - slack, base + (up + up_c) ** 2 + slack


def nearest(whole: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, comparisons made) of whole vectors."""
    lower, upper = bounds(apexes, centres)
    open_ = lower <= upper.min(1)[:, None]
    best = np.full(len(whole), _LONG)
    cluster = np.zeros(len(whole), np.int32)
    for c, centroid in enumerate(centroids):
        rows = np.flatnonzero(open_[:, c])
        d = ((whole[rows] - centroid) ** 2).sum(1)
        nearer = d < best[rows]  # a tie stays with the smaller number
        best[rows[nearer]], cluster[rows[nearer]] = d[nearer], c
    return cluster, best, int(open_.sum())


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """The vectors that count, as whole numbers: vec_id, whole."""
    x = F.col(vector_col).cast("array<double>")
    fine = (F.size(x) == size) & F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))  # NaN is above all
    floor = lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int")
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, floor).alias("whole"))


def _matrix(column: pa.Array, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _project(simplex: Simplex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = batch.column("whole").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                apexes = simplex.apexes(simplex.distances(whole))
                rows = [(x.tobytes(), a.tobytes()) for x, a in zip(whole.astype("<i4"), apexes.astype("<f8"))]
                yield arrow_rows(rows, _KEPT, vec_id=batch.column("vec_id"))

    return run


def _assign(centroids: np.ndarray, centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = _matrix(batch.column("whole"), "<i4", batch.num_rows).astype(np.int64)
                cluster, distance, _ = nearest(whole, _matrix(batch.column("apex"), "<f8", batch.num_rows), centroids, centres)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _sums(centroids: np.ndarray, centres: np.ndarray):
    """One row a centroid and component; component -1 counts rows, -2 exact comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        compared = 0
        for batch in batches:
            if batch.num_rows:
                whole = _matrix(batch.column("whole"), "<i4", batch.num_rows).astype(np.int64)
                cluster, _, n = nearest(whole, _matrix(batch.column("apex"), "<f8", batch.num_rows), centroids, centres)
                total[:, -1] += np.bincount(cluster, minlength=len(centroids))
                for c in range(len(centroids)):
                    total[c, :-1] += whole[cluster == c].sum(0)
                compared += n
        rows = [(c, i if i < centroids.shape[1] else -1, v) for c, row in enumerate(total.tolist()) for i, v in enumerate(row)]
        yield arrow_rows([*rows, (0, -2, compared)], "cluster int, place int, total long")

    return run


def _first(source: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors of least digests. Only digests below a bound, about four times k, leave their tasks, once each; the
    bound widens if too few lie below."""
    digest = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.lit("none"))  # behind all hexadecimal digits
    named = source.select(digest.alias("digest"), "whole")
    n = source.count()
    share = 4 * k / max(1, n)
    while True:
        below = named.filter(F.col("digest") < f"{int(2**52 * share):013x}") if share < 1 else named
        found = below.groupBy("digest", "whole").count().orderBy("digest", "whole").limit(k).collect()
        vectors = [r["whole"] for r in found for _ in range(min(k, r["count"]))]
        if share >= 1 or len(vectors) >= k:
            return vectors[:k]
        share *= 16


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED, pivots: int = PIVOTS
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    source = quantised(vectors, id_col, vector_col, size, scale)
    centroids = np.array(_first(source, k, seed), np.int64).reshape(-1, size)
    simplex = Simplex(centroids, pivots)
    kept = stored(source.mapInArrow(_project(simplex), _KEPT), "clustering-vectors")
    centres_of = lambda c: simplex.apexes(simplex.distances(c))
    for _ in range(rounds if len(centroids) else 0):
        # k * (size + 1) rows
        found = kept.select("whole", "apex", "vec_id").mapInArrow(_sums(centroids, centres_of(centroids)), "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
        totals = {(r["cluster"], r["place"]): r["total"] for r in found}
        centroids = np.array([[totals[c, i] // totals[c, -1] if totals.get((c, -1)) else int(old[i]) for i in range(size)] for c, old in enumerate(centroids)], np.int64)
    assigned = stored(kept.mapInArrow(_assign(centroids, centres_of(centroids)) if len(centroids) else lambda batches: iter(()), _ASSIGNED), "clustering-assigned")
    # k rows
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, min(v, _LONG), min(whole, _LONG), digest[c]) for c, v in inertia.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
