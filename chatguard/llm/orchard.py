"""Centroid clustering of integer vectors with Orchard's nearest-centroid search.

Every centroid holds the other centroids in order of their distance from it. The search for a vector starts at one
centroid and walks its list; a closer centroid takes over with its own list, centroids looked at are marked, and the
walk ends at the first entry strictly beyond twice the current distance: by the triangle inequality no centroid
from there on is as near, so ties are still seen.

Only the centroids travel (k x dim numbers). A task keeps one sum a cluster, so a round shuffles k rows a task,
whatever vectors repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatguard.llm.store import keep
from chatguard.llm.vafile import scaled

_SUMS = "cluster int, place int, n long, total long"
_PLACED = "vec_id long, cluster int, distance long"
_BATCH = 8192


class Orchard:
    """k centroids with their sorted neighbour lists."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, dtype=np.int64)
        apart = self.centroids[:, None, :] - self.centroids[None, :, :]
        gap = np.einsum("ijk,ijk->ij", apart, apart)
        # Equal distances go by number; the first entry, the centroid itself, is left out.
        order = np.array([np.lexsort((np.arange(len(row)), row, np.arange(len(row)) != i)) for i, row in enumerate(gap)]).reshape(len(gap), -1)
        self.lists = order[:, 1:]
        self.gaps = np.take_along_axis(gap, self.lists, axis=1)

    def distance(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[which]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid, ties to the smaller number; how many distances it took."""
        n, k = len(vectors), len(self.centroids)
        at, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        best, taken = self.distance(vectors, at), n
        live = np.arange(n) if k > 1 else np.zeros(0, dtype=np.int64)
        while len(live):
            # A list ends at its last entry or strictly beyond twice the distance (squared: four times).
            live = live[place[live] < k - 1]
            live = live[self.gaps[at[live], place[live]] <= 4 * best[live]]
            other = self.lists[at[live], place[live]]
            place[live] += 1
            new = ~seen[live, other]
            rows, other = live[new], other[new]
            seen[rows, other] = True
            far = self.distance(vectors[rows], other)
            taken += len(rows)
            closer = (far < best[rows]) | ((far == best[rows]) & (other < at[rows]))
            rows = rows[closer]
            at[rows], best[rows], place[rows] = other[closer], far[closer], 0
        return at, best, taken


def _arrays(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _BATCH):
            part = batch.slice(start, _BATCH)
            yield part.column("vec_id"), part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch], orchard: Orchard) -> Iterator[pa.RecordBatch]:
    """Count and componentwise sum of each cluster over the rows of the task."""
    k, dim = orchard.centroids.shape
    count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
    for _, vectors in _arrays(batches, dim):
        at = orchard.nearest(vectors)[0]
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        total[own] += np.add.reduceat(vectors[order], first, axis=0)
        count += np.bincount(at, minlength=k)
    used = np.flatnonzero(count)
    columns = [np.repeat(used, dim).astype(np.int32), np.tile(np.arange(dim, dtype=np.int32), len(used)), np.repeat(count[used], dim), total[used].ravel()]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "place", "n", "total"])


def _placed(batches: Iterator[pa.RecordBatch], orchard: Orchard) -> Iterator[pa.RecordBatch]:
    for ids, vectors in _arrays(batches, orchard.centroids.shape[1]):
        at, far, _ = orchard.nearest(vectors)
        yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])


def starting_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose '<seed>:<vec_id>' has the smallest SHA-256, in that order; equal ids by their vectors."""
    hashed = vectors.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "vec")
    return [list(r["vec"]) for r in hashed.orderBy("h", "vec").limit(k).collect()]


def cluster_vectors(embeddings: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """Lloyd rounds over floor(scale * x) of every component, then one more assignment.

    embeddings: vec_id, embedding; other columns are not read, whatever their names. Vectors that are null, not of
    `dim` components, or hold a null or non-finite component take no part. Rows with a null id are clustered but are
    never a starting centroid; rows that repeat an id each count. Fewer than k vectors give fewer centroids, and an
    empty table an empty result. Every round replaces a centroid by floor(sum / count) of its vectors, exactly; one
    without vectors stays. Components must keep within 2^27 once scaled, so that squares fit a long.
    Returns vec_id long, cluster int, distance long (squared), cluster_inertia and inertia long, centroid array<long>.
    """
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.size("embedding") == dim, scaled("embedding", scale)).alias("vec")).filter("vec is not null")
    vectors = keep(good, "orchard-vectors")
    centroids = starting_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.col("vec").alias("centroid")).filter("1 = 0")

    for _ in range(rounds):
        orchard = Orchard(centroids)
        parts = vectors.mapInArrow(lambda x, o=orchard: _sums(x, o), _SUMS)
        for row in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k x dim rows at most
            centroids[row["cluster"]][row["place"]] = row["total"] // row["n"]
    last = Orchard(centroids)
    placed = keep(vectors.mapInArrow(lambda x: _placed(x, last), _PLACED), "orchard-placed")
    spread = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, spread[c], sum(spread.values()), [int(x) for x in centroids[c]]) for c in sorted(spread)]
    per_cluster = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows

