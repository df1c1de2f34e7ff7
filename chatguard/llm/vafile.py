"""Exact top-k inner-product search with a vector-approximation file.

The file is a table of blocks in the shared folder. A block holds, in columns of their own, one byte of cell code
for each dimension of its vectors, the cells' bounds, and the exact vectors. The cells bound every inner product
from both sides. A first pass reads the codes only and finds, for each query, a score that k vectors reach for
certain; a second pass reads exact vectors in the order of their bounds until no unread one can enter the result.

Queries are a stated set against all rows: slices of bounded size travel to the tasks that scan the blocks, and a
task keeps k rows a query, so vectors are shuffled once, when equal ones collapse, and never with the queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatguard.llm.store import keep

_FILE = "dim int, ids array<array<long>>, codes binary, low binary, width binary, exact binary"
_HIT = "query_id long, vec_id long, score long"
_SLICE = 32 << 20  # bytes of query vectors that travel at once
_BATCH = 1024  # queries bounded at once


def scaled(embedding: str, scale: int = 256) -> F.Column:
    """floor(scale * x) of every component as array<long>; null where the vector or a component is unusable."""
    x = F.col(embedding).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when(good, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _blocks(frames: Iterator[pd.DataFrame], block_rows: int, cells: int) -> Iterator[pd.DataFrame]:
    """Rows of the file from (ids, vec): blocks of up to block_rows vectors of one length, as they come."""
    held: dict[int, tuple[list, list]] = {}

    def done(dim: int) -> pd.DataFrame:
        ids, rows = held.pop(dim)
        exact = np.asarray(rows, dtype=np.int64)
        low, high = exact.min(axis=0), exact.max(axis=0)
        width = np.maximum(1, -(-(high - low + 1) // cells))
        codes = ((exact - low) // width).astype(np.uint8)
        return pd.DataFrame([{"dim": dim, "ids": ids, "codes": codes.tobytes(), "low": low.tobytes(), "width": width.tobytes(), "exact": exact.tobytes()}])

    for frame in frames:
        for ids, vec in zip(frame["ids"], frame["vec"], strict=True):
            mine = held.setdefault(len(vec), ([], []))
            mine[0].append(list(ids))
            mine[1].append(vec)
            if len(mine[0]) >= block_rows:
                yield done(len(vec))
    for dim in list(held):
        yield done(dim)


class Cells:
    """The cell codes of one block."""

    def __init__(self, dim: int, codes: bytes, low: bytes, width: bytes):
        self.codes = np.frombuffer(codes, np.uint8).reshape(-1, dim).astype(np.float32)
        self.low, self.width = np.frombuffer(low, np.int64).astype(np.float64), np.frombuffer(width, np.int64).astype(np.float64)
        self.top = self.codes.max(axis=0, initial=0).astype(np.float64)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, under, over): every inner product lies between base + under and base + over.

        base is a product of single-precision numbers; both ends are widened by what its rounding can amount to.
        """
        step = queries * self.width
        reach = self.width - 1
        rounding = (np.abs(step) @ self.top) * (len(self.low) + 2) * 2.0**-23 + np.abs(queries) @ np.abs(self.low) * 2.0**-22 + 1e-6
        base = (step.astype(np.float32) @ self.codes.T).astype(np.float64) + (queries @ self.low)[:, None]
        return base, np.minimum(queries, 0) @ reach - rounding, np.maximum(queries, 0) @ reach + rounding


class Asked:
    """The queries of one slice by vector length, with a score that each is sure to reach."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray]):
        by_dim: dict[int, list[int]] = {}
        for n, v in enumerate(vectors):
            by_dim.setdefault(len(v), []).append(n)
        self.ids = {d: np.array([ids[n] for n in own], dtype=np.int64) for d, own in by_dim.items()}
        self.vectors = {d: np.array([vectors[n] for n in own], dtype=np.int64) for d, own in by_dim.items()}
        self.floor = {d: np.full(len(own), -np.inf) for d, own in by_dim.items()}

    def raise_floors(self, found: pd.DataFrame) -> None:
        known = dict(zip(found["query_id"], found["floor"], strict=True))
        self.floor = {d: np.array([known.get(i, -np.inf) for i in own.tolist()]) for d, own in self.ids.items()}


def _scan_bounds(frames: Iterator[pd.DataFrame], asked: Asked, most: int) -> Iterator[pd.DataFrame]:
    """The `most` largest lower bounds of each query over all blocks of the task."""
    best = {d: np.full((len(ids), most), -np.inf) for d, ids in asked.ids.items()}
    for frame in frames:
        for dim, codes, low, width in zip(frame["dim"], frame["codes"], frame["low"], frame["width"], strict=True):
            if dim not in best:
                continue
            cells, queries = Cells(dim, codes, low, width), asked.vectors[dim]
            for at in range(0, len(queries), _BATCH):
                base, under, _ = cells.bounds(queries[at : at + _BATCH].astype(np.float64))
                both = np.concatenate([best[dim][at : at + _BATCH], base + under[:, None]], axis=1)
                best[dim][at : at + _BATCH] = np.partition(both, both.shape[1] - most, axis=1)[:, -most:]
    for dim, rows in best.items():
        query, bound = np.repeat(asked.ids[dim], most), rows.ravel()
        good = np.isfinite(bound)
        yield pd.DataFrame({"query_id": query[good], "bound": bound[good]})


class Best:
    """The k best (score, id) of some queries; ties go to the smaller id, a query's own id is left out."""

    def __init__(self, own: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.floor, self.k = own, floor.copy(), k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in own]

    def add(self, query: np.ndarray, score: np.ndarray, ids: list[list[int]]) -> None:
        touched = set()
        for q, s, some in zip(query.tolist(), score.tolist(), ids, strict=True):
            self.rows[q] += [(-s, i) for i in some if i != self.own[q]]
            touched.add(q)
        for q in touched:
            self.rows[q] = sorted(self.rows[q])[: self.k]
            if len(self.rows[q]) == self.k:
                self.floor[q] = max(self.floor[q], -self.rows[q][-1][0])


def _scan_exact(frames: Iterator[pd.DataFrame], asked: Asked, k: int, step: int = 4096) -> Iterator[pd.DataFrame]:
    """The k best vectors of each query among the blocks of the task; exact vectors are read in order of their bounds."""
    best = {d: Best(ids, asked.floor[d], k) for d, ids in asked.ids.items()}
    for frame in frames:
        for dim, ids, codes, low, width, exact in zip(frame["dim"], frame["ids"], frame["codes"], frame["low"], frame["width"], frame["exact"], strict=True):
            if dim not in best:
                continue
            cells, queries, mine = Cells(dim, codes, low, width), asked.vectors[dim], best[dim]
            vectors = np.frombuffer(exact, np.int64).reshape(-1, dim)
            for at in range(0, len(queries), _BATCH):
                base, _, over = cells.bounds(queries[at : at + _BATCH].astype(np.float64))
                high = base + over[:, None]
                query, row = np.nonzero(high >= mine.floor[at : at + _BATCH][:, None])
                high = high[query, row]
                order = np.argsort(-high, kind="stable")
                query, row, high = query[order] + at, row[order], high[order]
                while len(query):
                    now, rest = slice(0, step), slice(step, None)
                    score = np.einsum("ij,ij->i", queries[query[now]], vectors[row[now]])
                    mine.add(query[now], score, [ids[r] for r in row[now].tolist()])
                    query, row, high = query[rest], row[rest], high[rest]
                    still = high >= mine.floor[query]
                    query, row, high = query[still], row[still], high[still]
    for dim, mine in best.items():
        out = [(q, i, -s) for q, rows in zip(asked.ids[dim].tolist(), mine.rows, strict=True) for s, i in rows]
        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def build_file(vectors: DataFrame, k: int, block_rows: int = 2048, cells: int = 256) -> DataFrame:
    """The vector-approximation file of (id, vec array<long>), unique ids, written to the shared folder.

    Equal vectors collapse into one with its k + 1 smallest ids: no query can return more of them.
    """
    nth = Window.partitionBy("vec").orderBy("id")
    few = vectors.withColumn("__n", F.row_number().over(nth)).filter(F.col("__n") <= k + 1)
    distinct = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1 ids
    return keep(distinct.select("ids", "vec").mapInPandas(lambda x: _blocks(x, block_rows, cells), _FILE), "va-file")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 2048, cells: int = 256) -> DataFrame:
    """The k rows of `vectors` with the highest inner product for each row of `queries`.

    Both have (vec_id, vec array<long>); vec_id must cast to long; other columns are not read, whatever their names.
    A row is never a partner of the same vec_id. Ties go to the smaller vec_id; with fewer than k partners all are
    returned. Rows with a null id or vector take no part; of rows that repeat an id the one with the smallest vector
    counts. Vectors meet only vectors of equal length. Scores are exact while they fit a long, however wide the
    cells are (256 at most). Empty tables give an empty result.
    Returns query_id long, rank int, vec_id long, score long.
    """
    rows, asked = (d.select(F.col("vec_id").cast("long").alias("id"), "vec").filter("id is not null and vec is not null and size(vec) > 0") for d in (vectors, queries))
    again = rows.groupBy("id").count().filter("count > 1")
    if not again.isEmpty():
        rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    asked = keep(asked.groupBy("id").agg(F.min("vec").alias("vec")), "va-queries")
    file = build_file(rows, k, block_rows, cells)
    size = asked.agg(F.sum(F.size("vec").cast("long") * 8 + 8)).first()[0] or 0
    slices = max(1, math.ceil(size / _SLICE))
    found = [_search(file, asked.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == s) if slices > 1 else asked, k) for s in range(slices)]
    return reduce(DataFrame.unionByName, [keep(x, "va-found") for x in found] if slices > 1 else found)


def _search(file: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The result for one slice of queries, which is held by the driver and every task: about _SLICE bytes."""
    context = file.sparkSession.sparkContext
    own = asked.toPandas()
    some = Asked(own["id"].tolist(), own["vec"].tolist())
    sent = context.broadcast(some)
    codes = file.select("dim", "codes", "low", "width")
    # A query's own vector may be among those bounded, so k + 1 of them make k sure partners.
    low = codes.mapInPandas(lambda x: _scan_bounds(x, sent.value, k + 1), "query_id long, bound double")
    nth = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    floor = low.withColumn("n", F.row_number().over(nth)).filter(F.col("n") == k + 1).select("query_id", F.col("bound").alias("floor"))
    some.raise_floors(floor.toPandas())
    ready = context.broadcast(some)
    hits = file.mapInPandas(lambda x: _scan_exact(x, ready.value, k), _HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
