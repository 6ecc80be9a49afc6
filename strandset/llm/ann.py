"""Nearest neighbours by low-dimensional Gaussian (2-stable) projections, a kd-tree over them, and a chi-square test.

Vectors are projected to DIMENSIONS coordinates. For a pair at distance d the squared projected distance over d^2 is
chi-square distributed, so once every point whose projected distance is below rho is verified, and d_k is the k-th
best distance so far, a nearer point is left with a chance below 1 - CONFIDENCE if rho^2 >= d_k^2 * quantile.

The kd-tree's upper levels are fitted on a bounded sample and route every vector to a cell. A query searches its own
cell; the k-th distance found there bounds which other cells can matter; in each, candidates are verified in order of
projected distance until the test holds. A cell with many rows (copies of one vector) is cut by a hash of the id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, table
from .vectors import matrix, sample_matrix, usual_size, valid_vectors

DIMENSIONS = 8  # even, so that the chi-square distribution has a closed form
CONFIDENCE = 0.99
SAMPLE = 20_000
CELL_ROWS, LEAST_CELLS, MOST_CELLS = 256, 64, 4096
BLOCK_ROWS, BLOCK_QUERIES = 512, 2048


def chi_square(x: float, m: int) -> float:
    """P(X <= x) of the chi-square distribution with an even number m of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


class Cells:
    """The projection and the upper levels of the kd-tree: node i has children 2i+1 and 2i+2, leaves are the cells."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 7):
        self.depth = int(math.log2(cells))
        self.projection = np.random.default_rng(seed).standard_normal((sample.shape[1], DIMENSIONS))
        points = sample @ self.projection
        inner = cells - 1
        self.axis, self.cut = np.zeros(inner, np.int64), np.zeros(inner)
        self.low, self.high = np.full((2 * cells - 1, DIMENSIONS), -np.inf), np.full((2 * cells - 1, DIMENSIONS), np.inf)
        members = {0: np.arange(len(points))}
        for node in range(inner):
            own = members.pop(node)
            if len(own):
                self.axis[node] = int(np.ptp(points[own], axis=0).argmax())
                self.cut[node] = float(np.median(points[own, self.axis[node]]))
            a, c = self.axis[node], self.cut[node]
            right = points[own, a] > c
            for child, rows in ((2 * node + 1, own[~right]), (2 * node + 2, own[right])):
                members[child] = rows
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node + 1, a] = self.low[2 * node + 2, a] = c
        self.low, self.high = self.low[inner:], self.high[inner:]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - len(self.axis)

    def away(self, points: np.ndarray) -> np.ndarray:
        """Squared projected distance of every point to every cell's box."""
        out = np.zeros((len(points), len(self.low)))
        for d in range(DIMENSIONS):
            x = points[:, d, None]
            out += np.maximum(np.maximum(self.low[:, d] - x, x - self.high[:, d]), 0) ** 2
        return out


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, projection: np.ndarray, k: int, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, distance) of the nearest rows of a block: verified in order of projected distance, a step at a time.

    bound is a distance within which k rows are known already (infinite if none is). A row is no candidate for its own id.
    """
    limit, step = chi_square_quantile(confidence, DIMENSIONS), 64
    px, pq = x @ projection, q @ projection
    near = np.maximum((pq**2).sum(1)[:, None] - 2 * pq @ px.T + (px**2).sum(1), 0)
    near[query_ids[:, None] == ids] = np.inf
    order = np.argsort(near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    best = np.full((len(q), k), np.inf)
    which = np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for a, b in slices(len(x), step):
        reach = np.minimum(best[live, -1], bound[live])
        with np.errstate(invalid="ignore"):
            live = live[(near[live, a] < np.inf) & ~(near[live, a] > reach**2 * limit)]
        if not len(live):
            break
        rows = order[live, a:b]
        d = np.sqrt(np.cumsum((x[rows] - q[live][:, None]) ** 2, axis=2)[:, :, -1])  # added in order, as anyone would
        d[np.isinf(near[live, a:b])] = np.inf
        all_d, all_i = np.concatenate((best[live], d), 1), np.concatenate((which[live], ids[rows]), 1)
        first = np.lexsort((all_i, all_d), axis=1)[:, :k]
        best[live], which[live] = np.take_along_axis(all_d, first, 1), np.take_along_axis(all_i, first, 1)
    found = np.isfinite(best) & (best <= bound[:, None])  # what is farther than k known rows is in no result
    return np.repeat(np.arange(len(q)), found.sum(1)), which[found], best[found]


def nearest(df: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest rows of df for every row of queries (default: of df), by Euclidean distance.

    A row is never its own neighbour (same id); ties go to the smaller id; fewer rows than k are all returned. Vectors
    that are not sound take no part as query or candidate, and neither do those of another size than the most frequent one of
    df. Rows with equal ids are separate candidates, and none of them is one for a query of that id; queries of one id have
    k rows each. Other columns are not read. An empty table gives an empty table. The tree is fitted on about SAMPLE rows, and every row is indexed.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vector_col)
    own_size = F.size("v") == usual_size(rows)
    rows = rows.where(own_size)
    total = rows.count()
    out = "ask long, query_id long, id long, score double"
    if not total:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    cells = 1 << max(0, math.ceil(math.log2(min(MOST_CELLS, max(LEAST_CELLS, total / CELL_ROWS)))))
    tree = Cells(sample_matrix(rows, SAMPLE, total, "tree"), cells)
    limit = chi_square_quantile(confidence, DIMENSIONS)

    def route(batches):
        for batch in batches:
            at = tree.of(matrix(batch.column(1)) @ tree.projection) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())], names=["id", "v", "cell"])

    routed = "id long, v array<double>, cell long"
    asked = stored((rows if queries is None else valid_vectors(queries, id_col, vector_col).where(own_size)).mapInArrow(route, routed).withColumn("ask", F.monotonically_increasing_id()), "queries")
    kept = stored(rows.mapInArrow(route, routed), "cells")
    sizes = {r["cell"]: r["n"] for r in kept.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS
    cuts = F.element_at(F.array(*[F.lit(-(-sizes.get(c, 0) // BLOCK_ROWS) or 1) for c in range(cells)]), (F.col("cell") + 1).cast("int"))

    def search(pairs: DataFrame) -> DataFrame:
        """pairs: (ask, query, v, bound, cell). Each query meets every block of its cells."""
        asks = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS
        shares = F.element_at(F.array(*[F.lit(-(-asks.get(c, 0) // BLOCK_QUERIES) or 1) for c in range(cells)]), (F.col("cell") + 1).cast("int"))
        left = pairs.select("ask", "query", "v", "bound", "cell", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("part"), F.pmod(F.xxhash64("ask"), shares).cast("int").alias("share"))
        wanted = F.element_at(F.array(*[F.lit(c in asks) for c in range(cells)]), (F.col("cell") + 1).cast("int"))
        right = kept.where(wanted).select("id", "v", "cell", F.pmod(F.xxhash64("id"), cuts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))

        def run(asking: pa.Table, block: pa.Table) -> pa.Table:
            parts, query = [], np.empty(0, np.int64)
            if asking.num_rows and block.num_rows:
                ids, x = block["id"].to_numpy(), matrix(block["v"])
                q, query, bound = matrix(asking["v"]), asking["query"].to_numpy(), asking["bound"].to_numpy()
                for a, b in slices(len(q), 64):
                    parts.append(search_block(ids, x, query[a:b], q[a:b], bound[a:b], tree.projection, k, confidence))
            at = np.concatenate([a + p[0] for (a, _), p in zip(slices(len(query), 64), parts)]) if parts else np.empty(0, np.int64)
            found = [None] + [np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in (1, 2)]
            return pa.table({"ask": asking["ask"].take(pa.array(at)), "query_id": pa.array(query[at]), "id": pa.array(found[1].astype(np.int64)), "score": pa.array(found[2].astype(np.float64))})

        key = ("cell", "part", "share")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, out)

    home = asked.select("ask", F.col("id").alias("query"), "v", F.lit(float("inf")).alias("bound"), "cell")
    first = stored(search(home), "near")
    order = Window.partitionBy("ask").orderBy("score", "id")
    bounds = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("ask", F.col("score").alias("bound"))
    known = asked.join(bounds, "ask", "left").select("id", "v", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "ask")

    def others(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = batch.column(3).to_numpy()
            for a, b in slices(batch.num_rows, 256):
                within = tree.away(matrix(batch.column(1).slice(a, b - a)) @ tree.projection) <= (bound[a:b] ** 2 * limit)[:, None]
                within[np.arange(b - a), batch.column(2).slice(a, b - a).to_numpy()] = False
                q, c = np.nonzero(within)
                at = pa.array(q + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(c, pa.int64()), batch.column(4).take(at)], names=["query", "v", "bound", "cell", "ask"])

    more = search(known.mapInArrow(others, "query long, v array<double>, bound double, cell long, ask long"))
    ranked = first.union(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every vector whose id is divisible by 100 against all of embeddings; nearest() tells what odd rows give."""
    embeddings = table(spark, sf_dir, "embeddings")
    return nearest(embeddings, embeddings.where("vec_id % 100 = 0"))
