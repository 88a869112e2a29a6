"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt to shards by hash; a shard has a bounded number of rows and its own
tree. A query visits every shard. In a tree a branch is skipped when the triangle
inequality shows it to be farther than the tenth-best so far divided by ``factor``:
at factor 1 the search is exact, above it branches that could hold little are skipped.
Queries walk the tree in blocks, so distances are matrix work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.session import written

LEAF = 128
SLACK = 1e-9  # rounding never skips a branch


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed along the dimensions in order."""
    total = np.zeros((len(queries), len(points)))
    for j in range(queries.shape[1]):
        step = queries[:, j, None] - points[None, :, j]
        step *= step
        total += step
    return np.sqrt(total, out=total)


class Tree:
    """A vantage-point tree over rows of a matrix; nodes are (vantage, inside, outside) or leaves."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids
        self.draw = np.random.default_rng(len(ids))
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        # of a few candidates, the vantage point that spreads a sample of rows most
        sample = self.points[self.draw.choice(rows, min(len(rows), 64), replace=False)]
        tried = self.draw.choice(rows, 4, replace=False)
        vantage = tried[np.argmax(distances(self.points[tried], sample).std(1))]
        far = distances(self.points[vantage][None], self.points[rows])[0]
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        parts = []
        for side in (order[:half], order[half:]):
            parts.append((far[side].min(), far[side].max(), self._build(rows[side])))
        return vantage, parts[0], parts[1]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the ``k`` nearest of each query, infinity where there are fewer."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)

        def visit(node, active: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                near = distances(queries[active], self.points[node])
                near[own[active][:, None] == self.ids[node][None, :]] = np.inf
                hit = (near <= best[active, -1][:, None]).any(1)
                if hit.any():
                    rows = active[hit]
                    d = np.concatenate([best[rows], near[hit]], 1)
                    i = np.concatenate([found[rows], np.broadcast_to(self.ids[node], (len(rows), len(node)))], 1)
                    first = np.lexsort((i, d), axis=1)[:, :k]
                    best[rows], found[rows] = np.take_along_axis(d, first, 1), np.take_along_axis(i, first, 1)
                return
            vantage, inside, outside = node
            d = distances(queries[active], self.points[vantage][None])[:, 0]
            first = d <= (inside[1] + outside[0]) / 2
            for wanted in (True, False):  # each query's nearer side, then the other if still needed
                for (low, high, child), side in ((inside, first == wanted), (outside, first != wanted)):
                    bound = np.maximum(low - d, d - high)
                    go = side & (bound * factor <= best[active, -1] * (1 + SLACK) + SLACK)
                    if go.any():
                        visit(child, active[go])

        if len(self.ids) and len(queries):
            visit(self.root, np.arange(len(queries)))
        return best, found


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = 8192, query_block: int = 8192) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of every query row.

    ``is_query`` is a condition on ``vectors``. Nearest first, ties to the smaller id;
    fewer than ``k`` rows if there are fewer. Rows with a null id or an unusable
    vector take no part, rows that repeat an id with the same vector count once, and
    a query's own id is never its neighbour. Vectors only meet those of their length.
    Of equal vectors only the ``k + 1`` smallest ids can be in a result, so the others
    are left out before the search, whatever their number. No rows give no rows.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).where(usable(F.col(vector_col))).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vec"),
        is_query.alias("query"))
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), F.col("vec"))})
    rows = rows.dropDuplicates(["id", "h1", "h2"]).withColumn("dim", F.size("vec"))
    queries = rows.where("query").select("id", "vec", "dim")
    same = Window.partitionBy("h1", "h2").orderBy("id")
    points = rows.drop("query").withColumn("_place", F.row_number().over(same)).where(F.col("_place") <= k + 1)
    points = written(points.select("id", "vec", "dim"), "points")
    queries = written(queries, "queries")

    # sizes: shards and query blocks are dealt so that a cell is bounded
    shards = points.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    sizes = shards.join(queries.groupBy("dim").agg(F.ceil(F.count("*") / query_block).alias("blocks")), "dim")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    left = points.join(sizes, "dim").select("dim", deal(F.col("shards")).alias("shard"), spread(F.col("blocks")).alias("block"), "id", "vec")
    right = queries.join(sizes, "dim").select("dim", spread(F.col("shards")).alias("shard"), deal(F.col("blocks")).alias("block"), "id", "vec")

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table["id"].to_numpy()
        flat = table["vec"].combine_chunks()
        flat = flat.flatten().to_numpy(zero_copy_only=False) if len(ids) else np.empty(0)
        return ids, flat.reshape(len(ids), -1)

    def cell(shard: pa.Table, asked: pa.Table) -> pa.Table:
        ids, data = matrix(shard)
        own, wanted = matrix(asked)
        if not len(ids) or not len(own):
            return schema.empty_table()
        score, found = Tree(data, ids).search(wanted, own, k, factor)
        real = np.isfinite(score)
        return pa.Table.from_arrays(
            [pa.array(np.broadcast_to(own[:, None], score.shape)[real]), pa.array(found[real]), pa.array(score[real])],
            schema=schema)

    keys = ["dim", "shard", "block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id bigint, vec_id bigint, score double")
    # an id with several vectors is one candidate, at its nearest
    hits = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
