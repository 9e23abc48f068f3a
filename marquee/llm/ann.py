"""Approximate nearest neighbours by largest inner product: stable random projections and a kd-tree.

Vectors get one more coordinate so that all have the same length; the largest inner product is then the smallest
distance. A projection to a few Gaussian directions keeps distances up to a chi-square factor: the
squared projected distance of a vector at distance d is d^2 times a chi-square variable of as many degrees
of freedom. Each index block (a bounded number of rows) holds a kd-tree over its projections. A query
takes projected neighbours in growing distance and verifies them on the original vectors, until a vector as near as the k-th
best would, with the asked probability, already have appeared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import prepare, shuffle_partitions, spool
from marquee.llm.tokens import string_column
from marquee.llm.vectors import matrix, usable

#: Projected dimensions (even: the chi-square distribution then has a closed form).
PROJECTED = 12
#: Probability that a vector as near as the k-th best has appeared when a search stops.
CONFIDENCE = 0.97
INDEX_ROWS = 16_384
QUERY_ROWS = 1_024
LEAF = 256
#: Leaves that a query opens at once.
LEAVES = 8


def chi_square_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    def cdf(x):
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total
    lo, hi = 0.0, 20.0 * dof
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(dims: int, seed: int = 29) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims, PROJECTED))


class Tree:
    """kd-tree over projections: leaves of about LEAF rows with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        leaves, stack = [], [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = len(rows) // 2
            order = np.argpartition(own[:, axis], half)
            stack += [rows[order[:half]], rows[order[half:]]]
        self.order = np.concatenate(leaves)  # rows in the order of their leaves
        self.ends = np.cumsum([len(r) for r in leaves])
        self.starts = self.ends - [len(r) for r in leaves]
        self.low = np.array([points[r].min(axis=0) for r in leaves])
        self.high = np.array([points[r].max(axis=0) for r in leaves])

    def box_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.maximum(self.low[None] - q[:, None], 0) + np.maximum(q[:, None] - self.high[None], 0)
        return (out * out).sum(axis=2)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, boxes: np.ndarray, own: int, k: int,
           length2: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best found for one query: (rows, inner products); ``vectors`` and ``ids`` lie in the tree's order.

    ``length2``: squared length of the lifted vectors; the query is scaled to that length, so its squared distance to
    a vector is 2 (length2 - s * product). Leaves are opened in growing projected distance of their boxes and
    verified whole: all vectors whose projected distance is below the next box have then been seen.
    """
    order = np.argsort(boxes, kind="stable")
    scale = math.sqrt(length2 / float(query @ query))
    rows = np.arange(len(vectors))
    best, score, floor = np.zeros(0, np.int64), np.zeros(0), -np.inf
    for at in range(0, len(order), LEAVES):
        spans = [slice(tree.starts[i], tree.ends[i]) for i in order[at:at + LEAVES]]
        new = np.concatenate([vectors[x] @ query for x in spans])
        found = np.concatenate([rows[x] for x in spans])
        keep = new >= floor - 1e-9 * max(1.0, abs(floor)) if len(best) >= k else np.ones(len(new), bool)
        new, found = new[keep], found[keep]
        other = ids[found] != own
        best, score = np.concatenate([best, found[other]]), np.concatenate([score, new[other]])
        if len(best) > k:
            floor = np.partition(score, -k)[-k]
            keep = score >= floor - 1e-9 * max(1.0, abs(floor))
            best, score = best[keep], score[keep]
        if len(best) >= k and at + LEAVES < len(order):
            floor = np.partition(score, -k)[-k]
            if boxes[order[at + LEAVES]] >= stop * max(0.0, 2 * (length2 - scale * floor)):
                break
    exact = (vectors[best] * query).sum(axis=1)
    order = np.lexsort((ids[best], -exact))[:k]
    return best[order], exact[order]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            confidence: float = CONFIDENCE) -> DataFrame:
    """The k candidates of largest inner product found for each query: (query_id, rank, vec_id, score).

    ``score`` is the inner product of the original vectors in double precision; nearest first, ties to the smaller
    id; all candidates where there are fewer than k. Rows with the query's own id are no candidates of it. Null vectors,
    zero vectors and those with a null or non-finite component take no part, nor do null ids; vectors of
    different lengths do not meet. Repeated candidate rows may each be found; of repeated query rows one is used. Empty tables give an
    empty result; other columns are not read.

    All rows are indexed, in blocks of about INDEX_ROWS by a hash of the id, and meet the queries in blocks
    of about QUERY_ROWS. A task holds one block of each; only k rows per query and index block leave it.
    """
    spark = candidates.sparkSession
    prepare(spark)

    def clean(df):
        return df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).withColumn("dims", F.size("v"))

    index, asked = spool(clean(candidates), "index"), clean(queries).dropDuplicates(["id"])
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shape = {r.dims: (r.n, r.most) for r in index.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("most")).collect()}
    asked = spool(asked.where(F.col("dims").isin(list(shape))), "queries")
    n_asked = asked.count()
    parts = {d: max(1, -(-n // INDEX_ROWS)) for d, (n, _) in shape.items()}
    sides = max(1, -(-n_asked // QUERY_ROWS))
    pieces = F.create_map(*[F.lit(x) for d, n in parts.items() for x in (d, n)])[F.col("dims")] if parts else F.lit(1)
    rows = index.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), pieces)).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))) \
        .withColumn("asks", F.lit(False))
    asks = asked.withColumn("side", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(sides))) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("asks", F.lit(True))
    where = ["dims", "part", "side"]
    columns = [F.col("dims").cast("long"), F.col("part").cast("long"), F.col("side").cast("long"), "asks", "id", "v"]
    tiles = rows.select(*columns).unionByName(asks.select(*columns))
    tiles = tiles.repartition(max(shuffle_partitions(spark), sum(parts.values()) * sides), *where).sortWithinPartitions(*where, "asks", "id")
    shared = spark.sparkContext.broadcast({d: most for d, (_, most) in shape.items()})
    stop = chi_square_quantile(confidence, PROJECTED)

    def answer(batches):
        def found(key, held):
            ids, asks, v = (np.concatenate([h[i] for h in held]) for i in range(3))
            if asks.all() or not asks.any():
                return None
            own, x, qid, q = ids[~asks], v[~asks], ids[asks], v[asks]
            length2 = shared.value[key[0]]
            lift = np.sqrt(np.maximum(0, length2 - (x * x).sum(axis=1)))
            turn = directions(x.shape[1] + 1)
            tree = Tree(x @ turn[:-1] + lift[:, None] * turn[-1])
            scaled = q * np.sqrt(length2 / (q * q).sum(axis=1))[:, None]
            x, own = x[tree.order], own[tree.order]
            points = scaled @ turn[:-1]
            out = [[], [], []]
            for at in range(0, len(q), 256):
                boxes = tree.box_distances(points[at:at + 256])
                for i in range(len(boxes)):
                    best, score = search(tree, x, own, q[at + i], boxes[i], qid[at + i], k, length2, stop)
                    out[0].append(np.full(len(best), qid[at + i]))
                    out[1].append(own[best])
                    out[2].append(score)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

        key, held = None, []
        for b in batches:
            keys = list(zip(*(string_column(b, c) for c in where), strict=True))
            ids = b.column(b.schema.get_field_index("id")).to_numpy()
            asks = b.column(b.schema.get_field_index("asks")).to_numpy(zero_copy_only=False)
            offsets = b.column(b.schema.get_field_index("v"))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key:
                    if held and (got := found(key, held)):
                        yield got
                    key, held = keys[at], []
                v = offsets.slice(at, end - at).flatten().to_numpy(zero_copy_only=False).reshape(end - at, -1)
                held.append((ids[at:end], asks[at:end], v))
                at = end
        if held and (got := found(key, held)):
            yield got

    best = tiles.mapInArrow(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
