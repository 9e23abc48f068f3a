"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of BLOCK_DIMS dimensions. Cosine >= t means squared distance
<= 2 - 2 t, so in at least one block the squared distance is within that block's proportional share: the
budget. Each block is range-joined on a grid of its first dimensions: a vector has one home cell and is also sent to
the cells within the budget's radius. A pair is verified exactly, and counted in the first block that finds it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import broadcast_if_small, prepare, shuffle_partitions, spool
from marquee.llm.components import connected, forest
from marquee.llm.tokens import string_column

BLOCK_DIMS = 8
#: Vectors of a tile: home vectors and sent vectors that one task compares at once.
TILE = 4096
#: Home vectors of a tile that are compared with the sent ones at once.
ROWS = 512
#: Width of a cell in radii of the budget.
CELL_RADII = 2.0
#: Cell ids are polynomials of the coordinates modulo 2^64 at this odd number, so that all coordinates count at any grid.
CELL_BASE = 0x1E3779B97F4A7C15
#: Candidate pairs that are verified at once.
PAIRS = 20_000
BROADCAST_ROWS = 2_000_000


def usable(col: str):
    """Not null, no null or non-finite component, not all zero."""
    wide = F.transform(F.col(col), lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(col).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(wide, lambda x: x != 0)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def rotation(dims: int, seed: int = 17) -> np.ndarray:
    """A random rotation of R^dims."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def turned(unit: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors in a block (columns of the rotation). Summed in a fixed order, so that a vector
    has the same coordinates in every task."""
    out = np.zeros((len(unit), block.shape[1]))
    for i in range(unit.shape[1]):
        out += unit[:, i:i + 1] * block[i]
    return out


def normalised(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Blocks:
    """The rotation's blocks for vectors of one length, and their budgets."""

    def __init__(self, dims: int, cosine: float):
        turn = rotation(dims)
        self.columns = [turn[:, at:at + BLOCK_DIMS] for at in range(0, dims, BLOCK_DIMS)]
        whole = 2 - 2 * cosine + 1e-9  # a little more than exact, against rounding
        self.budgets = [whole * c.shape[1] / dims for c in self.columns]

    def cells(self, unit: np.ndarray, k: int, grid: int):
        """Home cell of each vector in block k, and (row, cell) once for every cell within the radius (home included).
        Ids are hashes: cells that share one are compared together."""
        radius = math.sqrt(self.budgets[k])
        width = CELL_RADII * radius
        at = turned(unit, self.columns[k][:, :grid])
        home = np.floor(at / width).astype(np.int64)
        low, high = np.floor((at - radius) / width).astype(np.int64), np.floor((at + radius) / width).astype(np.int64)
        rows, cells = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        home_cell = np.zeros(len(unit), np.int64)
        for d in range(at.shape[1]):  # the last block may have fewer dimensions
            home_cell = home_cell * CELL_BASE + home[:, d]
            parts = []
            for step in range(int((high[:, d] - low[:, d]).max()) + 1 if len(unit) else 0):
                c = low[rows, d] + step
                ok = c <= high[rows, d]
                parts.append((rows[ok], cells[ok] * CELL_BASE + c[ok]))
            rows = np.concatenate([p[0] for p in parts]) if parts else rows
            cells = np.concatenate([p[1] for p in parts]) if parts else cells
        order = np.lexsort((cells, rows))
        rows, cells = rows[order], cells[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (cells[1:] != cells[:-1])
        return home_cell, rows[new], cells[new]


def tile_pairs(home: np.ndarray, sent: np.ndarray, home_ids: np.ndarray, sent_ids: np.ndarray, blocks: Blocks, k: int, cosine: float):
    """Linked pairs (row of home, row of sent) with home id < sent id that block k is the first to find."""
    uh, us = normalised(home), normalised(sent)
    a, b = turned(uh, blocks.columns[k]), turned(us, blocks.columns[k])
    found = []
    for at in range(0, len(a), ROWS):
        found += _verified(a[at:at + ROWS], b, at, home, sent, uh, us, home_ids, sent_ids, blocks, k, cosine)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _verified(a, b, first, home, sent, uh, us, home_ids, sent_ids, blocks: Blocks, k: int, cosine: float) -> list:
    gap = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero((gap <= blocks.budgets[k] + 1e-9) & (home_ids[first:first + len(a), None] < sent_ids[None, :]))
    i, found = i + first, []
    for at in range(0, len(i), PAIRS):
        p, q = i[at:at + PAIRS], j[at:at + PAIRS]
        linked = cosines(home[p], sent[q]) >= cosine
        p, q = p[linked], q[linked]
        for e in range(k + 1):
            if not len(p):
                break
            d = turned(uh[p], blocks.columns[e]) - turned(us[q], blocks.columns[e])
            near = (d * d).sum(axis=1) <= blocks.budgets[e]
            keep = near if e == k else ~near
            p, q = p[keep], q[keep]
        found.append((p, q))
    return found


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """Links between vectors of the same label with cosine >= ``cosine``: one row per input row,
    (id, n_links, component_id, kept).

    n_links counts the other vectors linked directly; component_id is the smallest id reachable; kept marks the
    vector that bears it. Vectors that are null, all zero, or have a null or non-finite component, and
    those with a null label or id, link with nothing. Vectors of different length never link. Equal vectors are one node
    whose copies are counted, never listed. An empty table gives an empty result; other columns are not read.

    No pair leaves a task: a tile of at most TILE x TILE vectors sends one row per linked vector. A cell of any
    size is cut into tiles; the grid gets more dimensions as there are more vectors.
    """
    spark = vectors.sparkSession
    prepare(spark)
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    known = every.where(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull()) \
        .select("id", "label", "v")
    node = known.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = spool(node.select(F.col("rep").alias("id"), "label", "v", "copies", F.size("v").alias("dims")), "vectors")
    groups = nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    most = groups.agg(F.max("n").alias("n")).first().n or 0
    lengths = [r.dims for r in nodes.select("dims").distinct().collect()]
    grid = max(1, min(BLOCK_DIMS, math.ceil(math.log(max(1, most) / TILE, 4)) if most > TILE else 1))
    links = None
    for dims in lengths:
        part = _links(nodes.where(F.col("dims") == dims), dims, min(grid, dims), cosine)
        links = part if links is None else links.unionByName(part)
    out = every.select("id", "label", "v")
    if links is None:
        return every.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                            F.lit(True).alias("kept"))
    links = spool(links, "vector-links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    labels = connected(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    state = nodes.select(F.col("id").alias("rep"), "label", "v", "copies").join(counts.withColumnRenamed("id", "rep"), "rep", "left") \
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    state = state.select("label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "rep").alias("component"))
    out = out.join(state, ["label", "v"], "left") \
        .withColumn("own", F.when(F.col("id").isNotNull(), F.col("component")))
    component = F.coalesce("own", "id")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _links(nodes: DataFrame, dims: int, grid: int, cosine: float) -> DataFrame:
    """(id, n, root): copies linked to the vector in a tile, and the smallest id of its linked part of the tile."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast((dims, grid, cosine))
    kind, values = dict(nodes.dtypes)["label"], dict(nodes.dtypes)["v"]

    def place(batches, with_vector):
        dims, grid, cosine = shared.value
        blocks = Blocks(dims, cosine)
        for b in batches:
            unit = normalised(matrix(b, "v"))
            for k in range(len(blocks.columns)):
                home, rows, cells = blocks.cells(unit, k, grid)
                take = np.concatenate([np.arange(len(unit)), rows])
                n = len(take)
                cols = [b.column(b.schema.get_field_index("label")).take(pa.array(take)), pa.array(np.full(n, k, np.int32)),
                        pa.array(np.concatenate([home, cells])), pa.array(np.arange(n) < len(unit))]
                names = ["label", "block", "cell", "home"]
                if with_vector:
                    cols += [b.column(b.schema.get_field_index(c)).take(pa.array(take)) for c in ("id", "copies", "v")]
                    names += ["id", "copies", "v"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    keys = f"label {kind}, block int, cell long, home boolean"
    # cells that need more than one tile
    sizes = (nodes.select("label", "v").mapInArrow(lambda it: place(it, False), keys).groupBy("label", "block", "cell")
             .agg(F.ceil(F.count(F.when(F.col("home"), 1)) / TILE).cast("int").alias("homes"),
                  F.ceil(F.count(F.when(~F.col("home"), 1)) / TILE).cast("int").alias("sents"))
             .where("homes > 1 or sents > 1"))
    large = spool(sizes, "large-cells")
    rows = nodes.select("label", "id", "copies", "v").mapInArrow(lambda it: place(it, True), keys + f", id long, copies long, v {values}")
    cut = rows.join(broadcast_if_small(large, BROADCAST_ROWS), ["label", "block", "cell"], "left").na.fill(1, ["homes", "sents"])
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("sents")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("sents")).otherwise(F.col("homes")) - 1))
    tiles = cut.withColumn("own", own).withColumn("other", other).withColumn(
        "tile", F.when(F.col("home"), F.col("own") * (1 << 31) + F.col("other")).otherwise(F.col("other") * (1 << 31) + F.col("own")))
    where = ["label", "block", "cell", "tile"]
    tiles = tiles.select(*where, "home", "id", "copies", "v").repartition(shuffle_partitions(spark), *where).sortWithinPartitions(*where)

    def compare(batches):
        dims, _, cosine = shared.value
        blocks = Blocks(dims, cosine)

        def linked(key, held):
            ids, copies, home, v = (np.concatenate([h[i] for h in held]) for i in range(4))
            if not home.any() or home.all():
                return None
            hi, si = np.flatnonzero(home), np.flatnonzero(~home)
            p, q = tile_pairs(v[hi], v[si], ids[hi], ids[si], blocks, key[1], cosine)
            if not len(p):
                return None
            # a vector may be both at home and sent: one node
            node, back = np.unique(ids, return_inverse=True)
            size = np.zeros(len(node), np.int64)
            size[back] = copies
            a, c = back[hi[p]], back[si[q]]
            n = np.bincount(a, size[c], len(node)) + np.bincount(c, size[a], len(node))
            root = forest(len(node), a, c)
            used = np.flatnonzero(n)
            return node[used], n[used].astype(np.int64), node[root[used]]

        key, held = None, []
        for b in batches:
            out = []
            cols = [string_column(b, c) for c in where]
            keys = list(zip(*cols, strict=True))
            arrays = (b.column(b.schema.get_field_index("id")).to_numpy(), b.column(b.schema.get_field_index("copies")).to_numpy(),
                      b.column(b.schema.get_field_index("home")).to_numpy(zero_copy_only=False), matrix(b, "v"))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key:
                    if held and (got := linked(key, held)):
                        out.append(got)
                    key, held = keys[at], []
                held.append(tuple(x[at:end] for x in arrays))
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["id", "n", "root"])
        if held and (got := linked(key, held)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["id", "n", "root"])

    return tiles.mapInArrow(compare, "id long, n long, root long")
