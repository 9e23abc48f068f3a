"""Scoring and top-N.

Top-N goes through the bounded item index of ``marquee.operators.topk``. AUC needs every score: users are
hashed into blocks of bounded size and all items stream past each of them, scored with numpy, never as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.vector import clip, dot, unit, z_to_unit
from marquee.operators.topk import ItemIndex

#: Users of a block (more, up to the second figure, where there are over ``AUC_BLOCKS`` of them) and items of a chunk that AUC compares
#: at once: what one task holds, whatever the size of the tables.
AUC_USER_ROWS, AUC_MOST_ROWS, AUC_BLOCKS, ITEM_ROWS = 2048, 8192, 64, 4096
#: Numbers in one packed row of items, and score-matrix cells of a tile that stays in a core's cache.
PACKED, TILE = 1024, 1 << 16


def _type_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _seq_scores(u: np.ndarray, vt: np.ndarray, bias: np.ndarray, acc: np.ndarray, product: np.ndarray) -> np.ndarray:
    """u @ vt + bias, summed coordinate by coordinate from 0 in the same order
    as the JVM ``dot`` expression, so scores computed here and in Spark are
    bit-identical (exact ties for rank statistics). ``acc`` (returned) and ``product`` are overwritten."""
    acc.fill(0.0)
    for j, coordinate in enumerate(vt):
        np.multiply(u[:, j:j + 1], coordinate, out=product)
        acc += product
    acc += bias
    return acc


def _packed(items: DataFrame) -> DataFrame:
    """Items (factors, bias) many to a row: (n, v) with v the n items' factors, each with its bias behind."""
    def pack(batches):
        for b in batches:
            if b.num_rows:
                rows = np.column_stack([np.stack(b.column(0).to_numpy(zero_copy_only=False)), b.column(1).to_numpy(zero_copy_only=False)]).astype(float)
                step = max(1, PACKED // rows.shape[1])
                parts = [rows[a:a + step] for a in range(0, len(rows), step)]
                yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int32()), pa.array([p.ravel() for p in parts], pa.list_(pa.float64()))],
                                                 names=["n", "v"])

    return items.select(F.col("factors").cast("array<double>"), F.col("bias").cast("double")).mapInArrow(pack, "n int, v array<double>")


def blocked_topk(users: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None,
                 centres: int | None = None) -> DataFrame:
    """Top-k items per user by dot(user.factors, item.factors) + item.bias, through the bounded index of
    ``marquee.operators.topk``.

    users: (user, factors); items: (item, factors[, bias]); seen: (user, item)
    pairs to exclude. Returns (user, item, score, rank) with rank 1..k by
    score desc, item asc.
    """
    return ItemIndex(items, centres).top(users, k, seen)


def blocked_auc(users: DataFrame, items: DataFrame, positives: DataFrame,
                user_blocks: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Per-user AUC of the full item ranking, positives = ``positives`` (user, item).

    Mann-Whitney with ties counted one half. A user's row holds the sorted scores of the positives, so that they cut the
    user's scores into rank intervals. All items stream past a block of users; each chunk adds, by bisection, how often its scores
    lie below the positives'. What the positives themselves and the pairs of ``exclude`` (user, item; neither positives nor
    negatives) add to that is known from their own scores and taken off again. No positive or excluded pair meets
    an item block, and a task holds its users and one chunk of items. Items travel to the blocks many to a row. Returns (user, auc).
    """
    if not user_blocks:
        n_users = users.count()
        user_blocks = -(-n_users // min(AUC_MOST_ROWS, max(AUC_USER_ROWS, -(-n_users // AUC_BLOCKS))))
    ub = max(1, user_blocks)
    ut = _type_of(users, "user")
    if "bias" not in items.columns:
        items = items.withColumn("bias", F.lit(0.0))
    iv = items.select(F.col("item").alias("_pi"), F.col("factors").cast("array<double>").alias("_pf"), F.col("bias").alias("_pb"))
    uv = users.select(F.col("user").alias("_pu"), F.col("factors").cast("array<double>").alias("_uf"))
    pairs = positives.select("user", "item", F.lit(True).alias("_p"))
    if exclude is not None:
        pairs = pairs.unionByName(exclude.select("user", "item", F.lit(False).alias("_p")))
    pairs = pairs.groupBy("user", "item").agg(F.max("_p").alias("_p"))
    scored = pairs.join(uv, pairs.user == uv._pu).join(iv, pairs.item == iv._pi).select("user", "_p", (dot("_uf", "_pf") + F.col("_pb")).alias("_s"))
    # a user's own scores are one row: at most one a rated item
    own = scored.groupBy("user").agg(F.sort_array(F.collect_list(F.when(F.col("_p"), F.col("_s")))).alias("pos"), F.sort_array(F.collect_list("_s")).alias("off"))
    own = own.where(F.size("pos") > 0).join(uv, F.col("user") == F.col("_pu"))
    block = F.pmod(F.xxhash64("user"), F.lit(ub)).cast("int")
    left = own.select(block.alias("ub"), F.lit(0).alias("n"), "user", F.col("_uf").alias("v"), "pos", "off")
    none = F.lit(None).cast("array<double>")
    right = _packed(items).select(F.explode(F.sequence(F.lit(0), F.lit(ub - 1))).alias("ub"), "n", F.lit(None).cast(ut).alias("user"), "v",
                                  none.alias("pos"), none.alias("off"))

    def count(batches):
        at, held, u, lower, n, waiting, packs = None, [], None, None, 0, 0, []

        def add():
            """The scores of the held items against every user's positives."""
            nonlocal u, lower, n, waiting, packs
            if u is None:
                u, lower = np.stack([h[1] for h in held]), np.zeros(len(held))
            v = np.concatenate(packs)
            for start in range(0, len(v), ITEM_ROWS):
                own = v[start:start + ITEM_ROWS]
                vt, bias = np.ascontiguousarray(own[:, :-1].T), np.ascontiguousarray(own[:, -1])
                step = max(1, TILE // len(own))
                acc, product = np.empty((2, min(step, len(held)), len(own)))
                for a in range(0, len(held), step):
                    some = u[a:a + step]
                    scores = _seq_scores(some, vt, bias, acc[:len(some)], product[:len(some)])
                    scores.sort(axis=1)
                    for i, row in enumerate(scores, a):
                        lower[i] += 0.5 * (row.searchsorted(held[i][2], "left") + row.searchsorted(held[i][2], "right")).sum()
            n += len(v)
            waiting, packs = 0, []

        def done():
            if held and packs:
                add()
            if held and n:
                users_, auc = [], []
                for (key, _, pos, off), total in zip(held, lower, strict=True):
                    negatives = n - len(off)
                    if negatives > 0:
                        total -= 0.5 * (off.searchsorted(pos, "left") + off.searchsorted(pos, "right")).sum()
                        users_.append(key)
                        auc.append(total / (len(pos) * negatives))
                yield pa.RecordBatch.from_arrays([pa.array(users_, user_type), pa.array(auc, pa.float64())], names=["user", "auc"])

        for b in batches:
            user_type = b.schema.field("user").type
            for r in zip(*(b.column(i).to_pylist() if i < 3 else b.column(i).to_numpy(zero_copy_only=False) for i in range(6)), strict=True):
                if r[0] != at:
                    yield from done()
                    at, held, u, lower, n, waiting, packs = r[0], [], None, None, 0, 0, []
                if r[1] == 0:
                    held.append((r[2], r[3], np.asarray(r[4]), np.asarray(r[5])))
                elif held:
                    packs.append(r[3].reshape(r[1], -1))
                    waiting += r[1]
                    if waiting >= ITEM_ROWS:
                        add()
        yield from done()

    rows = left.unionByName(right).repartition(ub, "ub").sortWithinPartitions("ub", "n")
    return rows.mapInArrow(count, f"user {ut}, auc double")


def cosine_neighbours(vectors: DataFrame, k: int, key: str = "id", vec: str = "embedding",
                      **blocks) -> DataFrame:
    """M5: the k most cosine-similar other rows of each row (N x N never materialised).

    Rows are L2-normalised, then scored by ``blocked_topk`` with themselves
    excluded. Returns (id, neighbour, similarity, rank).
    """
    u = vectors.select(F.col(key).alias("user"), unit(F.col(vec).cast("array<double>")).alias("factors"))
    i = vectors.select(F.col(key).alias("item"), unit(F.col(vec).cast("array<double>")).alias("factors"))
    self_pairs = vectors.select(F.col(key).alias("user"), F.col(key).alias("item"))
    top = blocked_topk(u, i, k, seen=self_pairs, **blocks)
    return top.select(F.col("user").alias(key), F.col("item").alias("neighbour"),
                      F.col("score").alias("similarity"), "rank")


def content_profiles(train: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """M6 helper: per-user sparse profiles R_u = sum r_j x_j and S_u = sum x_j.

    ``item_vectors`` is long (item, feature, weight) with unit rows.
    """
    j = train.join(item_vectors, "item")
    return j.groupBy("user", "feature").agg(F.sum(F.col("rating") * F.col("weight")).alias("r_sum"),
                                            F.sum("weight").alias("s_sum"))


def unit_rows(features: DataFrame, item: str = "tmdb_id") -> DataFrame:
    """L2-normalise each item's row of a long feature table -> (item, feature, weight)."""
    n = features.groupBy(F.col(item).alias("_i")).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_n"))
    j = features.join(n, features[item] == n._i)
    return j.where(F.col("_n") > 0).select(F.col(item).alias("item"), "feature",
                                            (F.col("weight") / F.col("_n")).alias("weight"))


def content_scores(pairs: DataFrame, train: DataFrame, item_vectors: DataFrame,
                   no_ratings_default: float = 0.5) -> DataFrame:
    """M6 exactly, without the item x item similarity matrix.

    cb(u, i) = sum_j r_j cos(i, j) / sum_j cos(i, j) = (x_i . R_u) / (x_i . S_u)
    over the user's rated items j; the plain mean when the denominator is not
    positive; ``no_ratings_default`` for a user without ratings.
    pairs: (user, item). Returns (user, item, cb).
    """
    prof = content_profiles(train, item_vectors)
    px = pairs.select("user", "item").join(item_vectors, "item")
    j = px.join(prof, ["user", "feature"])
    num = j.groupBy("user", "item").agg(F.sum(F.col("weight") * F.col("r_sum")).alias("num"),
                                        F.sum(F.col("weight") * F.col("s_sum")).alias("den"))
    means = train.groupBy(F.col("user").alias("_mu")).agg(F.avg("rating").alias("_mean"))
    out = pairs.select("user", "item").join(num, ["user", "item"], "left") \
        .join(means, F.col("user") == F.col("_mu"), "left")
    cb = F.when(F.col("den") > 0, F.col("num") / F.col("den")) \
        .when(F.col("_mean").isNotNull(), F.col("_mean")).otherwise(F.lit(no_ratings_default))
    return out.select("user", "item", cb.alias("cb"))


def baseline_predictions(pairs: DataFrame, train: DataFrame, default: float = 6.0) -> DataFrame:
    """A26 + P13: user mean + item mean - global mean; default for unknown users/items."""
    g = train.agg(F.avg("rating").alias("_g"))
    um = train.groupBy(F.col("user").alias("_u")).agg(F.avg("rating").alias("_um"))
    im = train.groupBy(F.col("item").alias("_i")).agg(F.avg("rating").alias("_im"))
    j = pairs.join(um, pairs.user == um._u, "left").join(im, pairs.item == im._i, "left")
    gm = float(g.first()["_g"] or default)
    pred = F.when(F.col("_um").isNull() | F.col("_im").isNull(), F.lit(default)) \
        .otherwise(F.col("_um") + F.col("_im") - F.lit(gm))
    return j.select(*pairs.columns, pred.alias("pred"))


def blend(cf, cb, alpha: float = 0.7, variant: str = "raw", cf_mean: float = 0.0, cf_std: float = 1.0):
    """M7: alpha * CF + (1 - alpha) * CB, three published variants.

    'zscore': CF z-scored, mapped to [0,1] by (z+3)/6, blended, x10, clipped to [1, 10];
    'raw_mean': raw CF blended with a content mean, clipped to [0.5, 10];
    'raw': raw CF and CB blended, clipped to [1, 10].
    Columns or numpy arrays, to the same bits.
    """
    if variant == "zscore":
        z = (cf - cf_mean) / (cf_std if cf_std else 1.0)
        return clip((alpha * z_to_unit(z) + (1 - alpha) * cb) * 10.0, 1.0, 10.0)
    if variant == "raw_mean":
        return clip(alpha * cf + (1 - alpha) * cb, 0.5, 10.0)
    if variant == "raw":
        return clip(alpha * cf + (1 - alpha) * cb, 1.0, 10.0)
    raise ValueError(variant)


def rank_within_user(df: DataFrame, score: str = "score", user: str = "user", item: str = "item",
                     n: int | None = None) -> DataFrame:
    """1..N per user by score desc, item asc (re-run after any filter)."""
    w = Window.partitionBy(user).orderBy(F.col(score).desc(), F.col(item).asc())
    out = df.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= n) if n else out


def enrich(recs: DataFrame, metadata: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """J15 + J17: metadata of each recommended id (first row per id) and the seen flag."""
    from marquee.operators.catalog import first_by_key
    meta = first_by_key(metadata.withColumnRenamed("tmdb_id", "item"), ["item"])
    out = recs.join(meta.drop("seq"), "item", "left")
    if seen is not None:
        s = seen.select(F.col("user").alias("_su"), F.col("item").alias("_si")).distinct()
        out = out.join(s, (out.user == s._su) & (out.item == s._si), "left") \
            .withColumn("already_reviewed", F.col("_si").isNotNull()).drop("_su", "_si")
    return out
