"""Interactions, id dimensions, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import checkpoint


def dense_index(df: DataFrame, col: str, idx: str = "idx", first_seen: str | None = None) -> DataFrame:
    """M1: distinct values of ``col`` numbered 0..n-1, fully distributed: in sorted order, or with ``first_seen`` in the order
    in which they first appear by that column (equal first places by value).

    zipWithIndex pattern in two passes: the ordered distinct values are
    range-partitioned and checkpointed (so both passes see the same layout);
    one small job counts rows per partition (one number per partition), and
    the offsets are added to the position inside each partition. No global
    un-partitioned window is used.
    """
    known = df.where(F.col(col).isNotNull())
    if first_seen is None:
        d = known.select(col).distinct().orderBy(col)
    else:
        d = known.groupBy(col).agg(F.min(first_seen).alias("_first")).orderBy("_first", col).select(col)
    d = d.withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_mid", F.monotonically_increasing_id())
    d = checkpoint(d)
    counts = {r["_pid"]: (r["n"], r["lo"]) for r in
              d.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("lo")).collect()}
    offs, acc = {}, 0
    for pid in sorted(counts):
        offs[pid] = acc - counts[pid][1]
        acc += counts[pid][0]
    if not offs:
        return d.select(col, F.lit(0).cast("bigint").alias(idx)).limit(0)
    m = F.create_map(*[x for pid, o in offs.items() for x in (F.lit(pid), F.lit(o))])
    return d.select(col, (F.col("_mid") + m[F.col("_pid")]).cast("bigint").alias(idx))


def build_interactions(reviews: DataFrame, user: str = "username", item: str = "tmdb_id",
                       rating: str = "rating", order: str = "seq", dup_policy: str = "last") -> DataFrame:
    """One row per (user, item); zero ratings stay absent.

    ``dup_policy='last'`` keeps the last rating in source order (live engine);
    ``'sum'`` adds duplicates (CSR-triplet engine, Q19).
    """
    r = reviews.where(F.col(user).isNotNull() & F.col(item).isNotNull() & F.col(rating).isNotNull())
    if dup_policy == "last":
        agg = F.max_by(F.col(rating), F.col(order))
    elif dup_policy == "sum":
        agg = F.sum(F.col(rating))
    else:
        raise ValueError(dup_policy)
    out = r.groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(agg.cast("double").alias("rating"))
    return out.where(F.col("rating") != 0)


def hash_split(inter: DataFrame, test_pct: int = 20, seed: int = 42, key=None) -> DataFrame:
    """Adds ``is_test``; stable under repartitioning (hash of the pair, not rand())."""
    k = key if key is not None else F.pmod(F.xxhash64("user", "item", F.lit(seed)), F.lit(100))
    return inter.withColumn("is_test", k < test_pct)


def hash_sample(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """A seeded sample of exactly n rows: order by a hash of the key, keep n."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed)), *key_cols).limit(n)


def density(inter: DataFrame) -> DataFrame:
    """Users, items, interactions, density and rating moments."""
    return inter.agg(
        F.count_distinct("user").alias("users"), F.count_distinct("item").alias("items"),
        F.count(F.lit(1)).alias("interactions"),
        F.round(F.count(F.lit(1)) / (F.count_distinct("user") * F.count_distinct("item")), 6).alias("density"),
        F.round(F.avg("rating"), 6).alias("rating_mean"), F.round(F.stddev_samp("rating"), 6).alias("rating_std"))
