"""Data-quality and distribution profiles.

All profiles run on a long ``(field, value)`` form produced by ``unpivot``;
per-column statistics are aggregates grouped by the column name, and the
statistics are joined back by that name (an equi-join on a tiny frame, never
a cross join). Exact percentiles use Spark's ``percentile`` aggregate whose
buffer is a value->count map: its size is the number of *distinct* values,
which for catalogue-level columns is bounded by the number of items.
``approx=True`` switches to ``percentile_approx`` for fact-scale columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.vector import r6

PCTS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def long_form(df: DataFrame, cols: list[str], positive_only: bool = False) -> DataFrame:
    """Unpivot numeric columns to (column, value DOUBLE)."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    x = x.unpivot([], cols, "field", "value")
    if positive_only:
        x = x.where(F.col("value") > 0)
    return x


def _pct(col, p, approx: bool):
    if approx:
        return F.percentile_approx(col, p, 100000)
    return F.percentile(col, p)


def numeric_profile(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Total, non-null, null %, min, max, mean, median, sample std per column."""
    return profile_long(long_form(df, cols), approx)


def profile_long(lf: DataFrame, approx: bool = False) -> DataFrame:
    """A8 over rows of (field, value)."""
    g = lf.groupBy("field").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("value").alias("non_null"),
        r6((F.count(F.lit(1)) - F.count("value")) * 100.0 / F.count(F.lit(1))).alias("null_pct"),
        r6(F.min("value")).alias("min"),
        r6(F.max("value")).alias("max"),
        r6(F.avg("value")).alias("mean"),
        *([r6(_pct(F.col("value"), 0.5, True)).alias("median")] if approx else []),
        r6(F.stddev_samp("value")).alias("std"),
    )
    if not approx:
        # one row per column: a bounded broadcast
        middle = exact_percentiles(lf, [0.5]).select(F.col("field").alias("_c"), r6("value").alias("median"))
        g = g.join(F.broadcast(middle), g.field == F.col("_c"), "left")
    return g.select("field", "total", "non_null", "null_pct", "min", "max", "mean", "median", "std")


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` 1, 2, ... over its total order, without one task for all rows: range partitions are
    numbered on their own, and the driver gets one row count per partition."""
    from marquee.session import checkpoint
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = checkpoint(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    before, offsets = 0, []
    for row in sorted(r.groupBy("_pid").count().collect()):
        offsets.append((row["_pid"], before))
        before += row["count"]
    off = df.sparkSession.createDataFrame(offsets, "_pid int, _before long")
    w = Window.partitionBy("_pid").orderBy(*order)
    return r.join(F.broadcast(off), "_pid").withColumn("rank", F.row_number().over(w) + F.col("_before")).drop("_pid", "_before")


def exact_percentiles(lf: DataFrame, probs, parts: int | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles of (field, value) without one big buffer.

    1. per-value counts (a map-side combined aggregate);
    2. the counts are range-partitioned by (field, value) and checkpointed, so
       the layout is fixed;
    3. one small job returns the row total of every (field, partition), which
       is at most fields x partitions numbers; the driver turns them into rank
       offsets;
    4. a running count inside each range partition gives every distinct value
       its rank interval;
    5. each target rank is resolved by an equi-join on (field, partition)
       followed by an interval filter, so no range join or global window is
       planned.

    Returns (field, p, value).
    """
    from marquee.session import checkpoint
    spark = lf.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vc = lf.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("c"))
    r = checkpoint(vc.repartitionByRange(n, "field", "value").withColumn("_pid", F.spark_partition_id()))
    sizes = sorted((x["field"], x["_pid"], x["s"]) for x in
                   r.groupBy("field", "_pid").agg(F.sum("c").alias("s")).collect())
    offs, totals = [], {}
    for f, pid, sz in sizes:
        offs.append((f, pid, totals.get(f, 0)))
        totals[f] = totals.get(f, 0) + sz
    targets = []
    for f, total in totals.items():
        parts_f = [(pid, off) for (ff, pid, off) in offs if ff == f]
        for p in probs:
            pos = (total - 1) * p
            lo = int(pos // 1)
            hi = min(lo + 1, total - 1) if pos > lo else lo
            for which, rank in (("lo", lo), ("hi", hi)):
                pid = max(pi for pi, off in parts_f if off <= rank)
                targets.append((f, pid, float(p), which, int(rank), float(pos - lo)))
    if not targets:
        return spark.createDataFrame([], "field string, p double, value double")
    off_df = spark.createDataFrame(offs, "field string, _pid int, off long")
    w = Window.partitionBy("field", "_pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = r.join(F.broadcast(off_df), ["field", "_pid"]) \
        .withColumn("_end", F.col("off") + F.sum("c").over(w)) \
        .withColumn("_start", F.col("_end") - F.col("c"))
    t = spark.createDataFrame(targets, "field string, _pid int, p double, which string, rank long, frac double")
    hit = ranked.join(F.broadcast(t), ["field", "_pid"]) \
        .where((F.col("_start") <= F.col("rank")) & (F.col("rank") < F.col("_end")))
    g = hit.groupBy("field", "p").agg(F.max(F.when(F.col("which") == "lo", F.col("value"))).alias("_lo"),
                                      F.max(F.when(F.col("which") == "hi", F.col("value"))).alias("_hi"),
                                      F.max("frac").alias("_f"))
    return g.select("field", "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))


def median(values: DataFrame) -> float | None:
    """Exact median of the column ``value``, as one number on the driver; None without values."""
    r = exact_percentiles(values.select(F.lit("v").alias("field"), "value"), [0.5]).first()
    return r["value"] if r else None


def percentiles(df: DataFrame, cols: list[str], probs=PCTS, positive_only: bool = True,
                approx: bool = False, distributed: bool = False) -> DataFrame:
    """Percentiles with linear interpolation (numpy / DuckDB quantile_cont).

    ``distributed=True`` uses ``exact_percentiles`` (no single aggregation
    buffer holds the distinct values); ``approx=True`` uses percentile_approx.
    """
    lf = long_form(df, cols, positive_only)
    if distributed:
        ex = exact_percentiles(lf, probs)
        return ex.groupBy("field").agg(*[
            r6(F.max(F.when(F.col("p") == float(p), F.col("value")))).alias(f"p{int(round(p * 100)):02d}")
            for p in probs])
    arr = _pct(F.col("value"), list(probs), approx)
    g = lf.groupBy("field").agg(arr.alias("_p"))
    return g.select("field", *[r6(F.col("_p")[i]).alias(f"p{int(round(p * 100)):02d}")
                                for i, p in enumerate(probs)])


def quartile_frame(lf: DataFrame, approx: bool = False) -> DataFrame:
    """Quartiles and extremes of each field: one row per field, so that it may be broadcast."""
    ends = lf.groupBy("field").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"),
                                   *([_pct(F.col("value"), [0.25, 0.5, 0.75], True).alias("_q")] if approx else []))
    if approx:
        q = [F.col("_q")[i] for i in range(3)]
    else:
        ex = exact_percentiles(lf, (0.25, 0.5, 0.75)).groupBy(F.col("field").alias("_f")).agg(
            *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"_q{i}") for i, p in enumerate((0.25, 0.5, 0.75))])
        ends = ends.join(F.broadcast(ex), ends.field == F.col("_f"), "left")
        q = [F.col(f"_q{i}") for i in range(3)]
    return ends.select(F.col("field").alias("_c"), q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"), "_lo", "_hi")


def iqr_outliers(df: DataFrame, cols: list[str], positive_only: bool = True) -> DataFrame:
    """A10: count / share / range of values outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR]."""
    lf = long_form(df, cols, positive_only).where(F.col("value").isNotNull())
    q = quartile_frame(lf)
    j = lf.join(F.broadcast(q), lf.field == q._c)  # one row per column
    lower = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    upper = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    out = (F.col("value") < lower) | (F.col("value") > upper)
    return j.groupBy("field").agg(
        r6(F.first("q1")).alias("q1"), r6(F.first("q3")).alias("q3"),
        r6(F.first(lower)).alias("lower"), r6(F.first(upper)).alias("upper"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(out).alias("n_outliers"),
        r6(F.count_if(out) * 100.0 / F.count(F.lit(1))).alias("outlier_pct"),
        r6(F.min(F.when(out, F.col("value")))).alias("min_outlier"),
        r6(F.max(F.when(out, F.col("value")))).alias("max_outlier"),
    )


def box_plot(df: DataFrame, cols: list[str], positive_only: bool = True) -> DataFrame:
    """Five numbers; whiskers are the extreme values inside 1.5 IQR."""
    lf = long_form(df, cols, positive_only).where(F.col("value").isNotNull())
    q = quartile_frame(lf)
    j = lf.join(F.broadcast(q), lf.field == q._c)  # one row per column
    lower = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    upper = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= lower) & (F.col("value") <= upper)
    return j.groupBy("field").agg(
        r6(F.min(F.when(inside, F.col("value")))).alias("whisker_lo"),
        r6(F.first("q1")).alias("q1"), r6(F.first("q2")).alias("median"), r6(F.first("q3")).alias("q3"),
        r6(F.max(F.when(inside, F.col("value")))).alias("whisker_hi"),
    )


def histogram(df: DataFrame, cols: list[str], bins: int = 30, positive_only: bool = True,
              log10: bool = False) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum falls in the last bin."""
    lf = long_form(df, cols, positive_only).where(F.col("value").isNotNull())
    if log10:
        lf = lf.where(F.col("value") > 0).withColumn("value", F.log10("value"))
    mm = lf.groupBy(F.col("field").alias("_c")).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = lf.join(F.broadcast(mm), lf.field == mm._c)  # one row per column
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.lit(bins), (F.floor((F.col("value") - F.col("_lo")) * bins / width) + 1).cast("int")))
    g = j.groupBy("field", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"),
                                               F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return g.select("field", "bin", r6(F.col("_lo") + (F.col("bin") - 1) * w).alias("edge_lo"),
                    r6(F.col("_lo") + F.col("bin") * w).alias("edge_hi"), "n")


def list_explode(df: DataFrame, cols: list[str], key: str = "seq") -> DataFrame:
    """(field, element, seq, pos) for every element of every list column."""
    parts = []
    for c in cols:
        parts.append(df.select(F.lit(c).alias("field"), F.col(key).alias("_seq"),
                               F.posexplode(c).alias("pos", "element")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def list_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """A11 summary: rows with data, unique elements, occurrences, average per row."""
    rows = df.select(*[F.count_if(F.size(c) > 0).alias(c) for c in cols]) \
        .unpivot([], cols, "_c", "rows_with_data")
    ex = list_explode(df, cols)
    agg = ex.groupBy("field").agg(F.count_distinct("element").alias("unique_items"),
                                   F.count(F.lit(1)).alias("occurrences"))
    j = agg.join(rows, agg.field == rows._c)
    return j.select("field", "rows_with_data", "unique_items", "occurrences",
                    r6(F.col("occurrences") / F.col("rows_with_data")).alias("avg_per_row"))


def list_top(df: DataFrame, cols: list[str], n: int = 20) -> DataFrame:
    """Top-N elements per list column with share of rows with data.

    Order is count desc, then first appearance (source order, position).
    """
    rows = df.select(*[F.count_if(F.size(c) > 0).alias(c) for c in cols]) \
        .unpivot([], cols, "_c", "rows_with_data")
    ex = list_explode(df, cols)
    cnt = ex.groupBy("field", "element").agg(F.count(F.lit(1)).alias("n"),
                                              F.min(F.struct("_seq", "pos")).alias("_first"))
    w = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("_first"))
    top = cnt.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)
    j = top.join(rows, top.field == rows._c)
    return j.select("field", "rank", "element", "n", r6(F.col("n") * 100.0 / F.col("rows_with_data")).alias("share_pct"))


def categorical_profile(df: DataFrame, col: str) -> DataFrame:
    """Value counts with null as its own value, ranked count desc, value asc."""
    g = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return ranked(g, F.col("n").desc(), F.col("value").asc_nulls_last()).select("value", "n", F.col("rank").cast("bigint"))


def completeness(df: DataFrame, list_cols: list[str], scalar_cols: list[str]) -> DataFrame:
    """A14 (with P10): percent of rows with a non-empty list / non-null scalar."""
    exprs = [r6(F.avg(F.when(F.size(c) > 0, 1.0).otherwise(0.0)) * 100).alias(c) for c in list_cols]
    exprs += [r6(F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)) * 100).alias(c) for c in scalar_cols]
    cols = list_cols + scalar_cols
    return df.select(*exprs).unpivot([], cols, "field", "complete_pct")


def presence_counts(df: DataFrame, list_cols: list[str]) -> DataFrame:
    """Rows whose list is non-empty, per list column."""
    return df.select(*[F.count_if(F.size(c) > 0).alias(c) for c in list_cols]) \
        .unpivot([], list_cols, "field", "n_present")


def group_size_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """A5: distribution of group sizes (mean / median / min / max) per grouping key."""
    parts = []
    for k in keys:
        g = df.groupBy(k).agg(F.count(F.lit(1)).alias("_n"))
        middle = median(g.select(F.col("_n").cast("double").alias("value")))
        parts.append(g.agg(
            r6(F.avg("_n")).alias("mean"), r6(F.lit(middle).cast("double")).alias("median"),
            F.min("_n").alias("min"), F.max("_n").alias("max"), F.count(F.lit(1)).alias("groups"))
            .select(F.lit(k).alias("level"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def user_profile(df: DataFrame, user: str = "username", rating: str = "rating") -> DataFrame:
    """Per-user n, mean, sample std, min, max rating, for every user."""
    return df.groupBy(user).agg(
        F.count(rating).alias("n"), r6(F.avg(rating)).alias("mean"),
        r6(F.stddev_samp(rating)).alias("std"), F.min(rating).alias("min"), F.max(rating).alias("max"))
