"""A5 / A8 / A9 / A17 across dataset versions: mergeable quantile sketches stored per run and field.

One scan of a run leaves one row a field: counts, sums and a KLL sketch. The profile of any set of runs is then a merge of
those rows, without a scan of the runs. Counts, extremes, means and deviations are exact; quantiles have a rank error of
about ``rank_error(k)``. ``profile.exact_percentiles`` stays the default where a scan is affordable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.profile import long_form
from marquee.sources import io

#: Size parameter of the sketches: a few tens of kB a field and run.
K = 1024


def rank_error(k: int = K) -> float:
    """Normalised rank error of a KLL sketch of size parameter ``k`` at 99 % confidence, one quantile."""
    return 2.296 / k ** 0.9021


def run_sketches(df: DataFrame, cols: list[str], k: int = K, by: str | None = None) -> DataFrame:
    """One row per field (and value of ``by``): (field, n, n_null, min, max, total, squares, sketch). NaN counts as null."""
    own = [by] if by else []
    lf = df.select(*own, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select(
        *own, "x.field", F.when(~F.isnan("x.value"), F.col("x.value")).alias("value"))
    return lf.groupBy(*own, "field").agg(
        F.count("value").alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def write_run_sketches(df: DataFrame, cols: list[str], root: str, run_id: str, name: str = "sketches", k: int = K) -> None:
    """Sketch a run's table once, beside its other tables."""
    io.write_table(run_sketches(df, cols, k), root, name, run_id, mode="overwrite")


def read_sketches(spark, root: str, run_ids: list[str] | None = None, name: str = "sketches") -> DataFrame:
    """The sketch rows of some published runs (all by default), with their run_id."""
    runs = [m["run_id"] for m in io.published_runs(spark, root) if name in m["tables"] and (run_ids is None or m["run_id"] in run_ids)]
    if not runs or run_ids is not None and set(run_ids) - set(runs):
        raise FileNotFoundError(f"no published {name!r} for all of {run_ids} under {root!r}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}").where(F.col("run_id").isin(runs))


def merged(sketches: DataFrame) -> DataFrame:
    """One row per field over all given rows: the same columns as ``run_sketches``."""
    some = sketches.where("n > 0")
    best = some.groupBy("field").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    sums = sketches.groupBy(F.col("field").alias("_f")).agg(F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.min("min").alias("min"),
                                                            F.max("max").alias("max"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    return sums.join(best, F.col("field") == F.col("_f"), "left").select(F.col("_f").alias("field"), "n", "n_null", "min", "max", "total", "squares", "sketch")


def profile(sketches: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Profile of the merged rows: (field, n, n_null, min, max, mean, std, p<percent> ...); null quantiles for a field without values."""
    m = merged(sketches)
    var = (F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1)
    return m.select("field", "n", "n_null", "min", "max", (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"),
                    F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"),
                    *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{int(round(p * 100)):02d}") for p in probs])


def rank_gaps(df: DataFrame, cols: list[str], prof: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """How far each quantile of a profile is off in rank (0: an exact quantile), by a scan: (field, p, gap)."""
    lf = long_form(df, cols, False).where(F.col("value").isNotNull())
    q = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"p{int(round(p * 100)):02d}").alias("q")) for p in probs]))
    wanted = prof.select("field", q.alias("x")).select(F.col("field").alias("_f"), "x.p", "x.q")
    c = lf.join(F.broadcast(wanted), F.col("field") == F.col("_f")).groupBy("field", "p").agg(  # a few rows a field
        F.avg((F.col("value") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("upto"))
    return c.select("field", "p", F.greatest(F.col("below") - F.col("p"), F.col("p") - F.col("upto"), F.lit(0.0)).alias("gap"))
