"""Quantile sketches of runs against exact percentiles over the runs' rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import sketches
from marquee.operators.profile import exact_percentiles, long_form

PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(4)
    a = spark.createDataFrame([(float(x), float(y)) for x, y in zip(rng.lognormal(0, 2, 20_000), rng.integers(0, 7, 20_000))], "x double, y double")
    b = spark.createDataFrame([(float(x), None) for x in rng.normal(50, 3, 9_000)] + [(None, 3.0), (float("nan"), 4.0)], "x double, y double")
    return a.repartition(5), b


def test_merge_of_runs_keeps_the_rank_error(spark, runs, tmp_path):
    root = str(tmp_path / "data")
    for name, df in zip(("r1", "r2"), runs):
        sketches.write_run_sketches(df, ["x", "y"], root, name)
    with pytest.raises(FileNotFoundError):
        sketches.read_sketches(spark, root, ["r1", "r7"])
    rows = runs[0].unionByName(runs[1]).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y")])
    for wanted, df in ((None, rows), (["r1"], runs[0])):
        stored = sketches.read_sketches(spark, root, wanted)
        prof = sketches.profile(stored, PROBS)
        gaps = {(r.field, r.p): r.gap for r in sketches.rank_gaps(df, ["x", "y"], prof, PROBS).collect()}
        # rank_error holds for one quantile in 99 of 100 sketches; twice of it for all ten
        assert len(gaps) == 10 and max(gaps.values()) <= 2 * sketches.rank_error(), gaps
        got = {r.field: r for r in prof.collect()}
        want = df.agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]).first()
        for c in "xy":
            assert got[c].n == want[f"{c}_n"] and got[c].min == want[f"{c}_min"] and got[c].max == want[f"{c}_max"]
            assert np.isclose(got[c]["mean"], want[f"{c}_mean"]) and np.isclose(got[c]["std"], want[f"{c}_std"])
    # few distinct values: the sketch is as good as exact
    exact = {r.p: r.value for r in exact_percentiles(long_form(rows, ["y"], False), PROBS).collect()}
    assert got["y"]["p50"] == exact[0.5]


def test_fields_without_values(spark, runs):
    df = runs[1].limit(0).unionByName(spark.createDataFrame([(None, None)], "x double, y double"))
    r = sketches.profile(sketches.run_sketches(df, ["x"])).first()
    assert (r.n, r.n_null, r["mean"], r["p50"]) == (0, 1, None, None)
    assert sketches.profile(sketches.run_sketches(df.limit(0), ["x"])).count() == 0
