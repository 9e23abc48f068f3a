"""Feature engineering against numpy / hand computation."""

import math

import numpy as np

from marquee.operators import features as FE

CAT = "tmdb_id long, year int, runtime int, budget long, popularity double, original_language string, genres array<string>, seq long"


def _cat(spark):
    rows = [(1, 1949, 90, 0, 0.5, "en", ["Drama", "Horror"], 1), (2, 1950, 100, 10, 1.0, "fr", ["Drama"], 2),
            (3, 2019, 0, 100, 5.0, None, [], 3), (4, 2024, 120, 1000, 9.0, "en", ["Horror", "Drama", "Drama"], 4),
            (5, None, None, None, None, "de", None, 5)]
    return spark.createDataFrame(rows, CAT)


def test_decade_and_popularity(spark):
    c = _cat(spark)
    d = {r.tmdb_id: r.feature for r in FE.decade_features(c).collect()}
    assert d == {1: "decade_Pre-1950", 2: "decade_1950s", 3: "decade_2010s", 4: "decade_2020s"}
    p = {r.tmdb_id: r.feature for r in FE.popularity_features(c).collect()}
    assert p == {1: "popularity_Low", 2: "popularity_Low", 3: "popularity_Medium", 4: "popularity_High"}


def test_runtime_quartiles_match_numpy(spark):
    c = _cat(spark)
    q = np.percentile([90, 100, 120], [25, 50, 75])
    got = {r.tmdb_id: r.feature for r in FE.runtime_quartile_features(c).collect()}
    def lab(v):
        return "runtime_Q1" if v <= q[0] else "runtime_Q2" if v <= q[1] else "runtime_Q3" if v <= q[2] else "runtime_Q4"
    assert got == {1: lab(90), 2: lab(100), 4: lab(120)}


def test_money_buckets(spark):
    c = _cat(spark)
    got = {r.tmdb_id: r.feature for r in FE.money_bucket_features(c, "budget", "budget").collect()}
    assert got[1] == "budget_Zero" and got[5] == "budget_Zero"
    none_pos = spark.createDataFrame([(1, 0, 1), (2, None, 2)], "tmdb_id long, budget long, seq long")
    assert [r.feature for r in FE.money_bucket_features(none_pos, "budget", "budget").collect()] == ["budget_Zero"]


def test_top_elements_ties_by_first_seen(spark):
    c = _cat(spark)
    top = [r.value for r in FE.top_elements(c, "genres", 2).collect()]
    assert top == ["Drama", "Horror"]          # Drama 4 occurrences (Q28), Horror 2
    top1 = [r.value for r in FE.top_elements(c, "original_language", 3, is_list=False).collect()]
    assert top1 == ["en", "fr", "de"]           # fr and de tie at 1: first seen wins


def test_tfidf_matches_formula(spark):
    docs = [(1, "a b b c"), (2, "b c c c"), (3, "d"), (4, "")]
    df = spark.createDataFrame(docs, "id long, text string")
    got = {(r.doc, r.term): r.weight for r in FE.tfidf(df, "id", "text", max_features=3).collect()}
    vocab = ["b", "c", "a"]                     # totals b=3, c=4, a=1, d=1 -> top 3 with term asc on ties
    vocab = sorted(["a", "b", "c", "d"], key=lambda t: (-sum(d[1].split().count(t) for d in docs), t))[:3]
    n = len(docs)
    df_ = {t: sum(1 for d in docs if t in d[1].split()) for t in vocab}
    for did, text in docs:
        w = {t: text.split().count(t) * (math.log((1 + n) / (1 + df_[t])) + 1) for t in vocab if t in text.split()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert abs(got[(did, t)] - v / norm) < 1e-12
    assert len(got) == sum(len({t for t in d[1].split() if t in vocab}) for d in docs)


def test_mode_scaling(spark):
    feats = spark.createDataFrame([(1, "g", "g_a", 1.0), (9, "g", "g_b", 1.0)], "tmdb_id long, family string, feature string, weight double")
    items = spark.createDataFrame([(1,), (2,)], "tmdb_id long")
    h = {(r.tmdb_id, r.feature): r.weight for r in FE.mode_scaling(feats, items, "hybrid").collect()}
    assert h == {(1, "g_a"): 0.5, (1, "id:1"): 2.0, (2, "id:2"): 2.0}
    cf = {(r.tmdb_id, r.feature): r.weight for r in FE.mode_scaling(feats, items, "cf_only").collect()}
    assert cf == {(1, "id:1"): 1.0, (2, "id:2"): 1.0}
    cb = {(r.tmdb_id, r.feature): r.weight for r in FE.mode_scaling(feats, items, "cb_only").collect()}
    assert cb == {(1, "g_a"): 0.5}


def test_main_other_split_keeps_order(spark):
    c = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["y", "x"]), (3, [])], "tmdb_id long, cast array<string>")
    got = {r.tmdb_id: (r.cast_main, r.cast_other) for r in FE.main_other_split(c, "cast", 2).collect()}
    assert got == {1: (["x", "y"], ["z"]), 2: (["y", "x"], []), 3: ([], [])}


def test_multihot_other_bucket(spark):
    c = spark.createDataFrame([(1, ["a", "b"], 1), (2, ["a"], 2), (3, ["c"], 3)], "tmdb_id long, genres array<string>, seq long")
    plain = {(r.tmdb_id, r.feature) for r in FE.multihot_features(c, "genres", 1, "genre").collect()}
    assert plain == {(1, "genre_a"), (2, "genre_a")}
    other = {(r.tmdb_id, r.feature) for r in FE.multihot_features(c, "genres", 1, "genre", other_bucket=True).collect()}
    assert other == {(1, "genre_a"), (1, "genre_Other"), (2, "genre_a"), (3, "genre_Other")}


def test_top_n_is_validated():
    import pytest
    from marquee.operators.catalog import check_range
    assert check_range("top_n", 25, 1, 100) == 25
    for bad in (0, 101, "5", 2.5):
        with pytest.raises(ValueError):
            check_range("top_n", bad, 1, 100)


def test_distributed_exact_percentiles_match_numpy(spark):
    from marquee.operators.profile import PCTS, percentiles
    rng = np.random.default_rng(7)
    vals = {"a": rng.integers(1, 50, 301).astype(float), "b": rng.normal(size=97), "c": np.array([5.0])}
    rows = [(i, float(vals["a"][i]) if i < 301 else None, float(vals["b"][i]) if i < 97 else None,
             5.0 if i == 0 else None) for i in range(301)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.field: r for r in percentiles(df, ["a", "b", "c"], positive_only=False, distributed=True).collect()}
    for f, v in vals.items():
        want = np.percentile(v, [p * 100 for p in PCTS])
        for p, w in zip(PCTS, want):
            assert abs(got[f][f"p{int(round(p * 100)):02d}"] - round(w, 6)) < 1e-6, (f, p)
