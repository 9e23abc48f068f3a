"""New users against numpy's least squares, and tables kept in buckets."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import foldin
from marquee.sources.bucketed import BucketedTable

CATALOGUE = [(i, f"Film {i}", 1990 + i % 3, i) for i in range(40)]


@pytest.fixture
def stores(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 3))
    items = spark.createDataFrame([(i, v[i].tolist(), float(i % 2)) for i in range(40)], "item long, factors array<double>, bias double")
    cat = spark.createDataFrame(CATALOGUE, "tmdb_id long, title string, year int, seq long")
    old = [(f"u{u}", f"Film {i}", 1990 + i % 3, 1 + (u + i) % 9, u * 100 + i, i) for u in range(30) for i in range(u % 5, 40, 7)]
    ratings = BucketedTable(spark, str(tmp_path / "ratings"), "username", 16).create(
        spark.createDataFrame(old, "username string, title string, year int, rating int, seq long, tmdb_id long"))
    own = ratings.read().select(F.col("username").alias("user"), F.col("tmdb_id").alias("item"), "rating")
    factors = BucketedTable(spark, str(tmp_path / "factors"), "user", 16).create(foldin.fold_in(own, items))
    return v, items, cat, ratings, factors


def solved(v, ratings, reg=0.1):
    x = np.stack([v[i] for i, _ in ratings])
    r = np.array([r - i % 2 for i, r in ratings], float)
    return np.linalg.solve(x.T @ x + reg * np.eye(3), x.T @ r)


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/bucket=*/*.parquet")}


def test_whole_flow(spark, stores):
    v, items, cat, ratings, factors = stores
    batch = spark.createDataFrame(
        [("u3", "FILM 5", 1992, 9, 1), ("u3", "film 5", 1992, 2, 2), ("u3", "Film 6", None, 7, 3), ("u3", "Film 6", 1900, 1, 4),
         ("new", "Film 1", 1991, 10, 5), ("nobody", "No such film", None, 3, 6)], "username string, title string, year int, rating int, seq long")
    before_r, before_f = files(ratings), files(factors)
    recs, report = foldin.ingest_users(ratings, factors, items, batch, cat, top=6)
    assert {tuple(r) for r in report.collect()} == {("u3", 4, 3), ("new", 1, 1), ("nobody", 1, 0)}
    own = {"u3": [(5, 2), (6, 7)], "new": [(1, 10)]}  # the later rating of a repeated pair; older rows replaced
    stored = {r.user: np.array(r.factors) for r in factors.read().collect()}
    got = {(r.user, r["rank"]): (r.item, r.score) for r in recs.collect()}
    assert len(got) == 12
    for user, rated in own.items():
        x = solved(v, rated)
        assert np.allclose(stored[user], x)
        score = v @ x + np.arange(40) % 2
        best = sorted((-score[i], i) for i in range(40) if i not in dict(rated))[:6]
        assert [got[user, n + 1][0] for n in range(6)] == [i for _, i in best]
    assert len(stored) == 31
    assert ratings.read().where("username = 'u3'").count() == 3 and ratings.read().where("username = 'u4'").count() > 0
    # only the buckets of u3 and new were rewritten
    touched = set(ratings.of_keys(spark.createDataFrame([("u3",), ("new",)], "username string")))
    for table, before in ((ratings, before_r), (factors, before_f)):
        now = files(table)
        same = {f for f in before if now.get(f) == before[f]}
        assert {int(f.split("bucket=")[1].split("/")[0]) for f in set(before) - same} <= touched
        assert len(same) >= len(before) - 2


def test_append_keeps_older_rows(spark, stores):
    v, items, cat, ratings, factors = stores
    batch = spark.createDataFrame([("u2", "Film 30", 1990, 8, 10 ** 6)], "username string, title string, year int, rating int, seq long")
    foldin.ingest_users(ratings, factors, items, batch, cat, mode="append")
    rated = [(i, 1 + (2 + i) % 9) for i in range(2, 40, 7)]
    rated = [(i, r) for i, r in rated if i != 30] + [(30, 8)]
    assert np.allclose(factors.read().where("user = 'u2'").first().factors, solved(v, rated))


def test_nothing_matched_changes_nothing(spark, stores):
    _, items, cat, ratings, factors = stores
    before = files(ratings), files(factors)
    batch = spark.createDataFrame([("u1", "Unknown", 2000, 5, 1)], "username string, title string, year int, rating int, seq long")
    with pytest.raises(foldin.NothingMatched):
        foldin.ingest_users(ratings, factors, items, batch, cat)
    with pytest.raises(foldin.NothingMatched):
        foldin.ingest_users(ratings, factors, items, batch.limit(0), cat)
    assert (files(ratings), files(factors)) == before
    assert ratings.change(ratings.read().limit(0)) == []


def test_reads_are_pruned_to_the_keys_buckets(spark, stores, capsys):
    ratings = stores[3]
    ratings.rows_of(spark.createDataFrame([("u7",)], "username string")).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "PartitionFilters: [(bucket" in plan


def test_short_vectors_are_summed_in_a_hash_aggregate(spark, monkeypatch):
    """plain sums by user, with the same vectors as the sums of whole buffers; a null element stays an error."""
    ratings = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 2.0), ("a", 2, 3.0), ("b", 3, 5.0), ("b", 9, 1.0), ("c", 1, None)], "user string, item long, rating double")
    items = spark.createDataFrame([(1, [1.0, 0.5], 0.5), (2, [0.2, -1.0], 0.0), (3, [0.0, 2.0], 1.0)], "item long, factors array<double>, bias double")
    out = foldin.fold_in(ratings, items)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    got = {r.user: (r.factors, r.n_ratings) for r in out.collect()}
    monkeypatch.setattr(foldin, "PLAIN_RANK", 0)
    want = {r.user: (r.factors, r.n_ratings) for r in foldin.fold_in(ratings, items).collect()}
    assert set(got) == set(want) == {"a", "b"}
    for user, (factors, n) in want.items():
        assert got[user] == (pytest.approx(factors, abs=1e-12), n)
    monkeypatch.undo()
    with pytest.raises(Exception, match="null in a vector"):
        foldin.fold_in(ratings, spark.createDataFrame([(1, [1.0, None], 0.0)], items.schema)).collect()
