"""Steps that several queries share: what is read once, cut early and dealt over tasks."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import features as FE
from marquee.operators import topk
from marquee.plans import q_features, q_model, q_runs
from marquee.session import ensure_checkpoint_dir
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_later_visit_gives_nothing_below_its_floor(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 3))
    index = topk.ItemIndex(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item long, factors array<double>"))
    u = [1.0, 2.0, -1.0]
    scores = sorted(v @ np.array(u))
    visits = spark.createDataFrame([(0, 7, [*u, 1.0], float(scores[-4])), (0, 8, [*u, 1.0], None)], "block int, user long, u array<double>, floor double")
    rows = index._scored(visits.withColumn("floor", F.col("floor") - 1e-9), None, 10).groupBy("user").count().collect()
    assert {r["user"]: r["count"] for r in rows} == {7: 4, 8: 10}


def test_floor_keeps_ties():
    u, v = np.ones((2, 2)), np.array([[0.5, 0.0], [0.25, 0.0], [0.5, 0.0], [0.1, 0.0]])
    r, c, _ = topk.top_cells(u, v, (np.array([1]), np.array([0])), 3, np.array([0.5, -np.inf]))
    assert list(zip(r.tolist(), c.tolist())) == [(0, 0), (0, 2), (1, 2), (1, 1), (1, 3)]


def test_both_sides_of_the_split_come_from_one_written_table(spark):
    train, test = q_model.train_test(spark, SF001)
    files = {*train.inputFiles(), *test.inputFiles()}
    assert files and all(ensure_checkpoint_dir(spark) in f for f in files)
    assert train.count() + test.count() == q_model.inter(spark, SF001).count()


def test_user_means_are_plain_sums(spark):
    rows, schema = [("a", 1.0, [1.0, 8.0]), ("a", 3.0, [2.0, 4.0]), ("b", 2.0, [0.5, 0.0])], "user string, rating double, factors array<double>"
    df = q_model.weighted_means(spark.createDataFrame(rows, schema), 2)
    assert "ObjectHashAggregate" not in _plan(df)
    assert {r.user: r.factors for r in df.collect()} == {"a": [1.75, 5.0], "b": [0.5, 0.0]}
    with pytest.raises(Exception, match="null in a vector"):  # never a mean over the others
        q_model.weighted_means(spark.createDataFrame([*rows, ("b", 1.0, [None, 1.0])], schema), 2).collect()


def test_tfidf_counts_chosen_terms_only(spark):
    docs = spark.createDataFrame([(1, "b a a c"), (2, "b c d"), (2, "a d"), (3, None), (None, "c c")], "id long, t string")
    out = FE.tfidf(docs, "id", "t", 2)
    assert "LeftSemi" in _plan(out)
    got = {(r.doc, r.term): r.weight for r in out.collect()}  # a 3 times, c 4 times
    ia, ic = np.log(6 / 3) + 1, np.log(6 / 4) + 1
    one, two = np.hypot(2 * ia, ic), np.hypot(ia, ic)
    want = {(1, "a"): 2 * ia / one, (1, "c"): ic / one, (2, "a"): ia / two, (2, "c"): ic / two}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_final_features_read_the_used_catalogue_once(spark):
    files = q_features.q_final_item_features(spark, SF001).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "part.parquet" in f]


def test_late_files_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(q_runs, "STREAM_FILE_ROWS", 100)
    before = set(glob.glob(f"{ensure_checkpoint_dir(spark)}/stream/*"))
    want = {tuple(r) for r in q_runs.q_stream_replace(spark, SF001).collect()}
    (base,) = set(glob.glob(f"{ensure_checkpoint_dir(spark)}/stream/*")) - before
    files = [spark.read.parquet(f).count() for f in glob.glob(f"{base}/in/*.parquet")]
    assert len(files) > 8 and max(files) < 400
    assert [q_runs.files_per_batch(n) for n in (1, 5, 6, 7, 90)] == [2, 2, 2, 3, 30]
    monkeypatch.setattr(q_runs, "STREAM_FILE_ROWS", 50_000)
    assert {tuple(r) for r in q_runs.q_stream_replace(spark, SF001).collect()} == want


def test_auc_items_travel_many_to_a_row(spark, monkeypatch):
    from marquee.operators import score
    v = np.arange(3000.0).reshape(1000, 3)
    items = spark.createDataFrame([(i, x.tolist(), float(i)) for i, x in enumerate(v)], "item long, factors array<double>, bias double").repartition(2)
    rows = score._packed(items).collect()
    assert len(rows) < 20 and all(r.n <= score.PACKED // 4 for r in rows)
    got = np.concatenate([np.array(r.v).reshape(r.n, -1) for r in rows])
    assert sorted(map(tuple, got)) == sorted((*x, float(i)) for i, x in enumerate(v))
    monkeypatch.setattr(score, "PACKED", 8)  # several rows to a chunk, several chunks, one user to a tile
    monkeypatch.setattr(score, "ITEM_ROWS", 300)
    monkeypatch.setattr(score, "TILE", 300)
    users = spark.createDataFrame([(u, [1.0, -1.0, 0.5 * u]) for u in range(5)], "user long, factors array<double>")
    pos = spark.createDataFrame([(u, i) for u in range(5) for i in (0, 250, 999)], "user long, item long")
    assert {r.user: r.auc for r in score.blocked_auc(users, items, pos).collect()} == {u: (0 + 249 + 997) / (3 * 997) for u in range(5)}


def test_hybrid_keeps_one_epoch_on_disk(spark):
    from marquee.operators.hybrid import HybridModel
    rows = [(u, i, 5.0) for u in range(30) for i in range(u % 5, 40, 3)]
    train = spark.createDataFrame(rows, "user long, item long, rating double")
    feats = spark.createDataFrame([(i, "id", f"id:{i}", 1.0) for i in range(40)], "tmdb_id long, family string, feature string, weight double")
    base, left = ensure_checkpoint_dir(spark), []
    for epochs in (1, 3):
        before = {f for f in glob.glob(f"{base}/**", recursive=True) if "/tables/" in f and f.endswith(".parquet")}
        m = HybridModel(k=4, epochs=epochs, user_blocks=2).fit(train, feats)
        after = {f for f in glob.glob(f"{base}/**", recursive=True) if "/tables/" in f and f.endswith(".parquet")}
        left.append({f.split("/tables/")[1].split("/")[0] for f in after - before})
        assert m.users.count() == 30 and m.embeddings.count() == 40
    assert len(left[0]) == len(left[1]) == 3  # features, users, embeddings
    vectors = m.item_vectors()
    assert m.item_vectors() is vectors and vectors.count() == 40
    assert "ObjectHashAggregate" not in _plan(vectors)
