"""Runs become visible as a whole, or not at all."""

import glob

import pytest

from marquee.plans import runs
from marquee.sources import io


def inputs(spark, n):
    ratings = spark.createDataFrame([(f"u{u}", f"Film {i}", 1990 + i, 1 + (u + i) % 9, f"film-{i}", u * 50 + i) for u in range(n) for i in range(12)], io.REVIEWS_RAW)
    meta = spark.createDataFrame([(i, f"Film {i}", 1990 + i, 90 + i, ["Drama", "War"], ["d"], ["c1", "c2"], f"{1990 + i}-01-01", 10, 20, 1.5, "en", i) for i in range(15)],
                                 "tmdb_id long, title string, year int, runtime int, genres array<string>, directors array<string>, cast array<string>, release_date string, "
                                 "budget long, revenue long, popularity double, original_language string, seq long")
    return ratings, meta


def test_a_stopped_run_is_never_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "data")
    with pytest.raises(FileNotFoundError):
        io.read_run(spark, root)
    runs.run_dataset(spark, *inputs(spark, 20), root, "20250101_000000_000000", min_user_reviews=1, min_item_reviews=1)
    first = {k: v.count() for k, v in io.read_run(spark, root).items()}
    assert first["raw_ratings"] == 240 and len(first) == 6
    kept = runs.prepare_features
    monkeypatch.setattr(runs, "prepare_features", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        runs.run_dataset(spark, *inputs(spark, 30), root, "20250102_000000_000000", min_user_reviews=1, min_item_reviews=1)
    # the newer folders are there, but no reader takes them
    assert glob.glob(f"{root}/final_ratings/run_id=20250102*")
    assert io.latest_run_id(spark, root, "final_ratings") == "20250101_000000_000000"
    assert {k: v.count() for k, v in io.read_run(spark, root).items()} == first
    assert io.read_latest(spark, root, "raw_ratings").count() == 240
    monkeypatch.setattr(runs, "prepare_features", kept)
    runs.run_dataset(spark, *inputs(spark, 30), root, "20250102_000000_000000", min_user_reviews=1, min_item_reviews=1)
    now = io.read_run(spark, root)
    assert now["raw_ratings"].count() == 360 and now["final_ratings"].select("username").distinct().count() == 30
    assert {k: v.count() for k, v in io.read_run(spark, root, "20250101_000000_000000").items()} == first


def test_manifests(spark, tmp_path):
    root = str(tmp_path / "data")
    df = spark.createDataFrame([("a", 1)], "username string, n int")
    io.write_table(df, root, "t", "r1", visible=False)
    assert io.latest_run_id(spark, root, "t") is None
    with pytest.raises(FileNotFoundError):
        io.publish(spark, root, "r1", {"t": 1, "missing": 1})
    io.publish(spark, root, "r1", {"t": 1})
    with pytest.raises(FileExistsError):
        io.publish(spark, root, "r1", {"t": 1})
    assert io.published_runs(spark, root) == [{"run_id": "r1", "tables": {"t": 1}}]
    # a half-written manifest is no manifest
    (tmp_path / "data" / "_published" / ".r9.x.json").write_text("{")
    assert len(io.published_runs(spark, root)) == 1
    io.write_table(df.union(df), root, "t", "r2")
    io.write_table(df.union(df).union(df), root, "t", "r2", mode="overwrite")
    assert io.read_latest(spark, root, "t").count() == 3 and io.read_latest(spark, root, "t", "r1").count() == 1
