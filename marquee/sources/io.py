"""Readers, writers, dataset versions, stage gates, model persistence.

Tables are stored as Parquet partitioned by ``run_id`` (a dataset version). Readers see a run once its manifest is there: a small
file under ``root/_published`` that names the run's tables and their numbers of rows, put in place by one rename after
all of them are written. A run that stopped on its way is never read, and the tables of a run always belong together.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical schemas.
MEMBERS = T.StructType([T.StructField("username", T.StringType(), False),
                        T.StructField("display_name", T.StringType()),
                        T.StructField("num_reviews", T.IntegerType())])
REVIEWS_RAW = T.StructType([T.StructField("username", T.StringType(), False),
                            T.StructField("title", T.StringType()),
                            T.StructField("year", T.IntegerType()),
                            T.StructField("rating", T.IntegerType()),
                            T.StructField("film_slug", T.StringType()),
                            T.StructField("seq", T.LongType())])
RATINGS_MIN = T.StructType([T.StructField("username", T.StringType()),
                            T.StructField("tmdb_id", T.LongType()),
                            T.StructField("rating", T.DoubleType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: bool = False) -> DataFrame:
    """CSV with a declared schema (no inference), multi-line quoted fields.

    With ``corrupt=True`` a ``_corrupt_record`` column keeps rows that do not fit.
    """
    s = schema
    if corrupt:
        s = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(s).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))


def read_ratings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Only username, item id and rating are read (column pruning), nulls dropped."""
    if fmt == "csv":
        df = read_csv(spark, path, RATINGS_MIN)
    else:
        df = spark.read.parquet(path).select("username", "tmdb_id", "rating")
    return df.na.drop(subset=["username", "tmdb_id", "rating"])


def new_run_id(now: _dt.datetime | None = None) -> str:
    """Sorts by time; microseconds keep two runs of one second apart."""
    return (now or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y%m%d_%H%M%S_%f")


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _manifest(root: str, key: str) -> str:
    return f"{root.rstrip('/')}/_published/{key}.json"


def publish(spark: SparkSession, root: str, run_id: str, tables: dict[str, int], key: str | None = None) -> None:
    """Let readers see a run: check that all its tables are there, then put its manifest in place by one rename. A run that is
    published stays as it is: a second manifest for it raises."""
    for name in tables:
        fs, folder = _fs(spark, f"{root.rstrip('/')}/{name}/run_id={run_id}")
        if not fs.exists(folder):
            raise FileNotFoundError(f"run {run_id!r} has no table {name!r}")
    fs, final = _fs(spark, _manifest(root, key or run_id))
    _, hidden = _fs(spark, _manifest(root, f".{key or run_id}.{new_run_id()}"))
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(json.dumps({"run_id": run_id, "tables": tables}).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(hidden, final):
        fs.delete(hidden, False)
        raise FileExistsError(f"run {run_id!r} is published already")


def withdraw(spark: SparkSession, root: str, key: str) -> None:
    """Take a manifest away; the files stay."""
    fs, final = _fs(spark, _manifest(root, key))
    fs.delete(final, False)


def published_runs(spark: SparkSession, root: str) -> list[dict]:
    """The manifests under ``root``, newest run first: one listing and one small file each."""
    fs, folder = _fs(spark, f"{root.rstrip('/')}/_published")
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json") and not name.startswith("."):
            stream = fs.open(status.getPath())
            try:
                found.append(json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return sorted(found, key=lambda m: m["run_id"], reverse=True)


def read_run(spark: SparkSession, root: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """All tables of one published run (newest by default), from one manifest: their versions match."""
    for m in published_runs(spark, root):
        if run_id in (None, m["run_id"]):
            return {name: spark.read.parquet(f"{root.rstrip('/')}/{name}/run_id={m['run_id']}") for name in m["tables"]}
    raise FileNotFoundError(f"no published run {run_id or ''} under {root!r}")


def write_table(df: DataFrame, root: str, name: str, run_id: str, mode: str = "append", fmt: str = "parquet", visible: bool = True) -> str:
    """Write a table as one ``run_id`` partition of ``root/name`` and publish it; with ``visible=False`` it waits for
    the ``publish`` of its run. ``overwrite`` replaces that run's partition only (unseen meanwhile); earlier runs stay."""
    path = f"{root.rstrip('/')}/{name}"
    spark, key = df.sparkSession, f"{run_id}.{name}"
    if visible:
        withdraw(spark, root, key)
    w = df.withColumn("run_id", F.lit(run_id)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    if visible:
        fmt_reader = {"csv": spark.read.option("header", True).csv, "json": spark.read.json}.get(fmt, spark.read.parquet)
        fs, folder = _fs(spark, f"{path}/run_id={run_id}")
        rows = fmt_reader(folder.toString()).count() if fs.exists(folder) else 0
        if rows:
            publish(spark, root, run_id, {name: rows}, key)
    return path


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names, without ``prefix``, of the folders of ``path`` that start with it; none where there is no such path.

    One listing of one level through the file system of the path; any other failure is raised."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(n[len(prefix):] for n in names if n.startswith(prefix))


def latest_run_id(spark: SparkSession, root: str, name: str) -> str | None:
    """Newest dataset version = the largest ``run_id`` among the published runs with this table."""
    return next((m["run_id"] for m in published_runs(spark, root) if name in m["tables"]), None)


def read_latest(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """The table of one published run (newest by default); only that run's folder is read."""
    runs = [m["run_id"] for m in published_runs(spark, root) if name in m["tables"] and run_id in (None, m["run_id"])]
    if not runs:
        raise FileNotFoundError(f"no published run of {name!r} under {root!r}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/run_id={runs[0]}")


def newest_file(spark: SparkSession, path_glob: str, patterns: list[str] | None = None) -> DataFrame:
    """Newest file by modification time among files matching the glob,
    patterns ranked by priority first. Reads only file metadata columns."""
    df = spark.read.format("binaryFile").load(path_glob).select("path", "modificationTime")
    if patterns:
        prio = F.lit(len(patterns))
        for i, p in reversed(list(enumerate(patterns))):
            prio = F.when(F.col("path").rlike(p), F.lit(i)).otherwise(prio)
        df = df.withColumn("priority", prio).where(F.col("priority") < len(patterns))
        return df.orderBy("priority", F.col("modificationTime").desc(), "path").limit(1)
    return df.orderBy(F.col("modificationTime").desc(), "path").limit(1)


def file_versions(df: DataFrame) -> DataFrame:
    """S3: source file and its modification time of every row (Parquet ``_metadata``)."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_modification_time").alias("file_mtime"))


def write_usernames(members: DataFrame, path: str) -> None:
    """One username per line."""
    members.select("username").write.mode("overwrite").text(path)


def stage_gate(df: DataFrame, stage: str, allow_empty: bool = False) -> int:
    """Count records of a stage's output; raise when it produced nothing."""
    n = df.count()
    if n == 0 and not allow_empty:
        raise RuntimeError(f"stage {stage!r} produced no rows")
    return n


def run_summary(spark: SparkSession, run_id: str, counts: dict, params: dict | None = None,
                ratings: DataFrame | None = None) -> DataFrame:
    """One-row summary of a run: stage counts, parameters and rating moments."""
    row = {"run_id": run_id, "timestamp": new_run_id()}
    row.update({f"n_{k}": int(v) for k, v in counts.items()})
    row.update({f"param_{k}": str(v) for k, v in (params or {}).items()})
    out = spark.createDataFrame([row])
    if ratings is not None:
        m = ratings.agg(F.count(F.lit(1)).alias("ratings"), F.count_distinct("username").alias("users"),
                        F.count_distinct("tmdb_id").alias("items"), F.avg("rating").alias("rating_mean"),
                        F.stddev_samp("rating").alias("rating_std")).first().asDict()
        out = out.select("*", *[F.lit(v).alias(k) for k, v in m.items()])
    return out


def save_model(model, root: str, mode: str, run_id: str | None = None, params: dict | None = None) -> str:
    """Factor tables and one-row parameters under models/mode=<m>/run_id=<r>/."""
    rid = run_id or new_run_id()
    base = f"{root.rstrip('/')}/mode={mode}/run_id={rid}"
    model.users.write.mode("overwrite").parquet(f"{base}/users")
    model.embeddings.write.mode("overwrite").parquet(f"{base}/embeddings")
    model.features.write.mode("overwrite").parquet(f"{base}/features")
    spark = model.users.sparkSession
    p = {"k": model.k, "loss": model.loss, "lr": model.lr, "seed": model.seed, **(params or {})}
    spark.createDataFrame([{k: str(v) for k, v in p.items()}]).write.mode("overwrite").json(f"{base}/params")
    return base


def load_model(spark: SparkSession, root: str, mode: str, run_id: str | None = None, train_fn=None):
    """Load one run of a mode (newest by default); factors are keyed by id (Q27).

    When nothing is stored, ``train_fn()`` is called if given, else it raises.
    """
    from marquee.operators.hybrid import HybridModel
    ids = subfolders(spark, f"{root.rstrip('/')}/mode={mode}", "run_id=")
    if not ids:
        if train_fn is None:
            raise FileNotFoundError(f"no stored model for mode {mode!r}")
        return train_fn()
    rid = run_id or ids[-1]
    base = f"{root.rstrip('/')}/mode={mode}/run_id={rid}"
    p = spark.read.json(f"{base}/params").first().asDict()
    m = HybridModel(k=int(p["k"]), loss=p["loss"], learning_rate=float(p["lr"]), seed=int(p["seed"]))
    m.users = spark.read.parquet(f"{base}/users")
    m.embeddings = spark.read.parquet(f"{base}/embeddings")
    m.features = spark.read.parquet(f"{base}/features")
    return m
