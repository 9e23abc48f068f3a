"""Shared helpers of the training-data operators: tables, written intermediates, worker state."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import ensure_checkpoint_dir

#: Rows of an Arrow batch: bounds what a Python worker holds of long texts at once.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Settings that every operator with Python stages relies on: small Arrow batches, and a
    checkpoint folder (the cluster's, see ``ensure_checkpoint_dir``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ensure_checkpoint_dir(spark)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: cuts the
    lineage, and a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of spooled tables whose last reader has been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._spooled)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held(name: str, key, make):
    """In a worker: what ``make()`` gave for this name and key. A worker holds one such thing (a model, a cache) at a
    time, and drops it when another is asked for, so that its memory is bounded by the largest."""
    state = sys.modules.setdefault("_marquee_worker", types.ModuleType("_marquee_worker")).__dict__
    if state.get("held") != (name, key):
        state["held"] = state["value"] = None
        state["value"] = make()
        state["held"] = (name, key)
    return state["value"]


def share(spark: SparkSession, value):
    """Broadcast an object of this package's classes, pickled by value: workers need not import them."""
    from pyspark import cloudpickle
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(shared, name: str, make=lambda value: value):
    """In a worker: ``make`` of the object behind ``share``, kept by ``held``."""
    import pickle
    raw = shared.value
    return held(name, (hash(raw), len(raw)), lambda: make(pickle.loads(raw)))


def crc_remainder(col, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null ids: remainder 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(0))


def map_texts(docs: DataFrame, fn, result: str, id_col: str, text_col: str, carry: tuple) -> DataFrame:
    """Map ``fn`` (batch -> dict of new columns, typed as in ``result``) over a column "text" and either the id
    or the carried columns, whatever their names. The text returns from the workers only where it is carried."""
    import pyarrow as pa
    held = list(carry) or [id_col]
    names = ["text" if c == text_col else f"c{i}" for i, c in enumerate(held)]
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(held, names, strict=True)],
                      *([] if "text" in names else [F.col(f"`{text_col}`").alias("text")]))
    kinds = dict(src.dtypes)

    def mapped(batches):
        for b in batches:
            own = [b.column(b.schema.get_field_index(n)) for n in names]
            new = fn(b)
            yield pa.RecordBatch.from_arrays([*own, *new.values()], names=[*names, *new])

    out = src.mapInArrow(mapped, ", ".join([*(f"{n} {kinds[n]}" for n in names), result]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, held, strict=True)], *out.columns[len(names):])


def broadcast_if_small(df: DataFrame, max_rows: int, rows: int | None = None) -> DataFrame:
    """Broadcast hint behind a count: beyond ``max_rows`` the join stays a shuffled one."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= max_rows else df
