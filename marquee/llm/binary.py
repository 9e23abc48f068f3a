"""Token-id files: whole texts to ids, ids to entropy-coded blocks in document order, and back.

A table of blocks (``write_ids``) has one row per block: first_start (ids before it), doc_ids, lengths
(ids of each document, end id included) and block (see ``ans``). Documents lie in ascending id order;
a block holds whole documents, so blocks decode independently and in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import ans
from marquee.llm.common import drop, prepare, shuffle_partitions, spool
from marquee.llm.tokens import PreTokenEncoder, string_column, worker_encoder

#: A block is closed at the first document end at or after this many ids.
BLOCK_IDS = 1 << 18

_BLOCKS = pa.schema([("first_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                     ("block", pa.binary())])


def _range_bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most parts - 1 cut points over the ids, from one pass over the id column."""
    probs = [i / parts for i in range(1, parts)]
    if not probs:
        return []
    cuts = docs.agg(F.percentile_approx(F.col(id_col), F.array(*map(F.lit, probs)), F.lit(10 * parts)).alias("c")).first().c
    return sorted(set(cuts or []))


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str, text_col: str, symbols: int) -> DataFrame:
    """(bucket, id, n, ids, counts): 16- or 32-bit ids of each text with ``end_id`` after it; buckets are ascending
    ranges of the id, null ids first. The last row of a task has no bucket, but how often each id occurred."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    bounds = _range_bounds(docs, id_col, shuffle_partitions(spark))
    end, width = int(end_id).to_bytes(4, "little"), _width(symbols)

    def rows(bucket, keys, n, ids, counts):
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(keys, pa.int64()), pa.array(n, pa.int64()),
                                           pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                                          names=["bucket", "id", "n", "ids", "counts"])

    def encode(batches):
        enc, total = worker_encoder(PreTokenEncoder, shared), np.zeros(symbols, np.int64)
        for b in batches:
            keys, out = string_column(b, "id"), []
            for t in string_column(b, "text"):
                out.append(np.frombuffer(enc.ids(t) + end, "<u4").astype(width))
            if out:
                total += np.bincount(np.concatenate(out), minlength=symbols)
            bucket = [0 if k is None else bisect_left(bounds, k) for k in keys]
            yield rows(bucket, keys, [len(ids) for ids in out], [ids.tobytes() for ids in out], [None] * len(out))
        yield rows([None], [None], [None], [None], [total.tobytes()])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(encode, "bucket int, id long, n long, ids binary, counts binary")


def _width(symbols: int) -> str:
    return "<u2" if symbols <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, symbols: int) -> np.ndarray:
    """How often each id occurs in all rows of ``encoded``, from the counts of its tasks; the ids are not read."""
    def add(batches):
        total = np.zeros(symbols, np.int64)
        for b in batches:
            for c in string_column(b, "counts"):
                total += np.frombuffer(c, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = np.zeros(symbols, np.int64)
    own = tokens.where("counts is not null").select("counts")
    for r in own.mapInArrow(add, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write_ids(docs: DataFrame, tokenizer_json: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
              symbols: int = 1 << 16) -> tuple[DataFrame, np.ndarray]:
    """Encode every whole text and write the ids as a table of blocks in the shared folder.

    Texts are encoded once into a written table; its id counts give the frequency table that all
    blocks share; then the ids (not the texts) are sorted by document id and coded.
    Returns (blocks, counts): ``ans.Table(counts)`` decodes the blocks.

    Null text counts as empty (its only id is ``end_id``). Null document ids come first. Rows with
    the same id stay side by side, ordered by their number of ids and then by the ids. An empty table gives no blocks.
    A lost executor costs its tasks only: every stage reads a written table or a shuffle.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokens = spool(encoded(docs, tokenizer_json, end_id, id_col, text_col, symbols), "tokens")
    counts = id_counts(tokens, symbols)
    sums = {r.bucket: r.n for r in tokens.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    base, at = {}, 0
    for k in sorted(sums):
        base[k] = at
        at += sums[k]
    shared, width = spark.sparkContext.broadcast((counts, base)), _width(symbols)

    def code(batches):
        counts, base = shared.value
        table = ans.Table(counts)
        bucket, first, at, keys, parts = None, 0, 0, [], []

        def block():
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_pydict({"first_start": [first], "doc_ids": [keys], "lengths": [[len(p) for p in parts]],
                                               "block": [ans.encode(ids, table)]}, schema=_BLOCKS)

        for b in batches:
            for k, key, raw in zip(string_column(b, "bucket"), string_column(b, "id"), string_column(b, "ids"), strict=True):
                ids = np.frombuffer(raw, width)
                if k != bucket:
                    if parts:
                        yield block()
                    bucket, first, at, keys, parts = k, base[k], base[k], [], []
                keys.append(key)
                parts.append(ids)
                at += len(ids)
                if at - first >= BLOCK_IDS:
                    yield block()
                    first, keys, parts = at, [], []
        if parts:
            yield block()

    ordered = tokens.where("bucket is not null").drop("counts").repartitionById(max(1, len(sums) and max(sums) + 1), F.col("bucket")).sortWithinPartitions("bucket", "id", "n", "ids")
    blocks = ordered.mapInArrow(code, "first_start long, doc_ids array<long>, lengths array<long>, block binary")
    written = spool(blocks, "token-blocks")
    drop(tokens)
    return written, counts


def read_ids(blocks: DataFrame, counts: np.ndarray) -> DataFrame:
    """Decode a table of blocks: (doc_id, start, ids) per document, ids as little-endian 32-bit."""
    return _decoded(blocks, counts, "ids binary", lambda raw: raw, pa.binary())


def ids_digest(blocks: DataFrame, counts: np.ndarray) -> DataFrame:
    """Decode a table of blocks: (doc_id, start, n_tokens, ids_crc32) per document."""
    return _decoded(blocks, counts, "ids_crc32 long", zlib.crc32, pa.int64())


def _decoded(blocks: DataFrame, counts, last: str, of, kind) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(counts)
    name = last.split()[0]

    def read(batches):
        table = ans.Table(shared.value)
        for b in batches:
            for first, keys, lengths, block in zip(*(string_column(b, c) for c in ("first_start", "doc_ids", "lengths", "block")), strict=True):
                raw = ans.decode(block, table).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(first + starts, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array([of(raw[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], kind)],
                    names=["doc_id", "start", "n_tokens", name])

    return blocks.mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")
