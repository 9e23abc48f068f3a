"""Packing of token sequences: shortest-pack-first over the length histogram.

Texts are encoded once; what is kept per piece is its length and checksum. Only the histogram of
piece lengths (at most ``size`` entries) reaches the driver, which packs lengths, longest first, each
into the pack that it leaves fullest-but-shortest: packs are counted by pattern, never listed one by one.
Patterns are then joined back to the pieces by their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import prepare, shuffle_partitions, spool
from marquee.llm.tokens import WordEncoder, string_column, worker_encoder

#: (slots, number of packs). A slot is (offset, length, pieces of that length side by side).
Pattern = tuple[tuple[tuple[int, int, int], ...], int]


def pack_histogram(counts: dict[int, int], size: int) -> list[Pattern]:
    """Shortest-pack-first histogram packing.

    Lengths are placed longest first. A length goes into the packs with the most room left (the
    shortest packs); where it does not fit even there, new packs are opened and filled with it. All
    packs of a pattern are treated at once, so the work follows the number of lengths and patterns,
    not of pieces.
    """
    open_: list[tuple[int, int, tuple, int]] = []  # heap of (-room, order, slots, packs)
    full: list[Pattern] = []
    order = 0

    def put(slots, room, packs):
        nonlocal order
        if packs and room:
            order += 1
            heapq.heappush(open_, (-room, order, slots, packs))
        elif packs:
            full.append((slots, packs))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if open_ and -open_[0][0] >= length:
                room, _, slots, packs = heapq.heappop(open_)
                use = min(packs, left)
                put(slots, -room, packs - use)
                put((*slots, (size + room, length, 1)), -room - length, use)
                left -= use
            else:
                side = size // length
                put(((0, length, side),), size - side * length, left // side)
                if rest := left % side:
                    put(((0, length, rest),), size - rest * length, 1)
                left = 0
    return full + [(slots, packs) for _, _, slots, packs in open_]


def slots_by_length(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset, side), sorted by length and rank."""
    rows, taken, sequence = [], {}, 0
    for slots, packs in patterns:
        for offset, length, side in slots:
            lo = taken.get(length, 0)
            taken[length] = lo + packs * side
            rows.append((length, lo, lo + packs * side, sequence, offset, side))
        sequence += packs
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, tokenizer_json: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids_crc32, row): each text's ids with ``end_id`` after them, cut into
    pieces of ``size`` and a rest. ``row`` tells rows apart: task and row number."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        enc = worker_encoder(WordEncoder, shared)
        for b in batches:
            out = [[], [], [], [], [], []]
            for key, row, t in zip(string_column(b, "id"), string_column(b, "row"), string_column(b, "text"), strict=True):
                ids = enc.ids(t) + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start:4 * (start + size)]
                    for col, v in zip(out, (key, n, start, len(part) // 4, zlib.crc32(part), row), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "row"]
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                      F.monotonically_increasing_id().alias("row"))
    return src.mapInArrow(cut, ", ".join(f"{n} long" for n in names))


def ranked(pieces: DataFrame, parts: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the pieces of the same length, in a fixed order.

    No length is gathered in one task: pieces are numbered within (length, salt) groups, and the
    groups' first ranks come from their counts (lengths x salts rows).
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(parts)).cast("int"))
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "row")
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = salted.withColumn("at", F.row_number().over(group) - 1)
    return numbered.join(first, ["length", "salt"]).withColumn("rank", F.col("at") + F.col("before")).drop("at", "before", "salt")


def pack(docs: DataFrame, tokenizer_json: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids with little padding.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Offsets are gapless from 0 within a sequence; every id of every document is in one piece.

    Null text counts as empty (one piece: the end id). Repeated rows and rows with equal or null ids are
    packed each on its own. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = spool(token_pieces(docs, tokenizer_json, size, end_id, id_col, text_col), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = slots_by_length(pack_histogram(counts, size))
    shared = spark.sparkContext.broadcast(slots)

    def place(batches):
        length, lo, _, sequence, offset, side = shared.value.T
        big = np.int64(1) << np.int64(48)  # ranks stay below
        keys = length * big + lo
        for b in batches:
            own = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            i = np.searchsorted(keys, own * big + rank, side="right") - 1
            at = rank - lo[i]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(sequence[i] + at // side[i]),
                 pa.array(offset[i] + at % side[i] * own)], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    numbered = ranked(pieces, 4 * shuffle_partitions(spark)).select(*kept, "rank")
    return numbered.mapInArrow(place, ", ".join(f"{c} long" for c in [*kept, "sequence_id", "offset"]))
