"""Exact deduplication by Grace hashing.

Contents are dealt to buckets by a hash; a shuffle is the spill of the first level. A bucket's task puts its contents
into one open-addressing table that compares them completely. Contents for which a full table has no room are spilled
to a table in the shared folder and dealt again by another hash of the next level, until every bucket fits.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import prepare, shuffle_partitions, spool
from marquee.llm.tokens import string_column

#: Bytes of distinct contents that one bucket's table may hold; what is beyond is spilled to the next level.
BUCKET_BYTES = 64 << 20
#: A task gathers copies among so many rows and bytes before it sends their content on.
LOCAL_ROWS, LOCAL_BYTES = 8192, 8 << 20
#: Groups with more than one in so many rows are joined by a broadcast, which therefore has fewer rows than this.
LARGE_SHARE = 1000
#: The white space that does not count.
WHITE = b" \t\n\x0b\x0c\r"

MEMBERS, GROUP, SPILLED = 0, 1, 2


class ContentTable:
    """Open addressing with linear probes: content -> its number, in order of insertion. Equal hashes are no match:
    the whole contents are compared."""

    def __init__(self, room: int):
        self.room, self.used = room, 0
        self.hashes = array("q")
        self.contents: list[bytes] = []
        self.slots = array("q", [-1]) * 256
        self.full = False

    def find(self, h: int, content: bytes) -> int:
        """Its number; if it is new, it is inserted. -1: it is new, and the table has no room."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        # Once something had no room, nothing new may enter: all copies of one content must go the same way.
        self.full = self.full or bool(self.contents) and self.used + len(content) > self.room
        if self.full:
            return -1
        k = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.used += len(content)
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return k

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = (h ^ (h >> 32)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _better(a: tuple, b: tuple | None) -> bool:
    """Whether row a (points, id, chunk, place) stays rather than b: more code points, then the smaller id, null last."""
    if b is None or a[0] != b[0]:
        return b is None or a[0] > b[0]
    if (a[1] is None) != (b[1] is None):
        return b[1] is None
    return (a[1], a[2:]) < (b[1], b[2:]) if a[1] is not None else a[2:] < b[2:]


def _local_copies(docs: DataFrame, kind: str, local_rows: int, local_bytes: int) -> DataFrame:
    """(hash, chunk, content, ids, points): one row per distinct content among some thousand rows of a task. chunk is
    unique, ids and points are those of its rows."""
    def gather(batches):
        import xxhash
        from pyspark import TaskContext
        base, chunks = TaskContext.get().partitionId() << 40, 0
        table, ids, points, rows = ContentTable(1 << 62), [], [], 0

        def flush():
            nonlocal table, ids, points, rows, chunks
            n = len(table.contents)
            out = pa.RecordBatch.from_arrays(
                [pa.array(table.hashes, pa.int64()), pa.array(range(base + chunks, base + chunks + n), pa.int64()), pa.array(table.contents, pa.binary()),
                 pa.array(ids, pa.list_(id_type)), pa.array(points, pa.list_(pa.int64()))], names=["hash", "chunk", "content", "ids", "points"])
            table, ids, points, rows, chunks = ContentTable(1 << 62), [], [], 0, chunks + n
            return out

        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            for key, n, raw in zip(*(string_column(b, c) for c in ("id", "n", "text")), strict=True):
                content = raw.translate(None, WHITE)
                k = table.find(xxhash.xxh3_64_intdigest(content) - (1 << 63), content)
                if k == len(ids):
                    ids.append([])
                    points.append([])
                ids[k].append(key)
                points[k].append(n)
                rows += 1
                if rows >= local_rows or table.used >= local_bytes:
                    yield flush()
        if rows:
            yield flush()

    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select("id", F.length(text).cast("long").alias("n"), text.cast("binary").alias("text"))
    return src.mapInArrow(gather, f"hash long, chunk long, content binary, ids array<{kind}>, points array<long>")


def _resolved(contents: DataFrame, kind: str, level: int, buckets: int, room: int) -> DataFrame:
    """One level: each bucket's rows as MEMBERS of a group or SPILLED, then one GROUP row for each of its groups."""
    schema = ("kind int, hash long, variant int, chunk long, content binary, "
              f"ids array<{kind}>, points array<long>, keep_id {kind}, keep_chunk long, keep_place int, size long, sha string")

    def resolve(batches):
        table, best, sizes = ContentTable(room), [], array("q")
        variant: list[int] = []
        seen: dict[int, int] = {}
        types = None
        for b in batches:
            types = types or {f.name: f.type for f in b.schema}
            found, numbers = [], []
            for h, chunk, content, ids, points in zip(*(string_column(b, c) for c in ("hash", "chunk", "content", "ids", "points")), strict=True):
                k = table.find(h, content)
                if k == len(best):
                    best.append(None)
                    sizes.append(0)
                    variant.append((level << 20) + seen.get(h, 0))
                    seen[h] = seen.get(h, 0) + 1
                found.append(MEMBERS if k >= 0 else SPILLED)
                numbers.append(variant[k] if k >= 0 else None)
                if k < 0:
                    continue
                sizes[k] += len(ids)
                for place, (key, n) in enumerate(zip(ids, points, strict=True)):
                    if _better(row := (n, key, chunk, place), best[k]):
                        best[k] = row
            n = len(found)
            content = b.column(b.schema.get_field_index("content"))
            spilled = pa.array([c if f == SPILLED else None for c, f in zip(content.to_pylist(), found, strict=True)], pa.binary()) if table.full else pa.nulls(n, pa.binary())
            column = lambda c: b.column(b.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), column("hash"), pa.array(numbers, pa.int32()), column("chunk"), spilled, column("ids"), column("points"),
                 pa.nulls(n, types["ids"].value_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=names)
        for at in range(0, len(best), 4096):
            part = slice(at, at + 4096)
            rows, n = best[part], len(best[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array([GROUP] * n, pa.int32()), pa.array(table.hashes[part], pa.int64()), pa.array(variant[part], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                 pa.nulls(n, types["ids"]), pa.nulls(n, types["points"]), pa.array([r[1] for r in rows], types["ids"].value_type), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.int32()), pa.array(sizes[part], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in table.contents[part]], pa.string())], names=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return contents.repartition(buckets, F.xxhash64("hash", F.lit(level))).mapInArrow(resolve, schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES,
                     local_rows: int = LOCAL_ROWS, local_bytes: int = LOCAL_BYTES, least_buckets: int | None = None) -> DataFrame:
    """Documents whose texts are equal without ASCII white space: (id, keep_id, group_size, kept, text_sha256), one
    row per input row. The row with the most code points in its own text stays, then the one with the smallest id.

    A task first gathers copies among its own rows, so that a content with any number of copies is sent once for some
    thousand rows. A bucket holds at most ``bucket_bytes`` of distinct contents (one content, if that alone is
    larger). Rows go back to their groups by (hash, variant); groups with over a thousandth of all rows by a
    broadcast of less than ``LARGE_SHARE`` rows, all others by a join of narrow rows.

    Null text counts as empty, and all texts of white space alone are one group. Of repeated rows (same id, same
    length) exactly one stays. Null ids come after all others. An empty table gives an empty result; other columns
    are not read; texts of any length are compared whole. ids may have any type that can be ordered.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(src.dtypes)["id"]
    total = src.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    contents, levels, level = _local_copies(src, kind, local_rows, local_bytes), [], 0
    held = total.b or 0
    while True:
        # half of the room on average: a bucket seldom spills
        buckets = max(least_buckets or shuffle_partitions(spark), 2 * held // bucket_bytes + 1)
        done = spool(_resolved(contents, kind, level, buckets, bucket_bytes), f"grace-{level}")
        levels.append(done)
        spilled = done.where(F.col("kind") == SPILLED)
        held = spilled.agg(F.sum(F.octet_length("content")).alias("b"), F.count(F.lit(1)).alias("n")).first()
        if not held.n:
            break
        held = held.b or 0
        contents, level = spilled.select("hash", "chunk", "content", "ids", "points"), level + 1
    every = levels[0]
    for d in levels[1:]:
        every = every.unionByName(d)
    members = every.where(F.col("kind") == MEMBERS).select("hash", "variant", "chunk", "ids", "points")
    groups = every.where(F.col("kind") == GROUP).select("hash", "variant", "keep_id", "keep_chunk", "keep_place", "size", "sha")
    large = F.broadcast(groups.where(F.col("size") * LARGE_SHARE > total.n))
    by = ["hash", "variant"]
    joined = members.join(large, by).unionByName(
        members.join(F.broadcast(large.select(*by)), by, "left_anti").join(groups.where(F.col("size") * LARGE_SHARE <= total.n), by))
    rows = joined.select("*", F.posexplode("ids").alias("place", "id"))
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"),
                       ((F.col("chunk") == F.col("keep_chunk")) & (F.col("place") == F.col("keep_place"))).alias("kept"),
                       F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
r AS (SELECT doc_id, content, count(*) OVER (PARTITION BY content) AS group_size,
             row_number() OVER (PARTITION BY content ORDER BY points DESC, doc_id ASC NULLS LAST) AS place,
             first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id ASC NULLS LAST) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM r
"""
