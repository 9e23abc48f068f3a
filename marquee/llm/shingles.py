"""Jaccard join on word shingles with token-combination prefixes.

A shingle is a token (a 64-bit hash). Two sets x, y with Jaccard similarity >= t differ by at most
|x| - ceil(t |x|) tokens of x, called its slack. With any fixed order of all tokens, let a prefix of x be long
enough that deleting any ``slack`` tokens from it leaves either one token of a rare class or two tokens of one
group of the frequent class. Then similar sets share a rare token or a two-token combination of their prefixes.

1. Tokens below a hash limit (a fixed share of all tokens) are counted over all sets. In the order [rare ones
   below the limit][all others], most sets have a prefix of rare tokens alone: single tokens are indexed.
2. Sets that do not (mostly frequent tokens, or very few) get a join of their own over all their
   tokens, in the order [rare][frequent]: there the prefix is extended, and frequent tokens are indexed by pairs within groups
   of tokens, whose number follows the size of the set.

Sets that share an index entry meet at its smallest member, never pairwise; what meets is compared exactly
in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import broadcast_if_small, drop, prepare, shuffle_partitions, spool
from marquee.llm.components import connected, forest
from marquee.llm.tokens import string_column

#: A token in more sets than this is frequent.
RARE = 8
#: Sets that one task compares with each other at once: two chunks of this many.
CHUNK = 192
#: Rows up to which a list of document ids is broadcast; beyond, the join is a shuffled one.
BROADCAST_ROWS = 2_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def tokens_of(text: bytes | None, words: int) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending: A-Z lower-cased, words between ASCII white space; a text of
    fewer words is one shingle; without a word none."""
    import xxhash
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    if len(h) < words:
        acc = np.array([len(h)], np.uint64)
        for x in h:
            acc = _mixed(acc * _MIX[0] + x)
        return acc
    n = len(h) - words + 1
    acc = h[:n].copy()
    for i in range(1, words):
        acc = acc * _MIX[0] + h[i:i + n]
    return np.unique(_mixed(acc))


def _slack(n, percent: int):
    """|x| - ceil(t |x|) for a column or an int."""
    if isinstance(n, int):
        return n - (n * percent + 99) // 100
    return n - F.floor((n * percent + 99) / 100).cast("long")


def groups_for(n: int, percent: int) -> int:
    """Groups of frequent tokens for sets of size n: about four prefix tokens in each."""
    need = _slack(n, percent) + 1
    return 1 if need <= 8 else 1 << ((need // 4).bit_length() - 1)


def pair_entries(frequent: np.ndarray, need: int, n: int, percent: int) -> np.ndarray:
    """Index entries of a set for its frequent tokens (ascending), when its prefix must still outlast ``need``
    deletions: for each number of groups that a similar set may use, the shortest prefix in which
    sum(max(0, tokens of group - 1)) reaches ``need``, and all pairs within its groups."""
    least, most = groups_for(max(1, (n * percent + 99) // 100), percent), groups_for(n * 100 // percent, percent)
    out, g = [], least
    while g <= most:
        group = (_mixed(frequent + _MIX[0]) % np.uint64(g)).astype(np.int64)
        seen: dict[int, list[int]] = {}
        left = need
        for t, k in zip(frequent.tolist(), group.tolist(), strict=True):
            if left <= 0:
                break
            held = seen.setdefault(k, [])
            left -= bool(held)
            held.append(t)
        pairs = [(a, b) for held in seen.values() for i, a in enumerate(held) for b in held[i + 1:]]
        if pairs:
            p = np.array(pairs, np.uint64)
            out.append(_mixed(_mixed(p[:, 0] + np.uint64(g)) * _MIX[0] + p[:, 1]))
        g *= 2
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(docs: DataFrame, words: int, limit: np.uint64) -> DataFrame:
    """(id, n, sid, low): number of tokens, 128-bit digest of the set (null: empty), tokens below the limit."""
    def cut(batches):
        import xxhash
        for b in batches:
            n, sid, low = [], [], []
            for t in string_column(b, "text"):
                x = tokens_of(t, words)
                n.append(len(x))
                sid.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                low.append(x[:np.searchsorted(x, limit)].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.binary()),
                                              pa.array(low, pa.list_(pa.int64()))], names=["id", "n", "sid", "low"])

    return docs.mapInArrow(cut, "id long, n long, sid binary, low array<long>")


def _shared_counts(tokens: DataFrame) -> DataFrame:
    """(t, c): tokens that more than one set has."""
    return tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")


def _entries_low(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Step 1: index entries (entry, id), the ids of sets without a prefix of rare tokens, and the written table behind both."""
    need = _slack(F.col("n"), percent) + 1
    # token rows are as narrow as can be; a set's sizes come back with the few tokens that are shared
    tokens = sets.select("id", F.posexplode("low").alias("at", "t"))
    sizes = sets.select("id", "n", F.size("low").alias("held"))
    shared = tokens.join(_shared_counts(tokens), "t").join(sizes, "id")
    own = Window.partitionBy("id")
    # a similar set lacks at most need - 1 of the tokens below the limit: sets with more that nobody shares have no partner
    marked = spool(shared.withColumn("frequent", F.sum((F.col("c") > RARE).cast("long")).over(own))
                   .withColumn("common", F.count(F.lit(1)).over(own)).where(F.col("held") - F.col("common") < need), "shared")
    entries = marked.where((F.col("c") <= RARE) & (F.col("at") < need + F.col("frequent"))).select(F.col("t").alias("entry"), "id")
    few = sets.where(F.size("low") < need).select("id")
    mostly = marked.where(F.col("held") - F.col("frequent") < need).select("id").distinct()
    return entries, few.unionByName(mostly).distinct(), marked


def _entries_all(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Step 2: index entries (entry, id) of the given documents among each other, over all their tokens; and the written
    table behind them."""
    def cut(batches):
        for b in batches:
            sets = [tokens_of(t, words) for t in string_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()),
                                              pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["id", "n", "all"])

    sets = spool(docs.mapInArrow(cut, "id long, n long, all array<long>"), "whole-sets")
    tokens = sets.select("id", "n", F.explode("all").alias("t"))
    shared = tokens.join(_shared_counts(tokens), "t")
    # a set's own tokens are one row of its result: the group is bounded by the text
    grouped = shared.groupBy("id", "n").agg(F.collect_list(F.when(F.col("c") <= RARE, F.col("t"))).alias("rare"),
                                            F.collect_list(F.when(F.col("c") > RARE, F.col("t"))).alias("frequent"))
    # likewise, over all tokens
    grouped = grouped.where(F.col("n") - F.size("rare") - F.size("frequent") <= _slack(F.col("n"), percent))

    def index(batches):
        for b in batches:
            ids, entries = [], []
            for key, n, rare, frequent in zip(*(string_column(b, c) for c in ("id", "n", "rare", "frequent")), strict=True):
                f = np.sort(np.array(frequent, np.int64).view(np.uint64))
                need = _slack(n, percent) + 1 - (n - len(f))
                found = np.array(rare, np.int64)
                if need > 0:
                    found = np.concatenate([found, pair_entries(f, need, n, percent).view(np.int64)])
                entries.append(found)
                ids.append(np.full(len(found), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(entries)), pa.array(np.concatenate(ids))], names=["entry", "id"])

    return grouped.mapInArrow(index, "entry long, id long"), sets


def _meetings(entries: DataFrame) -> DataFrame:
    """(at, id): sets that share an entry meet at its smallest set; every set also at itself."""
    least = entries.groupBy("entry").agg(F.min("id").alias("at"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    met = entries.join(least, "entry").where("id <> at").select("at", "id").distinct()
    return met.unionByName(met.select("at", F.col("at").alias("id")).distinct())


def similar_pairs(sets: list[np.ndarray], percent: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) with 100 * |x & y| >= percent * |x | y|; with ``first`` (booleans) only pairs across it."""
    size = np.array([len(s) for s in sets], np.int64)
    value, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    kept = count[place] > 1
    column = np.cumsum(count > 1) - 1
    owner, place = owner[kept], column[place[kept]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = max(1, (1 << 22) // len(sets))
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        lo, hi = np.searchsorted(place, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], place[lo:hi] - at] = 1
        common += m @ m.T
    both = common.astype(np.int64)
    link = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
    link = np.triu(link, 1)
    if first is not None:
        link &= first[:, None] != first[None, :]
    return np.nonzero(link)


def _links(docs: DataFrame, met: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): links that span what is similar among the sets that meet, and the written table behind them. Meetings of more than CHUNK sets are cut into
    chunks, and each pair of chunks is one block."""
    size = met.groupBy("at").agg(F.count(F.lit(1)).alias("k"))
    chunks = F.ceil(F.col("k") / CHUNK).cast("int")
    placed = (met.join(size, "at").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .groupBy("id").agg(F.collect_list(F.struct("at", "own", "other")).alias("blocks")))
    placed = spool(placed, "meetings")
    texts = docs.join(broadcast_if_small(placed, BROADCAST_ROWS), "id")

    def cut(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for key, t, blocks in zip(*(string_column(b, c) for c in ("id", "text", "blocks")), strict=True):
                raw = tokens_of(t, words).tobytes()
                for m in blocks:
                    lo, hi = sorted((m["own"], m["other"]))
                    for col, v in zip(cols, (m["at"], lo * (1 << 31) + hi, m["own"] == lo, key, raw), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    names = ["at", "block", "first", "id", "tokens"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    rows = texts.mapInArrow(cut, "at long, block long, first boolean, id long, tokens binary")
    blocks = rows.repartition(shuffle_partitions(docs.sparkSession), "at", "block").sortWithinPartitions("at", "block")

    def compare(batches):
        def spanning(key, held):
            ids = np.array([h[0] for h in held], np.int64)
            across = None if key[1] >> 31 == key[1] & ((1 << 31) - 1) else np.array([h[1] for h in held])
            i, j = similar_pairs([np.frombuffer(h[2], np.uint64) for h in held], percent, across)
            root = forest(len(ids), i, j)
            moved = root != np.arange(len(ids))
            return ids[moved], ids[root[moved]]

        key, held = None, []
        for b in batches:
            out = []
            for at, block, first, i, raw in zip(*(string_column(b, c) for c in names), strict=True):
                if (at, block) != key:
                    if len(held) > 1:
                        out.append(spanning(key, held))
                    key, held = (at, block), []
                held.append((i, first, raw))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], names=["a", "b"])
        if len(held) > 1:
            a, b_ = spanning(key, held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_)], names=["a", "b"])

    return blocks.mapInArrow(compare, "a long, b long"), placed


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicate documents: (id, n_shingles, component_id), one row per input row.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``percent`` / 100, exactly; component_id is the smallest id reachable by links, the document's own included.

    Null and empty texts have no shingles and link with nothing. Documents with equal sets are one node, represented by their
    smallest id. Rows with the same id are one document; rows with a null id get a null component. An empty
    table gives an empty result; other columns are not read. Very long texts are one set like any other.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    share = min(1.0, 2 * (100 - percent) / 100)
    sets = spool(_sets(src, words, np.uint64(int(share * ((1 << 64) - 1)))), "sets")
    known = sets.where("sid is not null and id is not null")
    equal = spool(known.groupBy("sid").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "equal")
    # sets of one representative each
    copies = spool(known.select("id", "sid").join(broadcast_if_small(equal, BROADCAST_ROWS), "sid").where("id <> rep").select("id", "rep"), "copies")
    n_copies = copies.count()
    nodes = known.join(broadcast_if_small(copies.select("id"), BROADCAST_ROWS, n_copies), "id", "left_anti")
    low, short, marked = _entries_low(nodes, percent)
    short = spool(short, "short")
    own = src.join(broadcast_if_small(short, BROADCAST_ROWS), "id")
    rest, whole = _entries_all(own, words, percent)
    entries = low.withColumn("step", F.lit(1)).unionByName(rest.withColumn("step", F.lit(2)))
    entries = spool(entries.select(F.struct("step", "entry").alias("entry"), "id"), "entries")
    drop(marked, whole, short)
    met = spool(_meetings(entries), "met")
    drop(entries)
    links, placed = _links(src, met, words, percent)
    links = spool(links, "found")
    drop(placed, met)
    labels = connected(links.unionByName(copies.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    labels = spool(labels, "components")
    done = sets.select("id", "n").join(broadcast_if_small(labels, BROADCAST_ROWS), F.col("id") == F.col("node"), "left")
    done = spool(done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")), "near-duplicates")
    drop(links, labels, copies, equal, sets)
    return done
