"""Prefix trie over conversations that share their first turns.

Conversations become sequences of turn digests, are sorted and cut into range shards. A task dictionary-encodes the
turns of its shard, inserts the distinct sequences into a ternary search tree, medians first so that the trees of
siblings are balanced, and walks it iteratively. Only nodes on the paths of a shard's first and last sequence (its
spines) can lie in other shards too; they are merged in groups of neighbouring shards until one group is left.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import broadcast_if_small, prepare, shuffle_partitions, spool
from marquee.llm.tokens import string_column

#: Turns of a range shard on average.
SHARD_TURNS = 1 << 18
#: Neighbouring shards whose spines are merged by one task.
FAN = 32
#: Nodes of spines (fixed width) up to which they are broadcast to their children.
BROADCAST_ROWS = 500_000

NODE, SPINE, ENDS = 0, 1, 2
FIRST, LAST = 1, 2
ROOT_KEY = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()

_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("place", pa.int64()), ("parent", pa.int64()), ("flags", pa.int32()),
                     ("depth", pa.int64()), ("turn", pa.binary()), ("points", pa.int64()), ("node_key", pa.binary()), ("parent_key", pa.binary()),
                     ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                     ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.string())])
_DDL = ("kind int, shard long, place long, parent long, flags int, depth long, turn binary, points long, node_key binary, parent_key binary, conv_id long, "
        "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, points): of each conversation c the first crc32(c) % 6 turns of conversation c - c % 100, then
    its own turns behind as many; a key is 128 bits of the SHA-256 of a turn's role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("key"),
        F.length(text).cast("long").alias("points"))
    # one row a conversation, bounded by its number of turns
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "points"))).alias("t")) \
        .select("conv_id", F.col("t.key").alias("keys"), F.col("t.points").alias("points"))
    own = spool(own, "own-turns")
    heads = own.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("keys", 1, 5).alias("head"),
                                                          F.slice("points", 1, 5).alias("head_points"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    with_head = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left").withColumn("h", h)
    joined = lambda head, tail: F.concat(F.slice(F.coalesce(F.col(head), F.array().cast(dict(own.dtypes)[tail])), F.lit(1), F.col("h")),
                                         F.slice(F.col(tail), F.col("h") + 1, F.greatest(F.size(tail), F.lit(1))))
    return with_head.select("conv_id", joined("head", "keys").alias("keys"), joined("head_points", "points").alias("points"))


class Tree:
    """Trie nodes in arrays, node 0 the root; a parent comes before its children."""

    def __init__(self):
        self.parent, self.depth, self.turn, self.points = [-1], [0], [b""], [0]
        self.n, self.least, self.children, self.leaves, self.saved = [0], [None], [0], [0], [0]
        self.key: dict[int, bytes] = {0: ROOT_KEY}

    def add(self, parent: int, turn, points: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.turn.append(turn)
        self.points.append(points)
        for x in (self.n, self.children, self.leaves, self.saved):
            x.append(0)
        self.least.append(None)
        return len(self.parent) - 1

    def meet(self, p: int, n: int, least) -> None:
        self.n[p] += n
        if least is not None and (self.least[p] is None or least < self.least[p]):
            self.least[p] = least

    def path(self, p: int) -> list[int]:
        out = []
        while p >= 0:
            out.append(p)
            p = self.parent[p]
        return out[::-1]

    def node_key(self, p: int, turn_of=lambda turn: turn) -> bytes:
        import xxhash
        todo = []
        while p not in self.key:
            todo.append(p)
            p = self.parent[p]
        for q in reversed(todo):
            self.key[q] = xxhash.xxh3_128_digest(self.key[self.parent[q]] + turn_of(self.turn[q]))
        return self.key[todo[0] if todo else p]

    def finish(self, order: list[int], spine: set[int]) -> list[int]:
        """Bottom up in ``order`` reversed: nodes outside the spines get their sums and add them to their parents'."""
        done = [p for p in order if p not in spine]
        for p in reversed(done):
            if not self.children[p]:
                self.leaves[p] = 1
            self.saved[p] += (self.n[p] - 1) * self.points[p]
            q = self.parent[p]
            if q >= 0:
                self.children[q] += 1
                self.leaves[q] += self.leaves[p]
                self.saved[q] += self.saved[p]
        return done


class SearchTree(Tree):
    """Ternary search tree: the children of a trie node form a binary tree by turn id (lo, hi); eq leads one turn on."""

    def __init__(self):
        super().__init__()
        self.lo, self.eq, self.hi = [-1], [-1], [-1]

    def add(self, parent, turn, points):
        for x in (self.lo, self.eq, self.hi):
            x.append(-1)
        return super().add(parent, turn, points)

    def insert(self, turns: list[int], points: list[int]) -> int:
        """The node at the end of the sequence."""
        lo, eq, hi, turn = self.lo, self.eq, self.hi, self.turn
        p = 0
        for t, n in zip(turns, points, strict=True):
            q = eq[p]
            if q < 0:
                p = self._child(p, t, n, eq, p)
                continue
            while turn[q] != t:
                side = lo if t < turn[q] else hi
                if side[q] < 0:
                    q = self._child(p, t, n, side, q)
                    break
                q = side[q]
            p = q
        return p

    def _child(self, p, t, n, side, at):
        new = self.add(p, t, n)
        side[at] = new
        return new

    def walk(self) -> list[int]:
        """All nodes, parents before their children; no recursion."""
        out, stack = [0], [self.eq[0]]
        while stack:
            q = stack.pop()
            if q >= 0:
                out.append(q)
                stack += (self.hi[q], self.eq[q], self.lo[q])
        return out


def median_order(n: int) -> list[int]:
    """0..n-1, the middle first, then the middles of the halves, and so on."""
    out, todo = [], [(0, n)]
    for lo, hi in todo:
        if lo < hi:
            mid = (lo + hi) // 2
            out.append(mid)
            todo += [(lo, mid), (mid + 1, hi)]
    return out


def _rows(records: list[dict]):
    for at in range(0, len(records), 4096):
        yield pa.RecordBatch.from_pylist(records[at:at + 4096], schema=_SCHEMA)


def _emit(tree: Tree, order: list[int], spine: dict[int, int], shard: int, turn_of, ends_of, keyed: bool) -> list[dict]:
    """Rows of a finished tree: NODE for what is done, SPINE for what may lie in other shards too. ``ends_of`` gives
    a done node's digest; ``keyed``: done nodes carry their keys, as their members end in several shards."""
    done = tree.finish(order, set(spine))
    out = []
    for p in done:
        q = tree.parent[p]
        open_parent = q in spine
        out.append({"kind": NODE, "depth": tree.depth[p], "conv_id": tree.least[p], "parent_conv_id": None if q < 0 or open_parent else tree.least[q],
                    "parent_key": tree.node_key(q, turn_of) if open_parent else None, "node_key": tree.node_key(p, turn_of) if keyed else None,
                    "n_convs": tree.n[p], "n_children": tree.children[p], "n_leaves": tree.leaves[p], "saved_tokens": tree.saved[p], "ends_sha256": ends_of(p)})
    for p in (p for p in order if p in spine):
        out.append({"kind": SPINE, "shard": shard, "place": p, "parent": tree.parent[p], "flags": spine[p], "depth": tree.depth[p], "turn": turn_of(tree.turn[p]),
                    "points": tree.points[p], "conv_id": tree.least[p], "n_convs": tree.n[p], "n_children": tree.children[p], "n_leaves": tree.leaves[p],
                    "saved_tokens": tree.saved[p], "node_key": tree.node_key(p, turn_of), "ends_sha256": None, "ends": None})
    return out


def _spine(first: list[int], last: list[int]) -> dict[int, int]:
    out = dict.fromkeys(first, FIRST)
    for p in last:
        out[p] = out.get(p, 0) | LAST
    return out


def shard_rows(shard: int, convs: list[int], keys: list[list[bytes]], points: list[list[int]]) -> list[dict]:
    """The rows of one range shard: its sequences ascending, equal ones by conversation id."""
    words = sorted({k for s in keys for k in s})
    number = {k: i for i, k in enumerate(words)}
    starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    tree, at = SearchTree(), [0] * len(starts)
    for k in median_order(len(starts)):
        i = starts[k]
        at[k] = tree.insert([number[x] for x in keys[i]], points[i])
    ends: dict[int, list[int]] = {}
    for k, i in enumerate(starts):
        own = convs[i:starts[k + 1] if k + 1 < len(starts) else len(convs)]
        ends[at[k]] = own
        tree.meet(at[k], len(own), min(own))
    order = tree.walk()
    for p in reversed(order[1:]):
        tree.meet(tree.parent[p], tree.n[p], tree.least[p])
    spine = _spine(tree.path(at[0]), tree.path(at[-1]))
    turn_of = lambda t: words[t] if isinstance(t, int) else t
    joined = lambda p: ",".join(map(str, sorted(ends[p])))
    out = _emit(tree, order, spine, shard, turn_of, lambda p: hashlib.sha256(joined(p).encode()).hexdigest() if p in ends else NO_ENDS, False)
    out += [{"kind": ENDS, "shard": shard, "node_key": tree.node_key(p, turn_of), "ends": joined(p)} for p in spine if p in ends]
    return out


def merged_rows(group: int, shards: list[list[dict]], last_round: bool) -> list[dict]:
    """Spines of neighbouring shards, each a list of SPINE rows, merged by their paths."""
    tree, child, first, last = Tree(), {}, [], []
    for i, rows in enumerate(shards):
        own = {}
        last = []
        for r in rows:
            if r["depth"] == 0:
                p = 0
            else:
                q = own[r["parent"]]
                p = child.get((q, r["turn"]))
                if p is None:
                    p = child[q, r["turn"]] = tree.add(q, r["turn"], r["points"])
                    tree.key[p] = r["node_key"]
            own[r["place"]] = p
            tree.meet(p, r["n_convs"], r["conv_id"])
            tree.children[p] += r["n_children"]
            tree.leaves[p] += r["n_leaves"]
            tree.saved[p] += r["saved_tokens"]
            if i == 0 and r["flags"] & FIRST:
                first.append(p)
            if r["flags"] & LAST:
                last.append(p)
    return _emit(tree, list(range(len(tree.parent))), {} if last_round else _spine(first, last), group, lambda t: t, lambda p: None, True)


def _shards(sequences: DataFrame, shards: int) -> DataFrame:
    def build(batches):
        from pyspark import TaskContext
        convs, keys, points = [], [], []
        for b in batches:
            convs += string_column(b, "conv_id")
            keys += string_column(b, "keys")
            points += string_column(b, "points")
        if convs:
            yield from _rows(shard_rows(TaskContext.get().partitionId(), convs, keys, points))

    ordered = sequences.repartitionByRange(shards, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    return ordered.mapInArrow(build, _DDL)


def _merged(spines: DataFrame, groups: int) -> DataFrame:
    def merge(batches):
        group, own = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["group"] != group:
                    if own:
                        yield from _rows(merged_rows(group, own, groups == 1))
                    group, own, shard = r["group"], [], None
                if r["shard"] != shard:
                    shard = r["shard"]
                    own.append([])
                own[-1].append(r)
        if own:
            yield from _rows(merged_rows(group, own, groups == 1))

    dealt = spines.withColumn("group", F.floor(F.col("shard") / FAN).cast("long")).repartition(groups, "group")
    # places follow the order in which nodes were made: parents first
    return dealt.sortWithinPartitions("group", "shard", "place").mapInArrow(merge, _DDL)


def _ends(pieces: DataFrame, parts: int) -> DataFrame:
    """(node_key, sha): the digest of a node's ends over its shards, read as a stream. SHA-256 takes its input in
    order, so one task reads all pieces of a node, holding one at a time."""
    def digest(batches):
        key, sha, keys, shas = None, None, [], []
        for b in batches:
            for k, piece in zip(string_column(b, "node_key"), string_column(b, "ends"), strict=True):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
        if key is not None:
            keys.append(key)
            shas.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["node_key", "sha"])

    return pieces.repartition(parts, "node_key").sortWithinPartitions("node_key", "shard").mapInArrow(digest, "node_key binary, sha string")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, least_shards: int | None = None) -> DataFrame:
    """The nodes of the trie over rebuilt conversations (``rebuilt``): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; one row per node.

    Turns are ordered by ``turn``, null first, equal ones by the digest of role and text; repeated rows are turns of
    their own. Null role or text is empty. Rows without a conv_id take no part. A conversation left without a turn
    is a member of the root. Any number of conversations may share a sequence: shards are cut by (sequence, conv_id), so copies
    spread over shards and meet only as sums on the spines. A conversation itself is one row of its turns' digests.
    An empty table gives an empty result, without a root. Other columns are not read.
    """
    spark = conversations.sparkSession
    prepare(spark)
    sequences = spool(rebuilt(conversations), "sequences")
    turns = sequences.agg(F.sum(F.size("keys").cast("long")).alias("t")).first().t or 0
    shards = max(least_shards or shuffle_partitions(spark), -(-turns // shard_turns))
    first = spool(_shards(sequences, shards), "shard-trees")
    rounds, spines = [], first.where(F.col("kind") == SPINE)
    while not rounds or shards > 1:
        shards = -(-shards // FAN)
        rounds.append(spool(_merged(spines, shards), "merged-trees"))
        spines = rounds[-1].where(F.col("kind") == SPINE)
    columns = ["conv_id", "depth", "parent_conv_id", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = first.where(F.col("kind") == NODE).select(*columns, "ends_sha256")
    outer = rounds[0]
    for r in rounds[1:]:
        outer = outer.unionByName(r)
    outer = outer.where(F.col("kind") == NODE)
    ends = _ends(first.where(F.col("kind") == ENDS), shuffle_partitions(spark))
    outer_done = outer.select(*columns, "node_key").join(ends, "node_key", "left")
    every = inner.unionByName(outer_done.select(*columns, F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256")))
    parents = broadcast_if_small(outer.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("open_parent")), BROADCAST_ROWS)
    return every.join(parents, "parent_key", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "open_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x,
                  sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': k, 'n': length(x)} ORDER BY turn NULLS FIRST, k) AS seq,
               xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                   lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                            lambda z, i: xor(z >> 1, 3988292384::BIGINT * (z & 1)))), 4294967295::BIGINT) % 6 AS h
        FROM t GROUP BY conv_id),
whole AS (SELECT o.conv_id, list_concat(CASE WHEN b.seq IS NULL THEN [] ELSE b.seq[1:o.h] END, o.seq[o.h + 1:]) AS seq
          FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
prefixes AS (SELECT conv_id, d, list_transform(seq[1:d], lambda s: s.k) AS p, len(seq) AS n,
                    CASE WHEN d = 0 THEN 0 ELSE seq[d].n END AS points
             FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
          FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
sums AS (SELECT p[1:a] AS p, a AS d, sum((n_convs - 1) * points) AS saved, count(*) FILTER (leaf) AS leaves
         FROM (SELECT o.p, o.n_convs, o.points, c.n IS NULL AS leaf, unnest(range(0, o.d + 1)) AS a
               FROM nodes o LEFT JOIN children c ON c.p = o.p AND c.d = o.d) GROUP BY ALL)
SELECT o.conv_id, o.d AS depth, q.conv_id AS parent_conv_id, o.n_convs, coalesce(c.n, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM nodes o JOIN sums s ON s.p = o.p AND s.d = o.d LEFT JOIN children c ON c.p = o.p AND c.d = o.d
LEFT JOIN nodes q ON o.d > 0 AND q.d = o.d - 1 AND q.p = o.p[1:o.d - 1]
"""
