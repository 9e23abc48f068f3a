"""The prefix trie against a plain enumeration of all prefixes."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np

from marquee.llm import trie
from marquee.llm.queries import ORACLE, QUERIES
from tests.conftest import SF001

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    below, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            below[p[:-1]] += 1
    for p, own_members in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += below[p] == 0
            saved[p[:d]] += (len(own_members) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), below[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def made(n, seed=3):
    """Conversations over few turns: many share prefixes, a third are one conversation."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        same = c % 3 == 0
        for turn in range(4 if same else int(rng.integers(0, 7))):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"turn {turn if same else int(rng.integers(0, 3))} é"))
    return rows


def test_search_tree_is_balanced_and_whole():
    tree = trie.SearchTree()
    ends = [tree.insert([i, 7], [1, 2]) for i in trie.median_order(1000)]
    assert len(set(ends)) == 1000 and sorted(trie.median_order(1000)) == list(range(1000))
    depth = {tree.eq[0]: 1}
    for q in tree.walk()[1:]:
        for side in (tree.lo[q], tree.hi[q]):
            if side >= 0:
                depth[side] = depth.get(q, 1) + 1
    assert max(depth.values()) <= 11
    assert sorted(tree.walk()) == list(range(2001))
    deep = trie.SearchTree()
    deep.insert(list(range(5000)), [1] * 5000)
    assert len(deep.walk()) == 5001


def test_awkward_rows(spark):
    rows = [(0, 0, "user", "a"), (0, 1, None, None), (0, None, "user", "first"), (0, 1, "x", "b"), (0, 1, "x", "b"), (None, 0, "user", "lost"),
            (1, 0, "user", "a"), (7, None, None, None), (105, 3, "user", "no head"), (105, 2, "userno", " head"), (250, 0, "", "long " * 50_000),
            (-5, 0, "user", "a"), (-5, 1, "user", "b"), (2 ** 40, 0, "user", "first")]
    # one conversation of 700 turns: a deep chain
    rows += [(300, i, "user", f"t{i % 5}") for i in range(700)] + [(301, i, "user", f"t{i % 5}") for i in range(690)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", depth int, key string")
    positive = [r for r in rows if r[0] is None or r[0] >= 0]
    assert got(trie.prefix_trie(df.where("conv_id is null or conv_id >= 0"), least_shards=2)) == brute(positive)
    assert trie.prefix_trie(df.where("conv_id = -5")).count() >= 1
    empty = trie.prefix_trie(df.limit(0))
    assert empty.count() == 0 and empty.columns == COLUMNS


def test_any_number_of_shards_gives_the_same_nodes(spark, monkeypatch):
    rows = made(240)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    monkeypatch.setattr(trie, "FAN", 3)
    # 1 shard: nothing to merge; 14 shards: three rounds, with the hot conversation in several shards
    for shards in (1, 14):
        assert got(trie.prefix_trie(df, shard_turns=10 ** 9, least_shards=shards)) == brute(rows)


def test_query_equals_oracle_and_brute_force(spark):
    path = f"{SF001}/conversations.parquet"
    mine = got(QUERIES["op12_conversation_trie"](spark, SF001))
    assert mine == brute([tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    rows = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op12_conversation_trie']})").fetchall()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in rows) == mine
