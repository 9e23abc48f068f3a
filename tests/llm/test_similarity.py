"""Joins and searches against brute force."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import ann, components, shingles, vectors
from marquee.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.conftest import ODD


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 300), (200, 300), (5, 5)] + [tuple(map(int, rng.integers(400, 460, 2))) for _ in range(40)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots({x for p in links for x in p}, links)
    assert got == {n: r for n, r in expected.items() if n in got}
    assert {n for p in links for n in p if p[0] != p[1]} == set(got)
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_in_a_task():
    a, b = np.array([0, 1, 5, 6, 8]), np.array([1, 2, 6, 7, 3])
    assert components.forest(9, a, b).tolist() == [0, 0, 0, 3, 4, 5, 5, 5, 3]


def shingle_set(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not parts:
        return frozenset()
    return frozenset([tuple(parts)]) if len(parts) < words else frozenset(zip(*(parts[i:] for i in range(words))))


def brute(docs, words, percent):
    sets = {d: shingle_set(t, words) for d, t in docs.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = defaultdict(int)
    for own in holders.values():
        for a, b in itertools.combinations(sorted(own), 2):
            common[a, b] += 1
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    root = roots(sets, links)
    return {d: (len(sets[d]), root[d]) for d in sets}


def copies(seed=1):
    """Near copies, exact copies, texts made of one shared passage, tiny texts, one large group."""
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 5000))
    passage = [word() for _ in range(40)]
    docs = {}
    base = [[word() for _ in range(n)] for n in (1, 2, 3, 5, 9, 30, 80, 200)]
    for i in range(330):
        if i % 3 == 0:
            t = list(base[-1])  # a third of all rows in one group
            for _ in range(int(rng.integers(0, 5))):
                t[rng.integers(0, len(t))] = word()
        elif i % 3 == 1:
            t = list(base[i % len(base)])
            if rng.random() < 0.6:
                t[rng.integers(0, len(t))] = word()
        else:
            t = passage[:int(rng.integers(20, 41))] + [word() for _ in range(int(rng.integers(0, 25)))]
        docs[i] = " ".join(t)
    return docs


@pytest.mark.parametrize(("words", "percent", "rare", "chunk"), [(4, 85, 32, 192), (5, 80, 2, 7)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, words, percent, rare, chunk):
    monkeypatch.setattr(shingles, "RARE", rare)
    monkeypatch.setattr(shingles, "CHUNK", chunk)
    docs = copies()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.near_duplicates(df, words, percent).collect()}
    assert got == brute(docs, words, percent)


def test_pair_entries_meet_for_every_similar_pair():
    rng = np.random.default_rng(4)
    for n in (2, 5, 12, 40, 90, 300):
        x = np.unique(rng.integers(1, 1 << 62, n)).astype(np.uint64)
        for _ in range(20):
            y = x.copy()
            drop = shingles._slack(n, 85) // 2
            y = np.unique(np.concatenate([rng.permutation(y)[drop:], rng.integers(1, 1 << 62, drop).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                a, b = (shingles.pair_entries(s, shingles._slack(len(s), 85) + 1, len(s), 85) for s in (x, y))
                assert len(np.intersect1d(a, b))


def test_jaccard_join_of_odd_rows(spark, odd, empty):
    rows = shingles.near_duplicates(odd, 4, 85).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    expected = brute({r[0]: r[1] for r in ODD if r[0] is not None}, 4, 85)
    assert {d: v for d, v in got.items() if d is not None} == expected
    assert got[None][1] is None and got[8][1] == 6 and got[2] == (0, 2)
    assert shingles.near_duplicates(empty).count() == 0


def test_jaccard_join_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_jaccard_join"](spark, SF001).collect()}
    assert got == brute(docs, 4, 85)


def clustered(n=700, dims=20, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(25, dims))
    x = np.where(rng.random((n, 1)) < 0.5, centre[rng.integers(0, 25, n)] + rng.normal(size=(n, dims)) * 0.25, rng.normal(size=(n, dims)))
    x[n // 3:n // 2] = centre[0] + rng.normal(size=(n // 2 - n // 3, dims)) * 0.02  # one large group
    x[-20:] = x[:20]  # copies
    x[-30:-20] = 3 * x[20:30]
    return x.astype(np.float32).astype(float)


VECTORS = "vec_id long, embedding array<double>, label int, v string, dims int, n long"
BAD = [(9001, None, 1), (9002, [0.0] * 20, 1), (9003, [1.0, None] * 10, 1), (9004, [float("nan")] * 20, 1), (9005, [float("inf")] * 20, 1),
       (9006, [1.0, 2.0], 1), (9007, [1.0, 2.0], 1), (9008, [], 1), (9009, [1.0] * 20, None), (9010, [1.0] * 20, None)]


def vector_table(spark, x, label):
    rows = [(i, v.tolist(), int(label[i]), "x", 1, 1) for i, v in enumerate(x)] + [(*b, "x", 1, 1) for b in BAD] + [(None, [1.0] * 20, 1, "x", 1, 1)]
    return spark.createDataFrame(rows, VECTORS)


@pytest.mark.parametrize("tile", [1024, 40])
def test_vector_duplicates_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    x = clustered()
    label = np.arange(len(x)) % 4 // 2
    df = vector_table(spark, x, label)
    rows = vectors.near_duplicates(df).collect()
    assert len(rows) == df.count()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = roots(range(len(x)), zip(*np.nonzero(near), strict=True))
    assert {k: v for k, v in got.items() if k is not None and k < 9000} == {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(len(x))}
    assert got[9006] == (1, 9006, True) and got[9007] == (1, 9006, False)
    assert all(got[i] == (0, i, True) for i in (9001, 9002, 9003, 9004, 9005, 9008, 9009, 9010))
    assert got[None] == (0, None, True)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("grid", range(1, 9))
def test_each_pair_meets_once_at_any_grid(grid):
    x = clustered(n=300, dims=20)  # blocks of 8, 8 and 4 dimensions
    blocks, ids, unit = vectors.Blocks(20, 0.93), np.arange(len(x)), vectors.normalised(x)
    links = Counter()
    for k in range(len(blocks.columns)):
        home, rows, cells = blocks.cells(unit, k, grid)
        for c in np.unique(home):
            hi, si = np.flatnonzero(home == c), rows[cells == c]
            p, q = vectors.tile_pairs(x[hi], x[si], ids[hi], ids[si], blocks, k, 0.93)
            links.update(zip(hi[p].tolist(), si[q].tolist(), strict=True))
    i, j = np.triu_indices(len(x), 1)
    near = vectors.cosines(x[i], x[j]) >= 0.93
    i, j = i[near], j[near]
    assert links == Counter(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("grid", [5, 8])
def test_links_at_a_large_grid(spark, grid):
    x = clustered(n=300, dims=20)[:270]  # without the equal and parallel rows
    nodes = spark.createDataFrame([(i, 1, v.tolist(), 1, 20) for i, v in enumerate(x)], "id long, label int, v array<double>, copies long, dims int")
    counts = {r.id: r.n for r in vectors._links(nodes, 20, grid, 0.93).groupBy("id").agg(F.sum("n").alias("n")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert counts == {i: int(n) for i, n in enumerate(near) if n}


def test_chi_square_quantile():
    sample = np.random.default_rng(0).chisquare(12, 200_000)
    assert abs((sample <= ann.chi_square_quantile(0.9, 12)).mean() - 0.9) < 0.005


def test_nearest_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_ROWS", 400)
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    rng = np.random.default_rng(6)
    x = clustered(1500) * rng.uniform(0.3, 2, (1500, 1))
    df = vector_table(spark, x, np.zeros(len(x)))
    rows = ann.nearest(df.where("vec_id % 20 == 0"), df, k=20).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = 0
    queries = range(0, len(x), 20)
    for q in queries:
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        extra = float(x[q].sum())  # the two all-ones rows without a label are candidates too
        all_ids, all_scores = np.concatenate([np.arange(len(x)), [9009, 9010]]), np.concatenate([score, [extra, extra]])
        best = all_ids[np.lexsort((all_ids, -all_scores))][:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(f[2] >= g[2] for f, g in itertools.pairwise(found))
        hit += len(set(best.tolist()) & {f[1] for f in found})
    assert hit / (20 * len(queries)) >= 0.9
    assert not {9002, 9003, 9004, 9005, 9006} & {r.vec_id for r in rows}
    few = ann.nearest(df.where("vec_id = 9007"), df, k=20).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(9007, 1, 9006)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_nearest_neighbours_of_the_table(spark):
    rows = QUERIES["op2_nearest_neighbours"](spark, SF001).collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()}
    got = defaultdict(set)
    for r in rows:
        got[r.query_id].add(r.vec_id)
        assert abs(r.score - float((data[r.query_id] * data[r.vec_id]).sum())) < 1e-12
    hit = 0
    for q in got:
        best = sorted((d for d in data if d != q), key=lambda d: (-(data[q] * data[d]).sum(), d))[:20]
        hit += len(set(best) & got[q])
    assert set(got) == {d for d in data if d % 20 == 0} and hit / (20 * len(got)) >= 0.9
