"""Language identification, toxicity and the pipeline."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from marquee.llm import language, toxicity
from marquee.llm.queries import QUERIES
from tests.conftest import SF001, SF01
from tests.llm.conftest import ODD


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op4_language"](spark, SF001).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.9


def test_language_of_odd_rows(spark, odd, empty):
    net = language.train_on(odd)
    got = language.identify(odd, net).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (1, 2, 3, 4))
    assert by[5].lang_pred == "en"
    assert language.train_on(empty) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.identify(empty, net).count() == 0


def test_windows_cover_the_whole_text():
    text = "ÄÖ ß x" * 500
    w = language.windows(text)
    assert w.tobytes().rstrip(b"\0") == text.lower().encode() and w.shape[1] == language.WINDOW


def test_index_is_exact():
    rng = np.random.default_rng(5)
    idf = rng.uniform(1, 5, 61)
    idf[60] = 1

    def vector():
        c = {int(p): int(rng.integers(1, 4)) for p in rng.choice(60, rng.integers(1, 6), replace=False)}
        return toxicity.unit({**c, 60: int(rng.integers(3, 200))}, idf)

    held = [vector() for _ in range(900)]
    index = toxicity.Index(held, rng.integers(0, 2, 900), list(range(900)), 61, {0: 1.0, 1: 1.0})
    dense = np.zeros((900, 61))
    for row, i in enumerate(index.ids):
        dense[row, held[i][0]] = held[i][1]
    for _ in range(50):
        at, w = vector()
        q = np.zeros(61)
        q[at] = w
        scores = dense @ q
        best, cosine = index.nearest(at, w, 15)
        assert np.allclose(cosine, np.sort(scores)[::-1][:15]) and np.allclose(scores[best], cosine)


def test_index_travels_as_counts():
    import pickle
    rng = np.random.default_rng(8)
    idf = np.append(rng.uniform(1, 5, 400), 1.0)
    terms = [np.append(np.sort(rng.choice(400, 150, replace=False)), 400) for _ in range(700)]
    counts = [np.append(rng.integers(1, 4, 150), rng.integers(150, 60_000)) for _ in terms]
    raw = [(1 + np.log(c)) * idf[p] for p, c in zip(terms, counts)]
    lengths = [np.sqrt((w * w).sum()) for w in raw]
    units = [(p, w / n) for p, w, n in zip(terms, raw, lengths)]
    index = toxicity.Index(units, rng.integers(0, 2, 700), list(range(700)), 401, {0: 1.0, 1: 2.0}, (counts, lengths, idf))
    plain = toxicity.Index(units, index.labels[np.argsort(index.ids)].astype(int), list(range(700)), 401, {0: 1.0, 1: 2.0})
    sent = pickle.dumps(index)
    assert len(sent) < 0.5 * len(pickle.dumps(plain))
    back = pickle.loads(sent)
    assert (back.nearest(*units[5], 9)[1] == index.nearest(*units[5], 9)[1]).all()
    for name in ("at", "w", "block", "top", "starts", "block_starts", "labels", "weights"):
        assert (getattr(back, name) == getattr(index, name)).all(), name


def test_isotonic_is_monotone():
    x = np.array([0.1, 0.2, 0.2, 0.5, 0.9, 1.0])
    knots, values = toxicity.isotonic(x, np.array([0.0, 1.0, 0.0, 0.0, 1.0, 1.0]), np.ones(6))
    assert (np.diff(np.interp(np.linspace(0, 1, 50), knots, values)) >= -1e-12).all() and np.interp(1.0, knots, values) == 1


def test_all_examples_are_calibrated():
    # label 1 at every third example: term 0 or 1 by label, and one for the length
    n = 6400
    labels = (np.arange(n) % 3 == 1).astype(np.int64)
    at = np.stack([labels, np.full(n, 2)], axis=1).ravel()
    every = list(range(n))
    model = toxicity._fitted({"a": 0, "b": 1}, np.array([5.0, 5.0, 1.0]), every, labels, np.arange(0, 2 * n + 1, 2), at, np.ones(2 * n), every, every,
                             {0: 1.0, 1: 1.0}, 0.33, 0.33)
    assert model.values.max() == 1 and model.values.min() == 0


def test_toxicity_on_held_out_documents(spark):
    rows = QUERIES["op1_toxicity"](spark, SF01).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p for p, y in held if y == 1]) > 0.7 and np.mean([p for p, y in held if y == 0]) < 0.02


def test_toxicity_of_odd_rows(spark, odd, empty):
    bad = spark.createDataFrame([(i, f"you are a moron number{i} {'fine ' * (i % 5)}" if i % 2 else f"a good day number{i}") for i in range(100, 200)],
                                "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 200)] + [(6, 0), (6, None), (None, 1), (1, 0), (5, 0), (777, 1)], "doc_id long, toxic int")
    docs = odd.select("doc_id", "text").unionByName(bad).unionByName(spark.createDataFrame([(300, "what a moron"), (301, None)], "doc_id long, text string"))
    model = toxicity.train_on(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[300].predicted == 1 and got[300].evidence[0].label == 1
    assert all(got[d].predicted == 0 and 0 <= got[d].score < 0.7 for d in (1, 2, 3, 5, 6, 7, 301, None))
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(empty, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}


def test_texts_without_a_selected_term_have_evidence(spark):
    # each kind of rare word is in three examples of label 1 only: too few for the vocabulary
    def letters(i):
        return "".join(chr(97 + i // 26 ** k % 26) for k in range(3))
    rows = [(i, f"{letters(i // 3 * 7)}zzxq common words of a day {i}" if i < 300 else f"common words of a day {letters(i * 5)}yyk {i}") for i in range(900)]
    docs = spark.createDataFrame([*rows, (5000, f"{letters(7)}zzxq"), (5001, "4 5 6"), (5002, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(900)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[5000].score > 0.9 and {e.doc_id for e in got[5000].evidence} >= {3, 4, 5} and got[5001].evidence == []
    assert all(got[i].evidence for i in range(900)) and len(model.whole.index.ids) == 900


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", ("vile awful words " if i % 3 == 0 else "kind good words ") + f"of day {i % 7}") for i in range(120)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(120)], "doc_id string, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train_on(docs, labels)).collect()}
    assert len(got) == 120 and got["d0"].score > 0.7 > got["d1"].score
    assert got["d0"].evidence[0].doc_id.startswith("d") and got["d0"].evidence[0].label == 1


def test_one_row_of_a_repeated_id_is_the_same_each_time(spark):
    rows = [(1, "one two three four five six"), (1, "another text of the same id, longer than the first"), (1, None), (2, "seven eight nine ten eleven"), (None, "x"), (None, "x")]
    keep = dict(corpus_pipeline.STAGES)["jaccard_join"]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        kept = sorted(((r.doc_id, r.text) for r in keep(spark, docs, SF001).collect()), key=str)
        assert kept == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001).persist()
        state[name] = out.count()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "language_id":
            assert state[name] == docs.where("text rlike '\\\\p{L}'").count()
        if name == "jaccard_join":
            from tests.llm.test_similarity import brute
            groups = brute({r.doc_id: r.text for r in docs.collect()}, 5, 80)
            assert {r.doc_id for r in out.collect()} == {d for d, (_, c) in groups.items() if d == c}
        if name == "packing":
            assert out.agg({"length": "sum"}).first()[0] > 0
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    assert list(state) == ["language_id", "toxicity", "jaccard_join", "mixing", "packing"]


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages_on_odd_rows(spark, odd, empty, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = odd.selectExpr("*", "2 as _copies", "3 as _copy", "'z' as c1", "4 as taken", "5 as copies")
    staged = stage(spark, docs, SF001)
    out = staged.collect()
    if name != "packing":
        assert staged.columns == docs.columns
    assert all(r._copies == 2 and r.c1 == "z" and r.copies == 5 for r in out if name != "packing")
    ids = [r.doc_id for r in out]
    if name == "language_id":
        assert sorted(ids, key=str) == sorted([5, 6, 7, 7, 8, 9, None], key=str) or set(ids) <= {5, 6, 7, 8, 9, None}
    if name == "jaccard_join":
        assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 5, 6, 9, None], key=str)
    if name == "packing":
        assert set(ids) == {r[0] for r in ODD}
    assert stage(spark, empty, SF001).count() == 0


def test_fitting_holds_little_memory():
    """A fit holds a few arrays of the postings' number, none of all examples' weights besides the index."""
    import tracemalloc
    rng = np.random.default_rng(2)
    n, each, terms = 1500, 800, 20_000
    at = np.sort(np.argsort(rng.random((n, terms), dtype=np.float32), axis=1)[:, :each], axis=1).astype(np.int32).ravel()
    counts, labels, every = rng.integers(1, 9, n * each).astype(np.int32), rng.integers(0, 2, n), list(range(n))
    idf, starts = rng.random(terms) + 1, np.arange(0, n * each + 1, each)
    tracemalloc.start()
    model = toxicity._fitted({str(i): i for i in range(terms)}, idf, every, labels, starts, at, counts, every, every[:20], {0: 1.0, 1: 1.0}, 0.5, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.index.at) == n * each
    assert peak < 48 * n * each


def test_terms_of_many_texts_at_once(monkeypatch):
    from collections import Counter
    rng = np.random.default_rng(4)
    words = ["the", "then", "thens", "thensome", "\u00b2", "\u00b2x!", "\u03a3\u0391\u03a3", "\u0130stanbul", "don't-stop", "12", "a_b", "thens,", "(thens)"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(60)] + [None, "", " \x1c "]
    every = sorted({f for t in texts for w in toxicity._WORD.findall((t or "").lower()) for f in toxicity.word_terms(w)})
    places = {t: i for i, t in enumerate(every[::2])}

    def brute(text):
        tokens = (text or "").lower().split()
        out = Counter(places[f] for t in tokens for w in toxicity._WORD.findall(t) for f in toxicity.word_terms(w) if f in places)
        return sorted(out.items()) + [(len(places), len(tokens))] if out else []

    for entries, letters in ((300_000, 1 << 20), (3, 50)):  # nothing is forgotten, or all of it again and again
        monkeypatch.setattr(toxicity, "TERM_ENTRIES", entries)
        monkeypatch.setattr(toxicity, "LETTERS", letters)
        terms = toxicity._Terms(places)
        got = [c for some in toxicity.split_texts(texts) for c in toxicity.term_counts(some, terms)]
        assert [list(zip(at.tolist(), n.tolist())) for at, n in got] == [brute(t) for t in texts]
    terms = toxicity._Terms(places)
    assert terms["thens,"] == terms["(thens)"] == terms["thens"] > 0 == terms["12"]


@pytest.mark.parametrize("bounded,rows", [(0, 0), (0, 9), (1 << 20, 0), (1 << 20, 9)])
def test_nearest_by_blocks_or_by_whole_rows(monkeypatch, bounded, rows):
    monkeypatch.setattr(toxicity, "BOUNDED", bounded)
    monkeypatch.setattr(toxicity, "FULL_ROWS", rows)
    rng = np.random.default_rng(6)
    idf = np.append(rng.uniform(1, 5, 40), 1.0)
    often = np.append(np.full(10, 9.0), np.ones(30)) / 120  # ten terms that many examples have

    def vector():
        at = rng.choice(40, 12, replace=False, p=often)
        return toxicity.unit({**{int(p): int(rng.integers(1, 4)) for p in at}, 40: int(rng.integers(3, 200))}, idf)

    held = [vector() for _ in range(500)]
    index = toxicity.Index(held, rng.integers(0, 2, 500), list(range(500)), 41, {0: 1.0, 1: 1.0})
    assert len(index.full) == rows
    dense = np.zeros((500, 41))
    for row, i in enumerate(index.ids):
        dense[row, held[i][0]] = held[i][1]
    for _ in range(30):
        at, w = vector()
        scores = dense[:, at] @ w
        best, cosine = index.nearest(at, w, 15, leave_out=7)
        scores[7] = 0
        assert np.allclose(cosine, np.sort(scores)[::-1][:15]) and np.allclose(scores[best], cosine) and 7 not in best
