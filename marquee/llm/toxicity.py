"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted index with block maxima.

Terms are words and word beginnings. The vocabulary is what labelled examples show to go with one label
(likelihood ratio), and one more term stands for all words of a text: it tells many hits in a short text from a
few in a long one. Texts without such a term are compared by all terms that occur in any labelled example, in a second
index over every labelled example. idf comes from all documents. The labelled examples are indexed: postings by term in
blocks of examples, with the largest weight of each block, so that blocks that cannot reach the nearest
ones so far are never scored. Votes of the nearest, weighted by similarity, are calibrated on the examples
themselves, each left out of its own vote.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import crc_remainder, map_texts, prepare, share, shared_value, spool
from marquee.llm.tokens import string_column

#: Labelled rows that the index holds, for each label: a documented bound.
EXAMPLES = 5000
#: Terms in the vocabulary at most, examples that a term needs, and the likelihood ratio that it must reach: the same for
#: samples of any size.
VOCABULARY = 4096
LEAST_EXAMPLES = 4
LEAST_RATIO = 15.0
#: Tokens that a worker knows before it forgets them all (long ones by their letters), and its results for equal vectors.
TERM_ENTRIES, TERM_LETTERS, RESULT_ENTRIES = 300_000, 24, 20_000
#: Letters of the texts that are taken apart at a time (one text at least).
LETTERS = 1 << 20
NEIGHBOURS = 15
BLOCK = 64
#: Postings whose weights are computed at a time.
STEP = 1 << 18
#: Postings of a text from which on blocks are passed over: up to that, adding all up costs less than choosing.
BOUNDED = 1 << 20
#: Terms that at least one in FULL_SHARE examples has are held as whole rows as well, the most frequent FULL_ROWS.
FULL_ROWS, FULL_SHARE = 256, 4
#: What an index derives from its postings.
DERIVED = ("w", "block", "top", "block_starts", "ends", "row", "full")
#: Weight of the base rate among the votes.
PRIOR_VOTES = 0.25

_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings of 4 and 5 letters."""
    return [word + "$", word[:4], word[:5]][:max(1, len(word) - 2)]


class _Terms(dict):
    """white-space token -> a number for its terms in the vocabulary (0: none)."""

    def __init__(self, places: dict[str, int]):
        super().__init__()
        self.places = places
        self.heads = {t.rstrip("$")[:4] for t in places}  # how a word with a term begins
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.letters = 0
        self.flat, self.starts = array("i"), array("q", [0, 0])  # places of the terms of number 0, 1, 2, ...

    def __missing__(self, token: str) -> int:
        words = (token,) if token.isalpha() else _WORD.findall(token)
        number, heads = 0, self.heads
        if len(words) == 1 and words[0] != token:  # a word and its punctuation
            if words[0][:4] in heads:
                number = self[words[0]]
        else:
            place, flat = self.places.get, self.flat
            for w in words:
                if w[:4] in heads:
                    for t in word_terms(w):
                        p = place(t)
                        if p is not None:
                            flat.append(p)
            if len(flat) > self.starts[-1]:
                number = len(self.starts) - 1
                self.starts.append(len(flat))
        if len(token) > TERM_LETTERS:
            self.letters += len(token)
        self[token] = number
        return number

    def found(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Of all tokens, text after text: the places of their terms, and the number of the text that each is from."""
        if len(self) >= TERM_ENTRIES or self.letters >= TERM_ENTRIES * TERM_LETTERS:
            self._forget()
        sizes = [len(t) for t in texts]
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        used = np.flatnonzero(number)
        if not len(used):
            return used, used
        number, row = number[used], np.repeat(np.arange(len(texts)), sizes)[used]
        starts = np.frombuffer(self.starts, np.int64)
        first = starts[number]
        each = starts[number + 1] - first
        return np.frombuffer(self.flat, np.int32)[_ranges(first, each)], np.repeat(row, each)


def _ranges(first: np.ndarray, each: np.ndarray) -> np.ndarray:
    """``each`` numbers from ``first`` on, range after range."""
    return np.arange(each.sum()) + np.repeat(first - (np.cumsum(each) - each), each)


def split_texts(texts: list):
    """The texts' tokens, of a bounded number of letters at a time."""
    held, letters = [], 0
    for t in texts:
        letters += len(t or "")
        if held and letters > LETTERS:
            yield held
            held, letters = [], len(t or "")
        held.append((t or "").lower().split())
    if held:
        yield held


def term_counts(texts: list, terms: _Terms) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text's tokens: places of the vocabulary's terms, in order, and occurrences; at the place after them the number of
    words. Empty without a term."""
    n = len(terms.places)
    place, row = terms.found(texts)
    key, counts = np.unique(row * (n + 1) + place, return_counts=True)
    row = key // (n + 1)
    ends = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    place, none = key - row * (n + 1), np.zeros(0, np.int64)
    return [(np.append(place[a:b], n), np.append(counts[a:b], len(t))) if b > a else (none, none)
            for a, b, t in zip(ends, ends[1:], texts, strict=False)]


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.array([1 + math.log(n) for n in counts.tolist()]) * idf[at] if len(at) else np.zeros(0)
    norm = np.sqrt((w * w).sum())
    return at, w / norm if norm else w


def unit(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF vector of length one: term places in order, and weights."""
    at = np.array(sorted(counts), dtype=np.int64)
    return _weighted(at, np.array([counts[p] for p in at.tolist()]), idf)


class Index:
    """Block-max inverted index of labelled unit vectors.

    With the vectors' counts, lengths and the idf that they were made of it travels as places and counts (six bytes a
    posting); a worker derives weights, blocks and maxima from them, to the last bit as they were."""

    def __init__(self, vectors: list, labels: np.ndarray, ids: list, n_terms: int, weights: dict[int, float], made_of: tuple | None = None):
        # examples with the same strongest term lie together, so that block maxima tell blocks apart
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1][:-1])]), int(labels[i]), i))
        self.labels = np.array([labels[i] for i in order], dtype=np.float64)
        self.weights = np.array([weights[int(labels[i])] for i in order])
        self.ids = [ids[i] for i in order]
        self.blocks = -(-len(order) // BLOCK)
        # postings of all terms one after another, and their blocks
        p = np.concatenate([vectors[i][0] for i in order])
        by = np.argsort(p, kind="stable")
        p = p[by]
        self.at = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])[by]
        self.starts = np.searchsorted(p, np.arange(n_terms + 1, dtype=p.dtype))
        self.made_of = self.room = None
        if made_of is None:
            self.w = np.concatenate([vectors[i][1] for i in order])[by]
            self._derive(p)
            return
        counts, lengths, idf = made_of
        c = np.concatenate([counts[i] for i in order])
        c = c.astype(np.min_scalar_type(int(c.max(initial=0))))[by]
        self.made_of = c, np.array([lengths[i] for i in order]), idf
        del by, p
        self.unpack()

    def _derive(self, p: np.ndarray) -> None:
        """Blocks and their largest weights from the postings; p: the terms of the postings."""
        block = self.at // BLOCK
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.block = block[first].astype(np.int32)
        self.top = np.maximum.reduceat(self.w, first)
        self.block_starts = np.searchsorted(p[first], np.arange(len(self.starts), dtype=p.dtype))
        self.ends = np.append(first, len(p)).astype(np.int32)  # of a term in a block: where its postings begin, and the next one's
        # the most frequent terms as whole rows: adding one up costs less than its postings
        each = np.diff(self.starts)
        often = np.argsort(-each, kind="stable")[:FULL_ROWS]
        often = often[each[often] * FULL_SHARE >= max(1, len(self.labels))]
        self.row = np.full(len(each), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.full = np.zeros((len(often), self.blocks * BLOCK))
        for i, t in enumerate(often.tolist()):
            own = slice(self.starts[t], self.starts[t + 1])
            self.full[i, self.at[own]] = self.w[own]

    def pack(self) -> "Index":
        """Drop what ``unpack`` can derive again."""
        if self.made_of is not None:
            self.__dict__.update(dict.fromkeys(DERIVED))
        return self

    def unpack(self) -> None:
        counts, lengths, idf = self.made_of
        p = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))
        self.w = np.empty(len(p))
        for a in range(0, len(p), STEP):
            own = slice(a, a + STEP)
            self.w[own] = (1 + np.log(counts[own].astype(np.int64))) * idf[p[own]] / lengths[self.at[own]]
        self._derive(p)

    def __getstate__(self) -> dict:
        derived = ("room", *(DERIVED if self.made_of is not None else ()))
        return {k: None if k in derived else v for k, v in self.__dict__.items()}

    def _bounded(self, at: np.ndarray, w: np.ndarray, k: int, leave_out: int) -> np.ndarray | None:
        """As ``_scores``, without the blocks that cannot hold one of the k best; None where those do not save most postings."""
        first = self.block_starts[at]
        each = self.block_starts[at + 1] - first
        entry, x = _ranges(first, each), np.repeat(w, each)
        block, postings = self.block[entry], self.ends[entry + 1] - self.ends[entry]
        bound = np.bincount(block, x * self.top[entry], self.blocks)

        def add(blocks):
            own = blocks[block]
            posting = _ranges(self.ends[entry[own]].astype(np.int64), postings[own])
            return np.bincount(self.at[posting], self.w[posting] * np.repeat(x[own], postings[own]), self.blocks * BLOCK)

        use = np.zeros(self.blocks, bool)
        use[np.argsort(-bound, kind="stable")[:max(2, -(-2 * k // BLOCK))]] = True
        score = add(use)
        if leave_out >= 0:
            score[leave_out] = 0
        floor = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        # blocks that could still hold one of the k best
        more = (bound >= floor - 1e-12) & (bound > 0) & ~use
        if 4 * postings[more[block]].sum() > postings.sum():
            return None
        return score + add(more) if more.any() else score

    def _scores(self, at: np.ndarray, w: np.ndarray, each: np.ndarray) -> np.ndarray:
        """The cosine of every example; each: postings of the terms."""
        row = self.row[at]
        often, few = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        ends = np.cumsum(each[few])
        n = int(ends[-1]) if len(ends) else 0
        # in memory that the process has touched before: fresh pages for every text cost more than the sums
        if self.room is None or not n <= len(self.room[0]) <= 2 * max(BOUNDED, n):
            self.room = np.empty(2 * n, np.int64), np.empty(2 * n), np.empty(self.blocks * BLOCK)
        where, part, product = self.room
        for a, n_, to, x in zip(self.starts[at[few]].tolist(), each[few].tolist(), ends.tolist(), w[few].tolist(), strict=True):
            where[to - n_:to] = self.at[a:a + n_]
            np.multiply(self.w[a:a + n_], x, out=part[to - n_:to])
        score = np.bincount(where[:n], part[:n], self.blocks * BLOCK) if n else np.zeros(self.blocks * BLOCK)
        for i, x in zip(row[often].tolist(), w[often].tolist(), strict=True):
            np.multiply(self.full[i], x, out=product)
            score += product
        return score

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0 (ties: index order), nearest first, and the cosines. Exact."""
        if self.w is None:
            self.unpack()
        each = self.starts[at + 1] - self.starts[at]
        score = self._bounded(at, w, k, leave_out) if each.sum() > BOUNDED else None
        if score is None:
            score = self._scores(at, w, each)
        if leave_out >= 0:
            score[leave_out] = 0
        floor = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        found = np.flatnonzero(score >= max(floor, 1e-300))
        best = found[np.lexsort((found, -score[found]))][:k]
        return best, score[best]

    def vote(self, best: np.ndarray, cosine: np.ndarray, base: float) -> float:
        """Share of label 1 among the nearest; the square of the cosine and the example's sampling weight count."""
        v = cosine * cosine * self.weights[best]
        return float(((v * self.labels[best]).sum() + PRIOR_VOTES * base) / (v.sum() + PRIOR_VOTES))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted monotone regression by pooling: knots and values for ``np.interp``."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # [value, weight, least x, most x]
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([b, c, a, a])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            v, n, _, hi = pools.pop()
            u = pools[-1]
            u[0], u[1], u[3] = (u[0] * u[1] + v * n) / (u[1] + n), u[1] + n, hi
    knots, values = [], []
    for v, _, lo, hi in pools:
        knots += [lo, hi]
        values += [v, v]
    return np.array(knots), np.array(values)


class Model:
    """Vocabulary, idf, index and calibration, and the model over all terms for texts without a term of the vocabulary;
    ``score`` needs the text alone."""

    def __init__(self, places, idf, index, base, empty, knots, values, whole=None):
        self.places, self.idf, self.index, self.base, self.empty = places, idf, index, base, empty
        self.knots, self.values, self.whole = knots, values, whole

    def caches(self) -> tuple:
        """What a worker keeps for ``score``."""
        return _Terms(self.places), {}, self.whole.caches() if self.whole else None

    def score(self, texts: list, terms: _Terms, seen: dict, rest: tuple | None = None) -> list[tuple[float, list]]:
        """Score and evidence of each text (``split_texts``)."""
        if self.index is None:
            return self.whole.score(texts, *rest) if self.whole else [(self.empty, [])] * len(texts)
        out = [(self.empty, [])] * len(texts)
        bare = []
        for i, (at, counts) in enumerate(term_counts(texts, terms)):
            if not len(at):
                bare.append(i)
                continue
            key = hashlib.blake2b(at.tobytes() + counts.tobytes(), digest_size=16).digest()
            got = seen.get(key)
            if got is None:
                best, cosine = self.index.nearest(*_weighted(at, counts, self.idf), NEIGHBOURS)
                if len(best):
                    raw = self.index.vote(best, cosine, self.base)
                    evidence = [(self.index.ids[i], float(c), int(self.index.labels[i])) for i, c in zip(best[:5].tolist(), cosine, strict=False)]
                    got = float(np.clip(np.interp(raw, self.knots, self.values), 0, 1)), evidence
                else:
                    got = self.empty, []
                if len(seen) < RESULT_ENTRIES:
                    seen[key] = got
            out[i] = got
        if bare and self.whole:
            for i, got in zip(bare, self.whole.score([texts[i] for i in bare], *rest), strict=True):
                out[i] = got
        return out


def _selected(examples: DataFrame) -> list[str]:
    """Terms whose presence goes with a label, strongest first. Tasks send one row per term that they have seen."""
    def count(batches):
        tally: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(string_column(b, "text"), string_column(b, "label"), strict=True):
                for f in {f for w in set(_WORD.findall((t or "").lower())) for f in word_terms(w)}:
                    tally.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_pydict({"term": list(tally), "zeros": [v[0] for v in tally.values()], "ones": [v[1] for v in tally.values()]},
                                         schema=pa.schema([("term", pa.string()), ("zeros", pa.int64()), ("ones", pa.int64())]))

    total = {r.label: r.n for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return []
    rows = examples.select("text", "label").mapInArrow(count, "term string, zeros long, ones long").groupBy("term").agg(
        F.sum("zeros").cast("double").alias("a"), F.sum("ones").cast("double").alias("b")).where(F.col("a") + F.col("b") >= LEAST_EXAMPLES)

    def fit(k, n, p):
        def part(c, q):
            return F.when(c > 0, c * F.log(q)).otherwise(0.0)
        return part(k, p) + part(n - k, 1 - p)

    a, b = F.col("a"), F.col("b")
    both = (a + b) / (n0 + n1)
    ratio = 2 * (fit(a, F.lit(n0), a / n0) + fit(b, F.lit(n1), b / n1) - fit(a, F.lit(n0), both) - fit(b, F.lit(n1), both))
    rated = spool(rows.select("term", ratio.alias("ratio")), "terms")
    top = rated.where(F.col("ratio") >= LEAST_RATIO).coalesce(4).orderBy(F.desc("ratio"), "term").limit(VOCABULARY)
    return [r.term for r in top.collect()]


def _all_terms(examples: DataFrame) -> list[str]:
    """Every term of the examples, in order."""
    def terms(batches):
        found = {f for b in batches for t in string_column(b, "text") for w in set(_WORD.findall((t or "").lower())) for f in word_terms(w)}
        yield pa.RecordBatch.from_pydict({"term": list(found)}, schema=pa.schema([("term", pa.string())]))

    return sorted(examples.select("text").mapInArrow(terms, "term string").distinct().toArrow().column(0).to_pylist())


class _Units:
    """Unit vectors (terms, weights) of the examples ``use``, each made when it is asked for: all at once they are larger than
    the index."""

    def __init__(self, idf, starts, at, counts, use):
        self.idf = idf
        self.terms, self.counts = ([x[starts[i]:starts[i + 1]] for i in use] for x in (at, counts))
        self.lengths = [self._weights(i)[1] for i in range(len(self.terms))]

    def _weights(self, i: int) -> tuple:
        w = (1 + np.log(self.counts[i])) * self.idf[self.terms[i]]
        return w, np.sqrt((w * w).sum())

    def __len__(self) -> int:
        return len(self.terms)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        w, length = self._weights(i)
        return self.terms[i], w / length


def _fitted(places, idf, ids, labels, starts, at, counts, use, judged, weights, base, empty) -> Model:
    """Model over the examples ``use`` (rows of the flat terms and counts), calibrated on all of those in ``judged``."""
    units = _Units(idf, starts, at, counts, use)
    index = Index(units, labels[use], [ids[i] for i in use], len(idf), weights, (units.counts, units.lengths, idf))
    place = {x: i for i, x in enumerate(index.ids)}
    judged = set(judged)
    some = [(n, i) for n, i in enumerate(use) if i in judged]
    raw = np.array([index.vote(*index.nearest(*units[n], NEIGHBOURS, place[ids[i]]), base) for n, i in some])
    knots, values = isotonic(raw, np.array([float(labels[i]) for _, i in some]), np.array([weights[int(labels[i])] for _, i in some]))
    return Model(places, idf, index.pack(), base, empty, knots, values)


def _document_frequency(docs: DataFrame, places: dict[str, int], text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents that hold each term of the vocabulary: over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def count(batches):
        terms, df = _Terms(shared.value), np.zeros(len(shared.value) + 2, np.int64)
        for b in batches:
            for texts in split_texts(string_column(b, "text")):
                place, row = terms.found(texts)
                ends = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
                for a, e in zip(ends, ends[1:], strict=False):
                    df[place[a:e]] += 1  # a term that is there twice counts once
            df[-1] += b.num_rows
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used], pa.int64())], names=["term", "n"])

    df = np.zeros(len(places) + 2, np.int64)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_batches():
        df[r.column(0).to_numpy()] = r.column(1).to_numpy()
    shared.destroy()
    df[-2] = df[-1]  # every text has words
    return int(df[-1]), df[:-1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          examples: int = EXAMPLES) -> Model:
    """Index at most about ``examples`` labelled rows of each label (chosen by a hash of the id, equal
    texts once); idf is counted over all documents. Null labels and ids teach nothing; a document with several
    labels has the largest. Without examples of both labels every score is the base rate."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    total = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(0)
    for y, n in total.items():
        share = F.when(F.col("label") == y, int(min(1.0, examples / n) * 1e6)).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64(F.lit(9), F.col(id_col)), F.lit(1_000_000)) < share)
    # the sample is bounded by ``examples`` for each label
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen.select(F.col(id_col).alias("id"), "label")), "id")
    held = held.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min("id").alias("id"), F.first("text").alias("text")).select("id", "text", "label").persist()
    try:
        vocabulary = _selected(held)
        every = _all_terms(held)
        places = {t: i for i, t in enumerate(every)}
        del every
        shared = spark.sparkContext.broadcast(places)

        def vectors(batches):
            terms = _Terms(shared.value)
            for b in batches:
                counts = [c for texts in split_texts(string_column(b, "text")) for c in term_counts(texts, terms)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array([p for p, _ in counts], pa.list_(pa.int32())),
                     pa.array([n for _, n in counts], pa.list_(pa.int32()))], names=["id", "label", "terms", "counts"])

        kind = dict(held.dtypes)["id"]
        rows = held.mapInArrow(vectors, f"id {kind}, label int, terms array<int>, counts array<int>").orderBy("id").toArrow()
        shared.destroy()
    finally:
        held.unpersist()
    ids, labels_ = rows.column("id").to_pylist(), np.array(rows.column("label").to_pylist(), dtype=np.int64)
    lengths = np.concatenate([np.zeros(0, np.int64), *(np.diff(x.offsets.to_numpy()) for x in rows.column("terms").chunks)])
    # one copy of each, and the memory of the table back at once: the driver holds little
    flat = []
    for c in ("terms", "counts"):
        flat.append(np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in rows.column(c).chunks)]))
        rows = rows.drop_columns([c])
    at, counts = flat
    del rows
    pa.default_memory_pool().release_unused()
    sampled = Counter(labels_.tolist())
    weights = {y: total[y] / sampled[y] for y in sampled}
    base = total.get(1, 0) / max(1, sum(total.values()))
    if len(sampled) < 2 or not places:
        return Model({}, np.zeros(0), None, base, base, np.zeros(1), np.zeros(1))

    def share_of_ones(of):  # among the examples that a model has nothing to compare by
        return (sum(weights[1] for i in of if labels_[i]) + base) / (sum(weights[int(labels_[i])] for i in of) + 1)

    n, df = _document_frequency(docs, places, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # the vocabulary's terms, and the one for the length
    own = np.full(len(places) + 1, -1, np.int32)
    chosen_ = [*(places[t] for t in vocabulary), len(places)]
    own[chosen_] = np.arange(len(chosen_))
    kept = own[at] >= 0
    inside = np.concatenate([[0], np.cumsum(kept)])[starts]
    full = [i for i in range(len(ids)) if inside[i + 1] - inside[i] > 1]
    bare = [i for i in range(len(ids)) if inside[i + 1] - inside[i] <= 1]
    worded = [i for i in range(len(ids)) if lengths[i]]
    whole = _fitted(places, idf, ids, labels_, starts, at, counts, worded, [i for i in bare if lengths[i]] or worded, weights, base,
                    share_of_ones([i for i in bare if not lengths[i]]))
    if not full:
        return Model({}, np.zeros(0), None, base, whole.empty, np.zeros(1), np.zeros(1), whole)
    model = _fitted({t: i for i, t in enumerate(vocabulary)}, idf[chosen_], ids, labels_, inside, own[at[kept]], counts[kept], full, full, weights, base, whole.empty)
    model.whole = whole
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7,
          carry: tuple = ()) -> DataFrame:
    """Score every whole text: (id, score, predicted, evidence), one row per input row.

    ``score`` is between 0 and 1; ``predicted`` is 1 from ``threshold`` on; ``evidence`` has the five nearest
    examples (doc_id, similarity, label). Texts without a term of the vocabulary are scored by all
    terms of the examples; null, empty and other texts without any get the share of label 1 among such examples. Repeated rows and null ids stay; an empty table gives an empty result.
    With ``carry`` the named columns of the documents come instead of the id.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = share(spark, model)
    # examples are named by their ids: numbers as long, ids of any other type as text
    as_text = model.index is not None and any(not isinstance(i, int) for i in model.index.ids[:1])

    def judge(batch):
        model, caches = shared_value(shared, "toxicity", lambda model: (model, model.caches()))
        got = [g for texts in split_texts(string_column(batch, "text")) for g in model.score(texts, *caches)]
        flat = [e for g in got for e in g[1]]
        ids = pa.array([str(e[0]) for e in flat], pa.string()) if as_text else pa.array([e[0] for e in flat], pa.int64())
        evidence = pa.StructArray.from_arrays([ids, pa.array([e[1] for e in flat], pa.float64()), pa.array([e[2] for e in flat], pa.int32())],
                                              names=["doc_id", "similarity", "label"])
        ends = pa.array(np.cumsum([0, *(len(g[1]) for g in got)]), pa.int32())
        return {"score": pa.array([g[0] for g in got], pa.float64()),
                "predicted": pa.array([int(g[0] >= threshold) for g in got], pa.int32()),
                "evidence": pa.ListArray.from_arrays(ends, evidence)}

    return map_texts(docs, judge, "score double, predicted int, evidence array<struct<"
                     f"doc_id:{'string' if as_text else 'bigint'},similarity:double,label:int>>",
                     id_col, text_col, carry)


def train_on(docs: DataFrame, labels: DataFrame, fold: int = 3) -> Model:
    """Learn from the labels whose crc32(doc_id as text) mod ``fold`` is not 1."""
    return train(docs, labels.where(crc_remainder("doc_id", fold) != 1))
