"""Language identification by a byte convolutional network, trained here in numpy.

A text is its UTF-8 bytes (lower-cased), cut into windows of fixed length. Filters of several widths run
over the bytes of a window; each filter keeps its largest response; a softmax layer reads those. A filter of
width w over one-hot bytes is w tables of 256 rows, so a response is a sum of w table rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import crc_remainder, map_texts, prepare, share, shared_value
from marquee.llm.tokens import string_column

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Documents that the classifier is fitted on, for each language: a documented bound.
TRAIN_DOCUMENTS = 1200
#: Windows from each of these documents.
TRAIN_WINDOWS = 3
#: Windows that pass through the network at once.
CHUNK = 256


class ByteNet:
    """Multi-width byte filters, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.tables:
            t[:, 0, :] = 0  # byte 0 pads
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def pooled(self, x: np.ndarray, where: bool = False):
        """Largest response of each filter in each window, and with ``where`` its place."""
        best, places = [], []
        for w, t in zip(WIDTHS, self.tables, strict=True):
            n = x.shape[1] - w + 1
            r = t[0][x[:, :n]]
            for j in range(1, w):
                r += t[j][x[:, j:j + n]]
            if where:
                p = r.argmax(axis=1)
                places.append(p)
                best.append(np.take_along_axis(r, p[:, None, :], axis=1)[:, 0, :])
            else:
                best.append(r.max(axis=1))
        h = np.concatenate(best, axis=1) + self.bias
        return np.maximum(h, 0), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h, _ = self.pooled(x)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> "ByteNet":
        """Adam on the cross entropy; the gradient of a pooled response goes to the bytes at its place."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                rows = order[at:at + batch]
                xb = x[rows].copy()
                # shorter windows too: half of them lose their end
                for i, keep in zip(range(0, len(xb), 2), rng.integers(12, xb.shape[1], len(xb)), strict=False):
                    xb[i, keep:] = 0
                h, places = self.pooled(xb, where=True)
                z = h @ self.out + self.out_bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(len(rows)), y[rows]] -= 1
                d /= len(rows)
                dh = (d @ self.out.T) * (h > 0)
                grads = []
                f = np.arange(FILTERS)
                for k, (w, t) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                    g = np.zeros_like(t)
                    part = dh[:, k * FILTERS:(k + 1) * FILTERS]
                    for j in range(w):
                        seen = np.take_along_axis(xb, places[k] + j, axis=1)
                        np.add.at(g[j], (seen, f[None, :]), part)
                    g[:, 0, :] = 0
                    grads.append(g)
                grads += [dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self


def windows(text: str) -> np.ndarray:
    """All bytes of the lower-cased text as rows of WINDOW bytes, the last one padded with 0."""
    raw = text.lower().encode()
    raw += b"\0" * (-len(raw) % WINDOW)
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(labelled: DataFrame, text_col: str, label_col: str, id_col: str, documents: int = TRAIN_DOCUMENTS) -> ByteNet | None:
    """Fit on about ``documents`` rows of each language, chosen by a hash of the id. Texts are cut in the
    tasks: the driver gets TRAIN_WINDOWS windows of each, spread over the whole text. None without labels."""
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}
    if not counts:
        return None
    classes = sorted(counts)
    share = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(int(min(1.0, documents / counts[c]) * 1e6)))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1_000_000)) < share[F.col(label_col)])

    def cut(batches):
        for b in batches:
            out, lang = [], []
            for t, c in zip(string_column(b, "text"), string_column(b, "lang"), strict=True):
                if has_letter(t):
                    w = windows(t)
                    for i in sorted({k * len(w) // TRAIN_WINDOWS for k in range(TRAIN_WINDOWS)}):
                        out.append(w[i].tobytes())
                        lang.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(lang, pa.string())], names=["bytes", "lang"])

    rows = sorted((r.lang, bytes(r.bytes)) for r in chosen.select(F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
                  .mapInArrow(cut, "bytes binary, lang string").collect())
    if not rows:
        return None
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([classes.index(r[0]) for r in rows])
    return ByteNet(classes).fit(x, y)


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """Predict the language of every whole text: (id, lang_pred, score), one row per input row.

    The score is the mean probability of the predicted language over all windows of the text. Null texts and texts
    without a letter are ``und`` with score 0, and so is everything without a trained net. Very long texts go through the
    network in chunks. Repeated rows and null ids stay; an empty table gives an empty result. With ``carry`` the named
    columns of the documents come instead of the id.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = share(spark, net)

    def predict(batch):
        net = shared_value(shared, "language")
        lang, score, held, owner = [], [], [], []
        texts = string_column(batch, "text")
        sums = None if net is None else np.zeros((len(texts), len(net.classes)))
        for i, t in enumerate(texts):
            if net is not None and has_letter(t):
                held.append(windows(t))
                owner.append(np.full(len(held[-1]), i))
        if held:
            x, own = np.concatenate(held), np.concatenate(owner)
            for at in range(0, len(x), CHUNK):
                np.add.at(sums, own[at:at + CHUNK], net.probabilities(x[at:at + CHUNK]))
        for i in range(len(texts)):
            n = 0 if sums is None else sums[i].sum()
            best = int(sums[i].argmax()) if n else None
            lang.append("und" if best is None else net.classes[best])
            score.append(0.0 if best is None else min(1.0, float(sums[i][best] / n)))
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    return map_texts(docs, predict, "lang_pred string, score double", id_col, text_col, carry)


def train_on(docs: DataFrame, fold: int = 5) -> ByteNet | None:
    """Fit on the documents whose crc32(doc_id as text) mod ``fold`` is not 0 and whose lang is known."""
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_remainder("doc_id", fold) != 0))
    return train(known, "text", "lang", "doc_id")
