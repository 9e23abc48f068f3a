"""Alignment of two tokenizers over the same bytes.

Both token sequences of a text cover the same bytes. A byte offset where tokens of both end is a shared cut; groups
lie between neighbouring cuts. Cuts are found by divide and conquer: in an interval, the ends of A are tried from the
middle outwards, each looked up among the ends of B by bisection; the first common end splits the interval in two,
and an interval without one is a leaf, that is a group. All intervals of a batch of texts are split side by side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import held, prepare, spool
from marquee.llm.tokens import BYTE_CHARS, CACHE_ENTRIES, SPACE_CHAR, ByteEncoder, Cache, spaced_pieces, string_column

#: Ends of A tried on each side of the middle for all intervals at once, before what is left is looked up whole.
PROBES = 3
#: Bits of a packed pair for the id of B.
B_BITS = 16


class PlainByteEncoder(ByteEncoder):
    """Byte-level BPE in which the strings of special tokens are plain text."""

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.special = ()
        self.entries = CACHE_ENTRIES * 2 // 3


class PieceEncoder(Cache):
    """piece of text -> packed little-endian 32-bit ids of a sentencepiece BPE model."""

    def __init__(self, model: bytes):
        import sentencepiece
        super().__init__(CACHE_ENTRIES * 2 // 3)
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode

    def make(self, piece: str) -> bytes:
        # the line break keeps the dummy prefix apart from the piece: two tokens that are not its own
        return np.array(self.encode("\n" + piece)[2:], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, spaced_pieces(text)))


def byte_level_tokens(tokenizer_json: str) -> list[bytes]:
    """Bytes of each id: its entry with every character decoded by the byte-level table."""
    from tokenizers import Tokenizer
    byte_of = {c: b for b, c in BYTE_CHARS.items()}
    byte_of[SPACE_CHAR] = 32
    vocab = Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return out


def piece_tokens(model: bytes) -> list[bytes]:
    """Bytes of each id: <0xHH> is a byte, U+2581 a space, anything else its UTF-8."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]


def pair_bound(a_bytes: list[bytes], b_bytes: list[bytes]) -> int:
    """How many different links two vocabularies can have: tokens that end together over the same bytes are equal or
    one is an end of the other, whatever the corpus."""
    ends = lambda own, other: sum(t[i:] in other for t in own for i in range(len(t)))
    return ends(set(a_bytes) - {b""}, set(b_bytes)) + ends(set(b_bytes) - {b""}, set(a_bytes))


def shared_cuts(ea: np.ndarray, eb: np.ndarray, a_of: np.ndarray, b_of: np.ndarray) -> np.ndarray:
    """Places in ``ea`` of all ends that are in ``eb`` too (both ascending). a_of and b_of: for each text the place
    where its ends begin, and one more at the end; the last ends of a text always meet."""
    found = [a_of[1:][a_of[1:] > a_of[:-1]] - 1]  # the common last end of each text
    filled = a_of[1:] > a_of[:-1]
    # interior ends of the intervals: [i0, i1) of A, [j0, j1) of B
    i0, i1, j0, j1 = a_of[:-1][filled], a_of[1:][filled] - 1, b_of[:-1][filled], b_of[1:][filled] - 1
    while True:
        open_ = (i1 > i0) & (j1 > j0)
        i0, i1, j0, j1 = i0[open_], i1[open_], j0[open_], j1[open_]
        if not len(i0):
            return np.sort(np.concatenate(found))
        cut = np.full(len(i0), -1)
        at = np.zeros(len(i0), np.int64)
        middle = (i0 + i1) >> 1
        todo = np.arange(len(i0))
        for step in range(2 * PROBES + 1):  # middle, then one to the right, one to the left, two to the right ...
            m = middle[todo] + ((step + 1) // 2 if step % 2 else -(step // 2))
            tried = (m >= i0[todo]) & (m < i1[todo])
            value = ea[np.where(tried, m, middle[todo])]
            j = np.searchsorted(eb, value)
            hit = tried & (eb[np.minimum(j, len(eb) - 1)] == value)
            cut[todo[hit]], at[todo[hit]] = m[hit], j[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        # no common end near the middle: the whole interval is looked up, and the nearest one taken
        for k in todo[(i1 - i0)[todo] > PROBES].tolist():
            own = ea[i0[k]:i1[k]]
            j = j0[k] + np.searchsorted(eb[j0[k]:j1[k]], own)
            hits = np.flatnonzero((j < j1[k]) & (eb[np.minimum(j, j1[k] - 1)] == own))
            if len(hits):
                best = hits[np.argmin(np.abs(hits + i0[k] - middle[k]))]
                cut[k], at[k] = i0[k] + best, j[best]
        split = cut >= 0
        i0, i1, j0, j1, cut, at = i0[split], i1[split], j0[split], j1[split], cut[split], at[split]
        found.append(cut)
        i0, i1, j0, j1 = (np.concatenate(x) for x in ((i0, cut + 1), (cut, i1), (j0, at + 1), (at, j1)))


class Aligner:
    """In a worker: texts to their tokens, groups and links."""

    def __init__(self, tokenizer_json: str, model: bytes):
        self.a, self.b = PlainByteEncoder(tokenizer_json), PieceEncoder(model)
        self.a_bytes, self.b_bytes = byte_level_tokens(tokenizer_json), piece_tokens(model)
        self.a_len = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], np.int64)
        n = len(self.a_bytes)
        #: how a token is printed: within its group, and as the last of A or B in it
        self.printed = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)]
        self.printed += [f"{i}," for i in range(len(self.b_bytes))] + [f"{i};" for i in range(len(self.b_bytes))]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, or none where either does not give back the bytes of a space and the text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        raw = (" " + text).encode()
        a, b = np.frombuffer(self.a.ids(" " + text), "<u4").astype(np.int64), np.frombuffer(self.b.ids(text), "<u4").astype(np.int64)
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw:
            return none, none
        return a, b

    def align(self, texts: list[str | None]) -> tuple[list[int], list[int], list[int], list[bytes], list[str]]:
        """Per text: tokens of A, tokens of B, groups, packed links (a << 16 | b), text of the groups."""
        ids = [self.tokens(t) for t in texts]
        n_a, n_b = np.array([len(a) for a, _ in ids], np.int64), np.array([len(b) for _, b in ids], np.int64)
        a_of, b_of = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        a, b = np.concatenate([x for x, _ in ids]), np.concatenate([x for _, x in ids])
        if not len(a):
            return n_a.tolist(), n_b.tolist(), [0] * len(texts), [b""] * len(texts), [""] * len(texts)
        ea, eb = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])  # equal bytes: the texts' offsets agree in both
        cut_a = shared_cuts(ea, eb, a_of, b_of)
        cut_b = np.searchsorted(eb, ea[cut_a])
        links = ((a[cut_a] << B_BITS) | b[cut_b]).astype("<u4")
        # print order: the A tokens of a group, then its B tokens
        size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        order = np.empty(len(a) + len(b), np.int64)
        first_a, last_b = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        code_a, code_b = a.copy(), b + 2 * len(self.a_bytes)
        code_a[cut_a] += len(self.a_bytes)
        code_b[cut_b] += len(self.b_bytes)
        order[np.arange(len(a)) + np.repeat(first_a, size_a)] = code_a
        order[np.arange(len(b)) + np.repeat(last_b, size_b)] = code_b
        g_of = np.searchsorted(cut_a, a_of)
        packed, shown = [], []
        for k in range(len(texts)):
            packed.append(links[g_of[k]:g_of[k + 1]].tobytes())
            shown.append("".join(map(self.printed.__getitem__, order[a_of[k] + b_of[k]:a_of[k + 1] + b_of[k + 1]].tolist()))[:-1])
        return n_a.tolist(), n_b.tolist(), np.diff(g_of).tolist(), packed, shown


def aligned(docs: DataFrame, tokenizer_json: str, model: bytes, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, links, groups_sha256): links are packed 32-bit pairs, one per shared cut; with
    ``groups`` the groups themselves (`a1,a2|b1;a3|b2,b3`) follow as text."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, model))

    def cut(batches):
        align = held("align", hash(shared.value), lambda: Aligner(*shared.value)).align
        for b in batches:
            texts = string_column(b, "text")
            parts, held_, size = [], [], 0
            for t in texts:  # long texts are aligned in small batches
                held_.append(t)
                size += len(t or "")
                if size > 1 << 20:
                    parts.append(align(held_))
                    held_, size = [], 0
            if held_:
                parts.append(align(held_))
            n_a, n_b, n_groups, links, shown = ([x for p in parts for x in p[i]] for i in range(5))
            shas = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
            columns = [b.column(b.schema.get_field_index("id")), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()),
                       pa.array(links, pa.binary()), pa.array(shas, pa.string()), *([pa.array(shown, pa.string())] if groups else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ddl = f"id {dict(src.dtypes)['id']}, n_a long, n_b long, n_groups long, links binary, groups_sha256 string" + (", groups string" if groups else "")
    names = [c.split()[0] for c in ddl.split(", ")]
    return src.mapInArrow(cut, ddl)


def pair_counts(links: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(pairs ascending, counts) over the corpus. A task sends one row per pair; the number of pairs has a bound that the
    two vocabularies give (``pair_bound``), so the counts may go through the driver."""
    def count(batches):
        pairs, counts = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        for b in batches:
            new, n = np.unique(np.frombuffer(b"".join(string_column(b, "links")), "<u4"), return_counts=True)
            pairs, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, place, np.concatenate([counts, n]))
            counts = total
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    found = links.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs, counts = found.column("pair").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(pairs)
    return pairs[order], counts[order]


def best_pairs(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its id of B."""
    top = np.zeros(1 << B_BITS, np.int64)
    np.maximum.at(top, pairs & ((1 << B_BITS) - 1), counts)
    return counts == top[pairs & ((1 << B_BITS) - 1)]


def alignment(docs: DataFrame, tokenizer_json: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment of a byte-level BPE (A, over a space and the text) with a sentencepiece BPE (B): (id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256), one row per input row.

    Links are the pairs of tokens that end at the same byte; a pair's count is how often it is linked in all rows.
    Texts are encoded and aligned once, into a written table; counts and sums read the packed links alone.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte (U+2581, say), have zeros
    and ''. Repeated rows and null ids stay and count like others; an empty table gives an empty result; other columns are not
    read; texts of any length are aligned whole. Ids of B need 16 bits.
    """
    spark = docs.sparkSession
    prepare(spark)
    done = spool(aligned(docs, tokenizer_json, model, id_col, text_col), "aligned")
    pairs, counts = pair_counts(done)
    shared = spark.sparkContext.broadcast((pairs, counts, best_pairs(pairs, counts)))

    def look_up(batches):
        pairs, counts, best = shared.value
        for b in batches:
            n_best, sums = [], []
            for raw in string_column(b, "links"):
                at = np.searchsorted(pairs, np.frombuffer(raw, "<u4"))
                n_best.append(int(best[at].sum()) if len(at) else 0)
                sums.append(int(counts[at].sum()) if len(at) else 0)
            keep = [b.column(b.schema.get_field_index(c)) for c in ("id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*keep, keep[3], pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()),
                                              b.column(b.schema.get_field_index("groups_sha256"))], names=names)

    ddl = f"id {dict(done.dtypes)['id']}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = [c.split()[0] for c in ddl.split(", ")]
    return done.mapInArrow(look_up, ddl).withColumnRenamed("id", id_col)
