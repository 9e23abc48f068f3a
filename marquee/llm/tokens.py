"""Token counts by a two-tier lookup, and cached library encoding for the other token operators.

Texts are cut at places that no token of the vocabulary crosses. The pieces repeat, so a worker
encodes each with the tokenizer library once and looks the rest up.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import held, prepare

#: A piece longer than this is encoded each time instead of being cached.
MAX_CACHED_CHARS = 48
#: Entries of each of the two generations of a worker's cache.
CACHE_ENTRIES = 700_000
#: Entries of the broadcast table of frequent pre-tokens: with MAX_CACHED_CHARS its size is bounded.
TABLE_ENTRIES = 32_768
#: Documents whose pre-tokens decide which are held as frequent (this affects speed only).
TABLE_DOCUMENTS = 4_096


def string_column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


class Cache(dict):
    """What ``make`` gives for each key, kept for two generations: when one is full it becomes the
    old one, and only what is asked for again moves back into the new one."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.old: dict = {}
        self.entries = entries

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > MAX_CACHED_CHARS:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


# ---- sentencepiece: number of tokens -------------------------------------------------------

_SPACED = re.compile(" +[^ \n]*|\n[^ \n]*")


def spaced_pieces(text: str) -> list[str]:
    """Pre-tokens of a sentencepiece BPE model with a dummy prefix: a run of word starts with what
    follows, or a line break with what follows. U+2581 is the model's own sign for a space."""
    return _SPACED.findall(" " + text.replace("▁", " ")) if text else []


class PieceLengths(Cache):
    """pre-token -> number of tokens: the broadcast table, then the library."""

    def __init__(self, model: bytes, frequent: dict[str, int]):
        import sentencepiece
        super().__init__()
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.frequent = frequent

    def make(self, piece: str) -> int:
        n = self.frequent.get(piece)
        # The line break keeps the dummy prefix apart from the piece: two tokens that are not its own.
        return len(self.encode("\n" + piece)) - 2 if n is None else n


def frequent_pieces(docs: DataFrame, text_col: str, entries: int, documents: int) -> list[str]:
    """The most frequent pre-tokens of about ``documents`` documents, most frequent first."""
    n = docs.count()
    sample = docs.select(text_col).sample(fraction=min(1.0, documents / max(1, n)), seed=7)

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in string_column(b, "text"):
                seen.update(p for p in spaced_pieces(t or "") if len(p) <= MAX_CACHED_CHARS)
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_pydict({"piece": [p for p, _ in top], "n": [c for _, c in top]},
                                         schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    counted = sample.select(F.col(text_col).alias("text")).mapInArrow(count, "piece string, n long")
    # the sample is bounded; few partitions, as each sends its own most frequent ones
    rows = counted.groupBy("piece").agg(F.sum("n").alias("n")).coalesce(4).orderBy(F.desc("n"), "piece").limit(entries).collect()
    return [r.piece for r in rows]


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 table_entries: int = TABLE_ENTRIES, table_documents: int = TABLE_DOCUMENTS) -> DataFrame:
    """Number of tokens of every whole text under a sentencepiece BPE model.

    Two tiers, both on the map side: a broadcast table of frequent pre-token lengths, then the
    worker's own cache over the library. Nothing is shuffled but the counts of the bounded sample
    that fills the table, and the result does not depend on that table.

    Returns (id, n_bytes, n_tokens, over_limit), one row per input row. Null text counts as empty:
    0 bytes, 0 tokens. Repeated rows and null ids stay, an empty table gives an empty result, other
    columns are not read. ``model`` is the content of the model file.
    """
    spark = docs.sparkSession
    prepare(spark)
    lengths = PieceLengths(model, {})
    frequent = {p: lengths[p] for p in frequent_pieces(docs, text_col, table_entries, table_documents)}
    shared = spark.sparkContext.broadcast((model, frequent))

    def measure(batches):
        # the table and cache serve any texts of this model
        length = held("lengths", hash(shared.value[0]), lambda: PieceLengths(*shared.value)).__getitem__
        for b in batches:
            n = [sum(map(length, spaced_pieces(t))) if t else 0 for t in string_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    kind = dict(src.dtypes)["id"]
    out = src.mapInArrow(measure, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


# ---- tokenizers: ids -----------------------------------------------------------------------

#: GPT-2's table of visible characters for bytes, by its rule.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_VISIBLE))}
SPACE_CHAR = BYTE_CHARS[32]

#: The pre-token patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def odd_space(text: str) -> bool:
    """Python counts these four as white space, the vocabularies' patterns do not. (Four plain searches are far
    faster than one by a pattern.)"""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def _packed(ids) -> bytes:
    return array("I", ids).tobytes()


class _Pieces(Cache):
    """piece of text -> packed little-endian 32-bit ids.

    A piece of Latin letters, digits and signs is cut by the vocabulary's own pattern, and a single pre-token goes to the
    library's model; every other piece goes through the whole library (normalisation, added tokens)."""

    def __init__(self, tokenizer_json: str, pattern: str, lower: bool):
        import os

        import regex
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model.tokenize
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.split, self.lower = regex.compile(pattern).findall, lower

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def make(self, piece: str) -> bytes:
        if not piece.isascii() and max(piece) >= "\u0250":
            return self.whole(piece)
        if self.lower and (low := piece.lower()) != piece and not any(s in piece for s in self.special):
            return self[low]
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            inner = word if piece.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
            return _packed([t.id for t in self.model(inner if word is piece else SPACE_CHAR + inner)])
        if any(s in piece for s in self.special):
            return self.whole(piece)
        parts = self.split(piece)
        if len(parts) == 1:
            return _packed([t.id for t in self.model(parts[0].encode().decode("latin-1").translate(BYTE_CHARS))])
        return b"".join(map(self.__getitem__, parts))

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def ids(self, text: str) -> bytes:
        """Packed ids of a whole text, as the library's ``encode`` gives them."""
        if odd_space(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.pieces(text)))


class ByteEncoder(_Pieces):
    """Byte-level BPE with GPT-2's pattern: a piece is a word with the one space before it, or white space."""

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json, BYTE_PATTERN, False)

    def pieces(self, text: str) -> list[str]:
        return _PIECE.findall(text)


#: The letters and numbers below U+0250, and what the direct pattern leaves to the general one besides Python's
#: odd spaces: everything above but the punctuation of U+2010 to U+2027.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_OTHER = re.compile("[\u0250-\u200f\u2028-\U0010ffff]")
_DIRECT = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")


class PreTokenEncoder(ByteEncoder):
    """As ByteEncoder, but texts of Latin letters and common punctuation are cut at once into the vocabulary's own
    pre-tokens: a word and the sign behind it are two entries that other words share, not one of their own."""

    def pieces(self, text: str) -> list[str]:
        other = odd_space(text) or (not text.isascii() and _OTHER.search(text))
        return super().pieces(text) if other else _DIRECT.findall(text)


class WordEncoder(_Pieces):
    """Lower-cased BPE with word ends: white space separates and is dropped."""

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json, WORD_PATTERN, True)
        self.entries = CACHE_ENTRIES // 2

    def pieces(self, text: str) -> list[str]:
        return text.split()


def worker_encoder(kind: type, shared) -> _Pieces:
    """The worker's encoder of this kind over the broadcast tokenizer file (kept between tasks)."""
    text = shared.value
    return held(kind.__name__, hash(text), lambda: kind(text))
