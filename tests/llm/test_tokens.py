"""Token counts, token files and packing against the libraries themselves."""

import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marquee.llm import ans, binary, packing, tokens
from marquee.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, WORD_TOKENIZER, tokenizer_file
from tests.conftest import SF001
from tests.llm.conftest import ODD


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("encoder", "name"), [(tokens.ByteEncoder, BYTE_TOKENIZER), (tokens.PreTokenEncoder, BYTE_TOKENIZER), (tokens.WordEncoder, WORD_TOKENIZER)])
def test_cached_encoding_equals_the_library(encoder, name):
    whole, own = library(name), encoder(tokenizer_file(name).decode())
    texts = [r[1] or "" for r in ODD] + ["Don't  we'll 12 34\n\n\n x", "İ ſ ŉ Σας", "\x00 a\x00b", "à̧ \u0085", "'S 'LL x's",
                                            "don''t 's 've x'll. e² ¼½ ªº §5 3rd\xa0 x\x85\n y", " “it’s” — a…b ‐ ‧ ", "a\u2028b\u200bc ɐ", "\x1c a'd  \n b\t\tc"]
    for t in texts + texts:  # the second time from the cache
        assert own.ids(t) == array("I", whole(t)).tobytes()


def test_direct_pre_tokens_of_every_plain_character():
    whole, own = library(BYTE_TOKENIZER), tokens.PreTokenEncoder(tokenizer_file(BYTE_TOKENIZER).decode())
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2028)]):
        t = f"a{c}b {c}{c} 1{c}2  {c}'s {c}"
        assert own.ids(t) == array("I", whole(t)).tobytes(), hex(ord(c))


def test_cache_keeps_two_generations():
    class Upper(tokens.Cache):
        made = 0

        def make(self, key):
            self.made += 1
            return key.upper()

    c = Upper(2)
    assert [c[k] for k in "abcab"] == list("ABCAB")
    assert c.made == 3 and len(c) <= 2


def test_token_counts(spark, odd, empty):
    model = tokenizer_file(PIECE_TOKENIZER)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = tokens.count_tokens(odd, model, limit=5)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in ODD]
    expected = sorted(((*e, e[2] > 5) for e in expected), key=str)
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected
    assert tokens.count_tokens(empty, model).count() == 0


@pytest.mark.parametrize(("n", "symbols"), [(0, 4), (1, 4), (1023, 3), (1024, 1), (5000, 300), (300_000, 50_000)])
def test_entropy_coder_round_trip(n, symbols):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n) - 1, symbols - 1).astype(np.uint32)
    table = ans.Table(np.bincount(ids, minlength=symbols))
    block = ans.encode(ids, table)
    assert (ans.decode(block, table) == ids).all()
    if n > 200_000:
        width = ans.LANES * ans.CHECKPOINT_STEPS
        assert (ans.decode(block, table, 1, 1) == ids[width:2 * width]).all()
        assert (ans.decode(block, table, 2) == ids[2 * width:]).all()
    if n:
        damaged = bytearray(block)
        damaged[-1] ^= 1
        with pytest.raises(ValueError):
            ans.decode(bytes(damaged), table)


def test_token_files(spark, odd, empty):
    blocks, counts = binary.write_ids(odd, tokenizer_file(BYTE_TOKENIZER).decode(), end_id=0)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in binary.ids_digest(blocks, counts).collect())
    whole, at, expected = library(BYTE_TOKENIZER), 0, []
    for r in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(r[1]) + [0]
        expected.append((at, r[0], len(ids), crc(ids)))
        at += len(ids)
    assert got == expected
    raw = {r.start: bytes(r.ids) for r in binary.read_ids(blocks, counts).collect()}
    assert all(zlib.crc32(raw[s]) == c for s, _, _, c in expected)
    blocks, counts = binary.write_ids(empty, tokenizer_file(BYTE_TOKENIZER).decode())
    assert blocks.count() == 0 and binary.ids_digest(blocks, counts).count() == 0


def test_token_files_of_the_table(spark):
    from marquee.llm.queries import QUERIES
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_files"](spark, SF001).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    whole, at = library(BYTE_TOKENIZER), 0
    for d in sorted(docs):
        ids = whole(docs[d]) + [0]
        assert got[d] == (at, len(ids), crc(ids))
        at += len(ids)


def check_packing(rows, docs, size):
    whole = library(WORD_TOKENIZER)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for key, texts in docs.items():
        ids = whole(texts[0]) + [1]
        total += len(ids) * len(texts)
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[key])
        cuts = list(range(0, len(ids), size))
        assert pieces == sorted((s, len(ids[s:s + size]), crc(ids[s:s + size])) for s in cuts for _ in texts)
        assert all(r.doc_tokens == len(ids) for r in by_doc[key])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert len(rows) == sum(map(len, by_doc.values()))
    return total / (size * max(1, len(by_seq)))


def test_packing(spark, odd, empty):
    docs = defaultdict(list)
    for r in ODD:
        docs[r[0]].append(r[1])
    for size in (16, 2048):
        rows = packing.pack(odd, tokenizer_file(WORD_TOKENIZER).decode(), size=size).collect()
        check_packing(rows, docs, size)
    assert packing.pack(empty, tokenizer_file(WORD_TOKENIZER).decode()).count() == 0


def test_packing_of_the_table(spark):
    from marquee.llm.queries import QUERIES
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert check_packing(QUERIES["op3_packing"](spark, SF001).collect(), docs, 2048) > 0.95


def test_histogram_packing_places_every_piece_once():
    rng = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 257, 80), rng.integers(1, 4000, 80), strict=True)}
    patterns = packing.pack_histogram(counts, 256)
    placed = defaultdict(int)
    for slots, packs in patterns:
        assert sum(n * side for _, n, side in slots) <= 256 and packs > 0
        for _, n, side in slots:
            placed[n] += side * packs
    assert placed == counts
    used = sum(n * c for n, c in counts.items())
    assert used / (256 * sum(p for _, p in patterns)) > 0.95
    assert packing.pack_histogram({}, 8) == []


def test_ranks_split_one_hot_length(spark):
    pieces = spark.range(1000).selectExpr("id as doc_id", "0L as start", "5L as length", "0L as row")
    ranks = sorted(r["rank"] for r in packing.ranked(pieces, 8).collect())
    assert ranks == list(range(1000))
