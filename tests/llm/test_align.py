"""Alignment against the libraries' own encodings and a plain comparison of all ends."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

from marquee.llm import align
from marquee.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, QUERIES, tokenizer_file
from marquee.llm.tokens import BYTE_CHARS
from tests.conftest import SF001
from tests.llm.conftest import ODD

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["a <s> b</s> <unk> <0x41> <|endoftext|>x", "日本語 テキスト  ok", "▁under", "x" * 3000, " lead  and trail \n\n", "é́ combining 🤦🏼‍♂️ \u0000 end",
         "tab\tnew\r\nline\x0b\x0c\x1c\x85", "don't WON'T 12345 !!!???", "﻿bom", "ﬁ ligature", "a b　c", "🤦" * 400, "\n", " "]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_str(tokenizer_file(BYTE_TOKENIZER).decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_file(PIECE_TOKENIZER))
    byte_of = {c: n for n, c in BYTE_CHARS.items()}

    def tokens(text):
        if not text:
            return [], [], [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text)
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        raw = (" " + text).encode()
        return (ids_a, raw_a, ids_b, raw_b) if b"".join(raw_a) == raw == b"".join(raw_b) else ([], [], [], [])
    return tokens


def brute(rows, tokens):
    out, links, counts = [], [], Counter()
    for key, text in rows:
        ids_a, raw_a, ids_b, raw_b = tokens(text)
        end_a, end_b = list(accumulate(map(len, raw_a))), list(accumulate(map(len, raw_b)))
        cuts = sorted(set(end_a) & set(end_b))
        id_a, id_b = dict(zip(end_a, ids_a, strict=True)), dict(zip(end_b, ids_b, strict=True))
        own = [(id_a[c], id_b[c]) for c in cuts]
        group_a, group_b = defaultdict(list), defaultdict(list)
        for groups, ends, ids in ((group_a, end_a, ids_a), (group_b, end_b, ids_b)):
            for g, i in zip(np.searchsorted(np.array(cuts), np.array(ends)).tolist() if ends else [], ids, strict=True):
                groups[g].append(str(i))
        shown = ";".join(",".join(group_a[g]) + "|" + ",".join(group_b[g]) for g in range(len(cuts)))
        counts.update(own)
        links.append(own)
        out.append((key, len(ids_a), len(ids_b), len(cuts), len(own), hashlib.sha256(shown.encode()).hexdigest() if own else ""))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return sorted(((*o[:5], sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own), o[5]) for o, own in zip(out, links)), key=repr)


def run(docs):
    out = align.alignment(docs, tokenizer_file(BYTE_TOKENIZER).decode(), tokenizer_file(PIECE_TOKENIZER))
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


def test_shared_cuts_are_all_common_ends():
    rng = np.random.default_rng(1)
    for dense in (0.9, 0.3, 0.02):
        ends = [np.sort(rng.choice(np.arange(1, 400), size=max(1, int(400 * dense * f)), replace=False)) for f in (0.5, 0.6, 0.9, 0.2)]
        a, b, shift = [], [], 0
        a_of, b_of = [0], [0]
        for x, y in (ends[:2], ends[2:], (np.zeros(0, int), np.zeros(0, int)), (ends[0], ends[3])):
            if len(x):
                x, y = np.append(x, 400) + shift, np.append(y, 400) + shift
                shift += 400
            a.append(x)
            b.append(y)
            a_of.append(a_of[-1] + len(x))
            b_of.append(b_of[-1] + len(y))
        ea, eb = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        got = align.shared_cuts(ea, eb, np.array(a_of), np.array(b_of))
        assert ea[got].tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))


def test_awkward_rows(spark, odd, empty, library):
    rows = [(r[0], r[1]) for r in ODD] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, links string").coalesce(2)
    assert run(docs) == brute(rows, library)
    assert run(empty) == []
    shown = align.aligned(docs.where("doc_id = 6"), tokenizer_file(BYTE_TOKENIZER).decode(), tokenizer_file(PIECE_TOKENIZER), groups=True).first()
    assert hashlib.sha256(shown.groups.encode()).hexdigest() == shown.groups_sha256 and shown.groups.count(";") == shown.n_groups - 1


def test_links_have_the_bound_that_the_vocabularies_give(spark):
    a, b = align.byte_level_tokens(tokenizer_file(BYTE_TOKENIZER).decode()), align.piece_tokens(tokenizer_file(PIECE_TOKENIZER))
    assert align.pair_bound(a, b) < 1_000_000


def test_query_equals_brute_force(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    mine = sorted(map(tuple, QUERIES["op13_tokenizer_alignment"](spark, SF001).collect()), key=repr)
    assert mine == brute([(r.doc_id, r.text) for r in docs.collect()], library)
