"""Mixing by flow and preference formatting."""

import itertools
import re
from collections import defaultdict

import duckdb
import pytest

from marquee.llm import chat, mixing
from marquee.llm.queries import ORACLE, QUERIES
from tests.conftest import SF001
from tests.llm.conftest import ODD
from tools.compare import digest


def test_shares_are_capped_and_reshared():
    assert mixing.shares({"a": 10, "b": 10, "c": 100}, {"a": 5, "b": 2, "c": 1}, 3) == {"a": 30.0, "b": 30.0, "c": 60.0}
    assert mixing.shares({"a": 0}, {"a": 1}, 3) == {"a": 0.0}
    assert mixing.shares({}, {}, 3) == {}


def test_flow_prefers_fresh_words_and_is_optimal():
    capacity = {("a",): 4, ("a", "b"): 4, ("b",): 2}
    quota = {"a": 7, "b": 5}
    flow = mixing.route(capacity, quota, 3)
    sent = {p: sum(f.values()) for p, f in flow.items()}
    assert sum(sent.values()) == 12
    assert {s: sum(f.get(s, 0) for f in flow.values()) for s in quota} == quota
    price = lambda n, c: sum(r * r * min(c, max(0, n - r * c)) for r in range(3))
    best = min(price(x, 4) + price(12 - x - z, 4) + price(z, 2) for x, z in itertools.product(range(8), range(6))
               if 0 <= 12 - x - z <= 12 and 7 - x + 5 - z == 12 - x - z)
    assert sum(price(n, capacity[p]) for p, n in sent.items()) == best


def test_mixing(spark, odd, empty):
    rows = mixing.mix(odd, mixing.repeating()).collect()
    assert len(rows) == len(ODD)
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ODD}
    for r in rows:
        assert r.size == sizes[r.doc_id] and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(7), mixing.repeating()).collect()))
    assert mixing.mix(empty, mixing.repeating()).count() == 0


def test_mixing_of_the_table(spark):
    rows = QUERIES["op5_mixing"](spark, SF001).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    weights = dict(zip(sorted(size), itertools.cycle((5, 2, 1))))
    expected = mixing.shares(size, weights, 3)
    for s in size:
        assert abs(target[s] - expected[s]) < 1e-6
    assert abs(sum(taken.values()) - sum(size.values())) < 0.1 * sum(size.values())


def test_mixing_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), ["a"] if i % 3 else ["a", "b"]) for i in range(300)], "doc_id long, text string, tags array<string>")
    rows = mixing.mix(docs, lambda s: [1] * len(s), sources="tags").collect()
    assert len(rows) == 300 and {tuple(r.sources) for r in rows} == {("a",), ("a", "b")}
    assert max(r.copies for r in rows) <= 3


def test_sources_that_overlap_with_none_need_no_flow(monkeypatch):
    capacity = {("a",): 100, ("b",): 7, (None,): 0, ("c", "d"): 50, ("d",): 20}
    quota = {"a": 130, "b": 40, None: 0, "c": 60, "d": 60}
    split, whole = mixing.routed(capacity, quota, 3), mixing.route(capacity, quota, 3)
    assert {p: sum(f.values()) for p, f in split.items()} == {p: sum(f.values()) for p, f in whole.items()}
    assert split[("a",)] == {"a": 130} and split[("b",)] == {"b": 21} and split[(None,)] == {}
    many = {(i,): i for i in range(300_000)}
    assert sum(sum(f.values()) for f in mixing.routed(many, {i: 2 * i for i in range(300_000)}, 3).values()) == 2 * sum(range(300_000))
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    assert mixing.routed({("a",): 1, ("b",): 1}, {"a": 1, "b": 1}, 3)
    with pytest.raises(ValueError):
        mixing.routed(capacity, quota, 3)


def test_one_hot_source_is_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 16)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 3 else "b") for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, lambda s: [1] * len(s)).collect()
    for s in ("a", "b"):
        own = [r for r in rows if r.sources == [s]]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2


def first_fit(sizes, want):
    """Words taken by going through ``sizes`` in order, and by one more where it comes nearer."""
    gap, passed = want, []
    for n in sizes:
        gap, passed = (gap - n, passed) if n <= gap else (gap, [*passed, n])
    least = min((n for n in passed if n), default=0)
    return want - gap + (least if least and least - gap < gap else 0)


@pytest.mark.parametrize("slice_rows", [4096, 16, 2])
def test_a_long_document_does_not_end_a_source(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    order = spark.range(100).selectExpr("id", "xxhash64(11, id) o").orderBy("o").collect()
    long = order[10].id
    sizes = {i: 12_000 if i == long else 100 for i in range(100)}
    docs = spark.createDataFrame([(i, n, "a") for i, n in sizes.items()] + [(1000 + i, 1 + i % 7, "b") for i in range(200)], "doc_id long, n int, source string") \
        .selectExpr("doc_id", "repeat('w ', n) text", "source")
    # source a is to give 6,000 of its 21,900 words
    total = 21_900 + sum(1 + i % 7 for i in range(200))
    rows = mixing.mix(docs, lambda s: [6000 / total, 1 - 6000 / total], repeats=1000).collect()
    own = {r.doc_id: r for r in rows if r.sources == ["a"]}
    assert sum(r.taken for r in own.values()) == 6000 == first_fit([sizes[r.id] for r in order], 6000)
    assert {d for d, r in own.items() if r.copies} == {r.id for r in [*order[:10], *order[11:61]]}


def test_choice_is_the_same_for_any_slices(spark, monkeypatch):
    sizes = {i: 1 + (i * i * 7919) % 997 for i in range(600)}
    texts = spark.createDataFrame([(i, n, "a" if i % 4 else "b") for i, n in sizes.items()], "id long, size long, pattern string")
    sized = texts.selectExpr("id", "size", "pattern", "xxhash64(11, id) `order`", "id row")
    order = [r.id for r in sized.orderBy("order").collect()]
    wanted = spark.createDataFrame([("a", 100_003, 450), ("b", 5_001, 150)], "pattern string, want long, rows long")
    for slice_rows in (4096, 64, 8):
        monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
        rows = mixing.choose(sized, wanted).collect()
        assert len(rows) == 600
        for p, want in (("a", 100_003), ("b", 5_001)):
            got = sum(r.size for r in rows if r.pattern == p and r.chosen)
            assert got == first_fit([sizes[i] for i in order if ("a" if i % 4 else "b") == p], want)


CONV = "conv_id long, turn long, role string, text string"


def test_preferences(spark):
    chosen = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", "A"),
                                    (2, 0, "user", "q"), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, None, None)], CONV)
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", "BB"), (1, 4, "assistant", ""),
                                      (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "x")], CONV)
    got = {r.conv_id: r for r in chat.format_preferences(chosen.withColumn("key", chosen.turn), rejected).collect()}
    a = got[1]
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert a.prompt_turns == 3 and a.prompt == turn("user", "hi") + turn("assistant", "yo") + turn("user", "")
    assert a.chosen == turn("assistant", "A") and a.rejected == turn("assistant", "BB") + turn("assistant", "")
    assert [a.chosen[s.start:s.end] for s in a.chosen_spans] == ["A<|im_end|>\n"]
    assert [a.rejected[s.start:s.end] for s in a.rejected_spans] == ["BB<|im_end|>\n", "<|im_end|>\n"]
    assert (got[2].prompt_turns, got[2].prompt, got[2].chosen, got[2].rejected) == (0, "", turn("user", "q"), "")
    assert (got[3].prompt_turns, got[3].chosen, got[3].rejected, got[3].chosen_spans) == (2, "", "", [])
    assert (got[4].prompt, got[4].chosen) == ("", "") and len(got[4].rejected_spans) == 1
    assert got[None].chosen == turn("", "")
    assert chat.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0


def test_preferences_are_native_and_equal_the_oracle(spark):
    df = QUERIES["op8_chat_formatting"](spark, SF001)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF001}/conversations.parquet')")
    res = con.execute(ORACLE["op8_chat_formatting"])
    rows, cols = res.fetchall(), [d[0] for d in res.description]
    own = [tuple(r) for r in df.collect()]
    assert len(rows) == len(own) and digest(df.columns, own) == digest(cols, rows)
