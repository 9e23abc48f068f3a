"""Exact deduplication against a plain grouping."""

import hashlib
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from marquee.llm import exact
from marquee.llm.queries import ORACLE, QUERIES
from tests.conftest import SF001
from tests.llm.conftest import ODD

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), key is None, key if key is not None else 0, key))
    out = []
    for content, own in groups.items():
        own.sort(key=lambda r: r[:3])
        digest = hashlib.sha256(content.encode()).hexdigest()
        out += [(r[3], own[0][3], len(own), i == 0, digest) for i, r in enumerate(own)]
    return sorted(out, key=repr)


def got(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def rows_of(df, text="text"):
    return [(r.doc_id, r[text]) for r in df.select("doc_id", text).collect()]


def test_open_addressing_compares_whole_contents():
    table = exact.ContentTable(10)
    # one hash for all: only the contents tell them apart
    assert [table.find(5, c) for c in (b"aaaa", b"bbbb", b"aaaa", b"", b"bbbb")] == [0, 1, 0, 2, 1]
    assert table.find(5, b"ccc") == -1 and table.full
    assert table.find(5, b"d") == -1, "nothing enters a table that was full once"
    assert table.find(5, b"bbbb") == 1
    one = exact.ContentTable(1)
    assert one.find(7, b"longer than the room") == 0 and one.find(8, b"x") == -1
    many = exact.ContentTable(1 << 30)
    assert [many.find(i % 7, str(i).encode()) for i in range(5000)] == list(range(5000))
    assert [many.find(i % 7, str(i).encode()) for i in range(5000)] == list(range(5000))


def test_awkward_rows(spark, odd):
    assert got(exact.exact_duplicates(odd)) == brute((r[0], r[1]) for r in ODD)


def test_empty_table_and_text_ids(spark, empty, odd):
    out = exact.exact_duplicates(empty)
    assert out.count() == 0 and tuple(out.columns) == COLUMNS
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumnRenamed("text", "hash").withColumn("text", F.lit(1))
    assert got(exact.exact_duplicates(named, text_col="hash")) == brute(rows_of(named, "hash"))


def test_spilling_to_deeper_levels_loses_nothing(spark, monkeypatch):
    """Buckets that do not fit give the same rows over several levels; a third of all rows are one text."""
    levels = []
    kept = exact.spool
    monkeypatch.setattr(exact, "spool", lambda df, name: levels.append(name) or kept(df, name))
    texts = [f"text number {i % 18} " + f"pad{i % 18} " * 300 + " " * (i % 4) for i in range(40)] + ["the hot text" + " " * (i % 5) for i in range(20)]
    docs = spark.createDataFrame([(i * 7 % 60, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    assert got(exact.exact_duplicates(docs, bucket_bytes=2000, local_rows=60, least_buckets=2)) == brute(rows_of(docs))
    assert len(levels) > 1


def test_query_equals_oracle_and_brute_force(spark):
    docs = f"{SF001}/documents.parquet"
    mine = got(QUERIES["op11_exact_dedup"](spark, SF001))
    assert mine == brute(rows_of(spark.read.parquet(docs)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs}'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_exact_dedup']})").fetchall(), key=repr) == mine
