"""A training corpus from raw documents: identify languages, drop toxic documents, keep one of each group of
near-duplicates, mix the sources to their target weights, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's documents. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm import language, mixing, packing, shingles, toxicity
from marquee.llm.common import broadcast_if_small, spool, table
from marquee.llm.queries import WORD_TOKENIZER, tokenizer_file

#: A decision per document is broadcast up to this many rows; beyond, the join is a shuffled one.
BROADCAST_ROWS = 2_000_000


def _judged(decisions: DataFrame, columns: list[str]) -> DataFrame:
    """The first len(columns) columns, which are the carried ones, under their own names."""
    kept = decisions.toDF(*[f"c{i}" for i in range(len(decisions.columns))])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language is found; texts that are null or have no letter go."""
    found = language.identify(docs, language.train_on(docs), carry=tuple(docs.columns))
    marked = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
    return _judged(marked.where(F.col(f"c{len(docs.columns)}") != "und"), docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score at least 0.7, learning from all labels of the documents it is given. Null and empty
    texts have the score of texts without a term; repeated rows and null ids are judged as any row. Without labels of both
    kinds every document has the base rate. An empty table gives an empty one; other columns may have any names."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, threshold=0.7, carry=tuple(docs.columns))
    marked = scored.toDF(*[f"c{i}" for i in range(len(scored.columns))])
    return _judged(marked.where(F.col(f"c{len(docs.columns) + 1}") == 0), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five words, similarity 0.8), and one
    row of each id: the one with the longest text, then the last text, then the last by a hash of the row, so that a rerun keeps
    the same. Rows without an id stay, and so do null and empty texts; an empty table gives an empty one. The columns
    may have any names."""
    groups = spool(shingles.near_duplicates(docs, words=5, percent=80), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(gone, BROADCAST_ROWS), "doc_id", "left_anti")
    repeated = spool(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    repeated = broadcast_if_small(repeated, BROADCAST_ROWS)
    # a rank limit: Spark keeps one row per id and task before the shuffle
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(docs.columns) if not dict(docs.dtypes)[c].startswith("map")])
    order = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), F.desc("text"), F.desc(hashed))
    rank = "_rank" + "_" * max(map(len, docs.columns))  # longer than any column's name
    once = kept.join(repeated, "doc_id", "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 rows); sources weigh 5, 2, 1, repeating, a null source the last.
    Documents without a word go. Rows of the same id (null included) are taken as often as the one taken most. An empty table gives
    an empty one; other columns may have any names."""
    mixed = mixing.mix(docs, weights=mixing.repeating((5, 2, 1)), repeats=3)
    copies = spool(mixed.groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").cast("int").alias("n")).where("n > 0"), "copies")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key = F.col(f"c{docs.columns.index('doc_id')}")
    taken = plain.join(broadcast_if_small(copies, BROADCAST_ROWS), key.eqNullSafe(F.col("id")))
    return _judged(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids. A null or empty text is the end id alone; repeated rows and null ids are packed
    as any row. An empty table gives an empty one; columns other than the id and the text are not read."""
    return packing.pack(docs, tokenizer_file(WORD_TOKENIZER).decode(), size=2048, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, hashes and tokenizers: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name)
    return docs
