"""Adapters from the driver's parquet tables to the canonical tables.

The same definitions exist as SQL CTEs in ``marquee.plans.oracle`` so the
DuckDB oracle sees identical inputs. Each builder selects only the columns it
needs, so the parquet scans are pruned.

* ``reviews``   orders JOIN lineitem JOIN part: one rating per line item.
* ``catalogue`` part: one catalogue record per part.
* ``documents`` / ``labels`` / ``events`` / ``embeddings`` / ``pages``: as given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Source order of a rating: the whole line-item row (unique; the first four
# columns alone repeat at some scales).
SEQ_COLS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reviews_raw: username, title, year, rating, film_slug, item, rated_at, seq.

    Titles vary per line so that both resolution tiers and the unmatched path
    are exercised; ``seq`` is the source order (a unique struct).
    """
    li = table(spark, sf_dir, "lineitem").select(*SEQ_COLS)
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    j = li.join(od, li.l_orderkey == od.o_orderkey).join(pt, li.l_partkey == pt.p_partkey)
    ln = F.col("l_linenumber")
    title = (F.when(ln % 7 == 0, F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")")))
             .when(ln % 3 == 0, F.concat(F.upper("p_name"), F.lit(": "), F.col("p_brand")))
             .otherwise(F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"))))
    year = F.when((ln % 5 == 0) | (F.col("p_partkey") % 4 == 0), F.lit(None)) \
        .otherwise(F.lit(1940) + F.col("p_partkey") % 86).cast("int")
    return j.select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("username"),
        title.alias("title"),
        year.alias("year"),
        (F.lit(1) + F.col("l_quantity").cast("bigint") % 10).cast("int").alias("rating"),
        F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"),
                 (F.lit(1940) + F.col("p_partkey") % 86).cast("string")).alias("film_slug"),
        F.col("l_partkey").alias("item"),
        F.col("o_orderdate").alias("rated_at"),
        F.struct(*SEQ_COLS).alias("seq"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metadata_raw-like catalogue built from ``part``."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    yr = F.lit(1940) + k % 86
    return p.select(
        k.alias("tmdb_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("title"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(yr).cast("int").alias("year"),
        F.when(k % 8 == 0, F.lit(None)).otherwise(
            F.concat(yr.cast("string"), F.lit("-0"), (F.lit(1) + k % 9).cast("string"), F.lit("-15"))
        ).alias("release_date"),
        F.when(k % 11 == 0, F.lit(0)).otherwise(F.col("p_size") * 4).cast("int").alias("runtime"),
        F.when(k % 7 == 0, F.lit(0)).otherwise(
            F.floor(F.col("p_retailprice") * (F.lit(1) + k % 97))).cast("bigint").alias("budget"),
        F.when(k % 5 == 0, F.lit(0)).otherwise(
            F.floor(F.col("p_retailprice") * (k % 13) * 3)).cast("bigint").alias("revenue"),
        (F.col("p_size") / F.lit(5.0)).alias("popularity"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("l"), (k % 14).cast("string"))).alias("original_language"),
        F.array(F.col("p_type"), F.element_at(F.split("p_name", " "), 2)).alias("genres"),
        F.array(F.col("p_brand")).alias("directors"),
        F.array(F.element_at(F.split("p_name", " "), 1),
                F.concat(F.col("p_brand"), F.lit("-"), (F.col("p_size") % 7).cast("string")),
                F.concat(F.lit("n"), (k % 50).cast("string"))).alias("cast"),
        k.alias("seq"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """members: every customer, with the number of ratings they left."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey")
    per_cust = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey") \
        .agg(F.count(F.lit(1)).alias("n"))
    return c.join(per_cust, c.c_custkey == per_cust.o_custkey, "left").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("username"),
        F.col("c_name").alias("display_name"),
        F.coalesce(F.col("n"), F.lit(0)).cast("int").alias("num_reviews"),
    )
