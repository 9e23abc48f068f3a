"""Queries: feature engineering."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marquee.functions.vector import r6
from marquee.operators import features as FE
from marquee.plans.oracle_views import with_views
from marquee.plans.registry import query
from marquee.session import materialise
from marquee.sources import views as V

CAT = with_views("catalogue")


def _w(df):
    return df.select("tmdb_id", "family", "feature", r6("weight").alias("weight"))


DECADE_SQL = """
SELECT tmdb_id, 'decade' AS family, 'decade_' || CASE WHEN year < 1950 THEN 'Pre-1950' WHEN year >= 2020 THEN '2020s'
       ELSE CAST(CAST(floor(year / 10) * 10 AS INTEGER) AS VARCHAR) || 's' END AS feature, CAST(1.0 AS DOUBLE) AS weight
FROM catalogue WHERE year IS NOT NULL
"""


@query("decade", CAT + DECADE_SQL)
def q_decade(spark, sf):
    return _w(FE.decade_features(V.catalogue(spark, sf)))


RUNTIME_SQL = """
SELECT tmdb_id, 'runtime' AS family,
       'runtime_' || CASE WHEN runtime <= q[1] THEN 'Q1' WHEN runtime <= q[2] THEN 'Q2'
                          WHEN runtime <= q[3] THEN 'Q3' ELSE 'Q4' END AS feature, CAST(1.0 AS DOUBLE) AS weight
FROM catalogue, (SELECT quantile_cont(CAST(runtime AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM catalogue WHERE runtime > 0)
WHERE runtime > 0
"""


@query("runtime_quartile", CAT + RUNTIME_SQL)
def q_runtime_quartile(spark, sf):
    return _w(FE.runtime_quartile_features(V.catalogue(spark, sf)))


def _multihot_sql(col: str, n: int, prefix: str) -> str:
    c = f'"{col}"'
    return f"""
SELECT DISTINCT c.tmdb_id, '{prefix}' AS family, '{prefix}_' || e.el AS feature, CAST(1.0 AS DOUBLE) AS weight
FROM (SELECT tmdb_id, unnest({c}) AS el FROM catalogue) e JOIN catalogue c ON c.tmdb_id = e.tmdb_id
WHERE e.el IN (
  SELECT value FROM (
    SELECT u.value, count(*) AS n, min((seq, u.pos - 1)) AS first
    FROM catalogue, unnest({c}) WITH ORDINALITY AS u(value, pos) GROUP BY u.value)
  ORDER BY n DESC, first LIMIT {n})
"""


MULTIHOT = [("directors", 200, "director"), ("cast", 500, "cast"), ("genres", 19, "genre")]


@query("multihot_topn", CAT + " UNION ALL ".join(_multihot_sql(*m) for m in MULTIHOT))
def q_multihot_topn(spark, sf):
    cat = V.catalogue(spark, sf)
    out = None
    for col, n, prefix in MULTIHOT:
        part = FE.multihot_features(cat, col, n, prefix)
        out = part if out is None else out.unionByName(part)
    return _w(out)


def _money_sql(col: str) -> str:
    lg = f"ln(1 + CAST(CASE WHEN {col} > 0 THEN {col} ELSE 0 END AS DOUBLE))"
    return f"""
SELECT tmdb_id, '{col}' AS family,
       '{col}_' || CASE WHEN {col} IS NULL OR {col} <= 0 THEN 'Zero' WHEN {lg} <= q[1] THEN 'Low'
                         WHEN {lg} <= q[2] THEN 'Medium' WHEN {lg} <= q[3] THEN 'High' ELSE 'VeryHigh' END AS feature,
       CAST(1.0 AS DOUBLE) AS weight
FROM catalogue, (SELECT quantile_cont({lg}, [0.25, 0.5, 0.75]) AS q FROM catalogue WHERE {col} > 0)
"""


@query("log_bucket", CAT + _money_sql("budget") + " UNION ALL " + _money_sql("revenue"))
def q_log_bucket(spark, sf):
    cat = V.catalogue(spark, sf)
    return _w(FE.money_bucket_features(cat, "budget", "budget")
              .unionByName(FE.money_bucket_features(cat, "revenue", "revenue")))


POP_SQL = """
SELECT tmdb_id, 'popularity' AS family,
       'popularity_' || CASE WHEN popularity <= 1 THEN 'Low' WHEN popularity <= 5 THEN 'Medium' ELSE 'High' END AS feature,
       CAST(1.0 AS DOUBLE) AS weight FROM catalogue WHERE popularity IS NOT NULL
"""


@query("popularity_tier", CAT + POP_SQL)
def q_popularity_tier(spark, sf):
    return _w(FE.popularity_features(V.catalogue(spark, sf)))


LANG_SQL = """
SELECT c.tmdb_id, 'language' AS family, 'language_' || coalesce(t.value, 'Other') AS feature, CAST(1.0 AS DOUBLE) AS weight
FROM catalogue c LEFT JOIN (
  SELECT original_language AS value FROM catalogue WHERE original_language IS NOT NULL
  GROUP BY original_language ORDER BY count(*) DESC, min(seq) LIMIT 10) t ON c.original_language = t.value
WHERE c.original_language IS NOT NULL
"""


@query("language_topn", CAT + LANG_SQL)
def q_language_topn(spark, sf):
    return _w(FE.language_features(V.catalogue(spark, sf)))


def _keyword_sql() -> str:
    """F7 over the catalogue's keywords (the joined names of cast and genres): 1000 terms, L2-normalised rows."""
    return """
SELECT * FROM (
  WITH d AS (SELECT tmdb_id AS doc, coalesce(array_to_string("cast", ' '), '') || ' ' || coalesce(array_to_string(genres, ' '), '') AS t FROM catalogue)
  , n AS (SELECT count(*) AS n FROM d)
  , tok AS (SELECT doc, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) AS term FROM d)
  , tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY doc, term)
  , st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 1000)
  , w AS (SELECT tf.doc, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + st.df)) + 1.0) AS w FROM tf JOIN st ON tf.term = st.term, n)
  SELECT doc AS tmdb_id, 'keyword' AS family, 'keyword_tfidf_' || term AS feature,
         w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM w)
"""


def keywords(cat):
    """(tmdb_id, text): the keyword text of each catalogue row."""
    from marquee.functions.text import list_to_text
    return cat.select("tmdb_id", F.concat(list_to_text("cast"), F.lit(" "), list_to_text("genres")).alias("text"))


#: Every feature family (F1-F8), as one union; weights not rounded.
ALL_SQL = " UNION ALL ".join([DECADE_SQL, RUNTIME_SQL] + [_multihot_sql(*m) for m in MULTIHOT] +
                             [_money_sql("budget"), _money_sql("revenue"), LANG_SQL, POP_SQL, _keyword_sql()])


def all_features(cat):
    return FE.item_features(cat, keywords(cat))


ROUNDED = "SELECT tmdb_id, family, feature, CAST(round(weight, 6) AS DOUBLE) AS weight FROM ("


@query("item_features", CAT + ROUNDED + ALL_SQL + ")")
def q_item_features(spark, sf):
    return _w(all_features(V.catalogue(spark, sf)))


@query("feature_counts", CAT + f", f AS ({ALL_SQL}) SELECT family, count(DISTINCT feature) AS n_features FROM f GROUP BY family")
def q_feature_counts(spark, sf):
    return FE.feature_counts(all_features(V.catalogue(spark, sf)))


TFIDF_SQL = """
WITH d AS (SELECT doc_id AS doc, coalesce(text, '') AS t FROM documents)
, n AS (SELECT count(*) AS n FROM d)
, tok AS (SELECT doc, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) AS term FROM d)
, tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY doc, term)
, st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 1000)
, w AS (SELECT tf.doc, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + st.df)) + 1.0) AS w
        FROM tf JOIN st ON tf.term = st.term, n)
SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM w
"""


@query("tfidf", TFIDF_SQL)
def q_tfidf(spark, sf):
    out = FE.tfidf(V.documents(spark, sf), "doc_id", "text", 1000)
    return out.select("doc", "term", r6("weight").alias("weight"))


@query("mode_scaling", with_views("reviews", "catalogue") + """
, items AS (SELECT DISTINCT item AS tmdb_id FROM reviews)
, f AS (""" + ALL_SQL + """)
SELECT tmdb_id, family, feature, CAST(round(weight * 0.5, 6) AS DOUBLE) AS weight FROM f WHERE tmdb_id IN (SELECT tmdb_id FROM items)
UNION ALL
SELECT tmdb_id, 'id', 'id:' || CAST(tmdb_id AS VARCHAR), CAST(2.0 AS DOUBLE) FROM items
""")
def q_mode_scaling(spark, sf):
    feats = all_features(V.catalogue(spark, sf))
    items = V.reviews(spark, sf).select(F.col("item").alias("tmdb_id"))
    return _w(FE.mode_scaling(feats, items, "hybrid"))


def _split_sql(col: str, k: int) -> str:
    c = f'"{col}"'
    return f"""
SELECT c.tmdb_id,
  coalesce((SELECT list(e.el ORDER BY e.pos) FROM (SELECT u.el, u.pos FROM unnest(c.{c}) WITH ORDINALITY AS u(el, pos)) e
            JOIN fr ON fr.el = e.el WHERE fr.n >= {k}), []) AS {col}_main,
  coalesce((SELECT list(e.el ORDER BY e.pos) FROM (SELECT u.el, u.pos FROM unnest(c.{c}) WITH ORDINALITY AS u(el, pos)) e
            JOIN fr ON fr.el = e.el WHERE fr.n < {k}), []) AS {col}_other
FROM catalogue c
"""


SPLIT_CTES = """
, fc AS (SELECT el, count(*) AS n FROM (SELECT unnest("cast") AS el FROM catalogue) GROUP BY el)
, fd AS (SELECT el, count(*) AS n FROM (SELECT unnest(directors) AS el FROM catalogue) GROUP BY el)
, a AS (""" + _split_sql("cast", 5).replace("fr", "fc") + "), b AS (" + _split_sql("directors", 3).replace("fr", "fd") + ")"


@query("main_other_split", CAT + SPLIT_CTES + """
SELECT a.tmdb_id, cast_main, cast_other, directors_main, directors_other FROM a JOIN b ON a.tmdb_id = b.tmdb_id
""")
def q_main_other_split(spark, sf):
    """cast members with at least 5 appearances and directors with at least 3, and the others."""
    cat = V.catalogue(spark, sf)
    return FE.main_other_split(cat, "cast", 5).join(FE.main_other_split(cat, "directors", 3), "tmdb_id")


@query("rare_group", CAT + """
, c2 AS (SELECT tmdb_id, CASE WHEN tmdb_id % 97 = 0 THEN 'r' || (tmdb_id // 97) % 400 ELSE original_language END AS original_language FROM catalogue)
, cnt AS (SELECT original_language AS l FROM c2 WHERE original_language IS NOT NULL
          GROUP BY original_language HAVING count(*) >= 10)
SELECT c.tmdb_id, CASE WHEN cnt.l IS NOT NULL THEN c.original_language ELSE 'other' END AS language_group
FROM c2 c LEFT JOIN cnt ON c.original_language = cnt.l
""")
def q_rare_group(spark, sf):
    """one row in 97 gets one of 400 rare languages; rare ones and nulls become 'other'."""
    k = F.col("tmdb_id")
    rare = F.concat(F.lit("r"), (F.floor(k / 97) % 400).cast("string"))
    cat = V.catalogue(spark, sf).withColumn("original_language", F.when(k % 97 == 0, rare).otherwise(F.col("original_language")))
    return FE.rare_group_language(cat, 10)


@query("fixed_genre", CAT + "SELECT tmdb_id, " + ", ".join(
    f"CASE WHEN tmdb_id % {len(FE.FIXED_GENRES) + 2} IN ({i}, {i + 1}) THEN 1 ELSE 0 END AS genre_{g.lower().replace('-', '_')}"
    for i, g in enumerate(FE.FIXED_GENRES)) + """,
  CASE WHEN coalesce(len(directors), 0) > 0 THEN 1 ELSE 0 END AS has_known_director,
  CASE WHEN coalesce(len("cast"), 0) > 0 THEN 1 ELSE 0 END AS has_known_cast,
  coalesce(CAST(year AS DOUBLE), 2000.0) AS year, CASE WHEN tmdb_id % 6 = 0 THEN 6.0 ELSE tmdb_id % 91 / 10.0 END AS vote_average,
  coalesce(CAST(popularity AS DOUBLE), 1.0) AS popularity
FROM catalogue
""")
def q_fixed_genre(spark, sf):
    """rows have none, one or two of the fixed genres besides their own; every sixth has no vote average."""
    named = F.array(*map(F.lit, FE.FIXED_GENRES))
    at = F.col("tmdb_id") % (len(FE.FIXED_GENRES) + 2)
    two = F.filter(named, lambda g, i: (i == at) | (i + 1 == at))
    cat = V.catalogue(spark, sf).withColumn("vote_average", F.when(F.col("tmdb_id") % 6 != 0, F.col("tmdb_id") % 91 / 10.0))
    return FE.fixed_genre_features(cat.withColumn("genres", F.concat(F.coalesce("genres", F.array().cast("array<string>")), two)))


@query("final_item_features", with_views("reviews", "catalogue") + """
, used AS (SELECT DISTINCT item FROM reviews)
, catalogue2 AS (SELECT * FROM catalogue WHERE tmdb_id IN (SELECT item FROM used))
""" + ROUNDED + re.sub(r"\bcatalogue\b", "catalogue2", ALL_SQL) + ")")
def q_final_item_features(spark, sf):
    """R2 on the used catalogue: every family, for the items that have ratings."""
    used = V.reviews(spark, sf).select(F.col("item").alias("tmdb_id")).distinct()
    # read by every family
    return _w(all_features(materialise(V.catalogue(spark, sf).join(used, "tmdb_id", "left_semi"))))
