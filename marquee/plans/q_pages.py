"""Queries: extraction from pages that are built per row of the tables (S14-S17, X3, X4, X8-X10), dataset versions
(S3, S5, S6), standardised columns (X16), catalogue upkeep (U5), listings (K6) and the blend variants (M7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.functions.vector import r6
from marquee.operators import catalog, features as FE, score as S
from marquee.plans.oracle_views import with_views
from marquee.plans.registry import query
from marquee.session import work_path
from marquee.sources import extract as X, io
from marquee.sources import views as V

CAT = with_views("catalogue")


@query("member_rows", with_views("members") + """
SELECT CAST(substr(username, 2) AS BIGINT) AS page_id, CAST(0 AS INTEGER) AS pos, username, display_name,
       CASE WHEN num_reviews % 7 = 0 THEN 0 ELSE num_reviews * 37 END AS num_reviews FROM members
""")
def q_member_rows(spark, sf):
    """Listing pages, one per member; counts with separators, some unreadable."""
    m = V.members(spark, sf)
    shown = F.when(F.col("num_reviews") % 7 == 0, F.lit("n/a")).otherwise(F.format_number((F.col("num_reviews") * 37).cast("double"), 0))
    html = F.concat(F.lit('<table><tr><td class="table-person"><a href="/'), "username", F.lit('/"><span class="name">'), "display_name",
                    F.lit('</span></a>\n<span class="count">'), shown, F.lit("</span></td></tr></table>"))
    pages = m.select(F.substring("username", 2, 20).cast("bigint").alias("page_id"), html.alias("html"))
    return X.member_rows(pages)


@query("film_rows", """
SELECT 'u' || p_partkey AS username, CAST(0 AS INTEGER) AS pos, p_name AS title,
       CAST(CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_partkey % 30 WHEN p_partkey % 4 = 1 THEN 1950 + p_partkey % 50 END AS INTEGER) AS year,
       CAST(1 + p_partkey % 10 AS INTEGER) AS rating,
       replace(p_name, ' ', '-') || CASE WHEN p_partkey % 4 = 1 THEN '-' || (1950 + p_partkey % 50) ELSE '' END AS film_slug
FROM part WHERE p_partkey % 3 <> 0
""")
def q_film_rows(spark, sf):
    """Profile pages with a rated poster (year attribute, year in the slug, or none) and an unrated one."""
    p = V.table(spark, sf, "part")
    k = F.col("p_partkey")
    slug = F.concat(F.regexp_replace("p_name", " ", "-"),
                    F.when(k % 4 == 1, F.concat(F.lit("-"), (1950 + k % 50).cast("string"))).otherwise(F.lit("")))
    year = F.when(k % 2 == 0, F.concat(F.lit(' data-film-release-year="'), (1990 + k % 30).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    rating = F.when(k % 3 != 0, F.concat(F.lit('<span class="rating rated-'), (1 + k % 10).cast("string"), F.lit('"></span>'))).otherwise(F.lit(""))
    html = F.concat(F.lit('<ul><li class="poster-container"><img alt="'), "p_name", F.lit('" /><div data-film-slug="'), slug, F.lit('"'), year,
                    F.lit("></div>\n"), rating, F.lit('</li><li class="poster-container"><img alt="Unrated" /><div data-film-slug="unrated"></div></li></ul>'))
    return X.film_rows(p.select(F.concat(F.lit("u"), k.cast("string")).alias("username"), html.alias("html")))


@query("page_navigation", """
SELECT p_partkey, CASE WHEN p_partkey % 12 > 0 THEN CAST((p_partkey % 6) + 0.5 * (CASE WHEN p_partkey % 12 >= 6 THEN 1 ELSE 0 END) AS DOUBLE) END AS stars,
       CASE WHEN p_partkey % 3 <> 0 THEN '/u' || p_partkey || '/films/page/2/' END AS next_page FROM part
""")
def q_page_navigation(spark, sf):
    """Star marks and the link to the next page."""
    k = F.col("p_partkey")
    stars = F.concat(F.expr("repeat('<i class=\"star-full\"></i>', CAST(p_partkey % 6 AS INT))"),
                     F.when(k % 12 >= 6, F.lit('<i class="star-half"></i>')).otherwise(F.lit("")))
    nav = F.when(k % 3 != 0, F.concat(F.lit('<a class="next" href="/u'), k.cast("string"), F.lit('/films/page/2/">Next</a>'))).otherwise(F.lit("<p>last</p>"))
    pages = V.table(spark, sf, "part").select("p_partkey", stars.alias("block"), nav.alias("html"))
    return pages.select("p_partkey", X.star_rating("block").cast("double").alias("stars"), X.next_link("html").alias("next_page"))


@query("list_literals", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN [p_brand, p_type] WHEN 1 THEN [p_brand, p_type] WHEN 2 THEN [p_brand, NULL] ELSE [] END AS strict,
       CASE p_partkey % 6 WHEN 0 THEN [p_brand, p_type] WHEN 1 THEN [p_brand, p_type] WHEN 2 THEN [p_brand, NULL]
                          WHEN 3 THEN [p_brand, p_type] ELSE [] END AS lenient FROM part
""")
def q_list_literals(spark, sf):
    """List literals in Python and JSON spelling, unquoted, missing and plain text."""
    k, a, b = F.col("p_partkey"), F.col("p_brand"), F.col("p_type")
    made = (F.when(k % 6 == 0, F.concat(F.lit("['"), a, F.lit("', '"), b, F.lit("']")))
            .when(k % 6 == 1, F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('"]')))
            .when(k % 6 == 2, F.concat(F.lit("['"), a, F.lit("', None]")))
            .when(k % 6 == 3, F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]")))
            .when(k % 6 == 5, F.concat(a, F.lit(", "), b)))
    src = V.table(spark, sf, "part").select("p_partkey", made.alias("made"))
    return src.select("p_partkey", T.parse_list_strict("made").alias("strict"), T.parse_list_lenient("made").alias("lenient"))


@query("zscore", CAT + """
, s AS (SELECT avg(popularity) AS mp, stddev_samp(popularity) AS sp, avg(budget) AS mb, stddev_samp(budget) AS sb FROM catalogue)
SELECT tmdb_id, round((popularity - mp) / sp, 6) AS popularity, round((budget - mb) / sb, 6) AS budget, CAST(7.0 AS DOUBLE) AS same FROM catalogue, s
""")
def q_zscore(spark, sf):
    """Z-scores of numeric columns; a column without spread stays as it is."""
    c = V.catalogue(spark, sf).select("tmdb_id", "popularity", F.col("budget").cast("double").alias("budget"), F.lit(7.0).alias("same"))
    out = FE.zscore_columns(c, ["popularity", "budget", "same"])
    return out.select("tmdb_id", *[r6(x).alias(x) for x in ("popularity", "budget", "same")])


@query("append_catalogue", CAT + """
SELECT tmdb_id, title, seq FROM catalogue
UNION ALL SELECT tmdb_id + 1000000000, title || ' (new)', seq + 1000000000 FROM catalogue WHERE tmdb_id % 10 = 0
""")
def q_append_catalogue(spark, sf):
    """Fetched rows are appended; the first row of an id stays."""
    c = V.catalogue(spark, sf).select("tmdb_id", "title", "seq")
    later = F.lit(1_000_000_000)
    again = c.where(F.col("tmdb_id") % 3 == 0).select("tmdb_id", F.concat("title", F.lit(" (again)")).alias("title"), (F.col("seq") + later).alias("seq"))
    new = c.where(F.col("tmdb_id") % 10 == 0).select((F.col("tmdb_id") + later).alias("tmdb_id"), F.concat("title", F.lit(" (new)")).alias("title"),
                                                     (F.col("seq") + later).alias("seq"))
    return catalog.append_catalogue_rows(c, again.unionByName(new)).select("tmdb_id", "title", "seq")


@query("listing_head", with_views("members") + """
SELECT username, page_id, pos FROM (
  SELECT username, CAST(substr(username, 2) AS BIGINT) // 20 AS page_id, CAST(substr(username, 2) AS BIGINT) % 20 AS pos FROM members)
ORDER BY page_id, pos LIMIT 100
""")
def q_listing_head(spark, sf):
    """K6: the first 100 members in listing order (the cut is the operator)."""
    number = F.substring("username", 2, 20).cast("bigint")
    m = V.members(spark, sf).select("username", F.floor(number / 20).cast("bigint").alias("page_id"), (number % 20).alias("pos"))
    return catalog.truncate_listing(m, 100)


@query("blend_variants", CAT + """
, x AS (SELECT tmdb_id, popularity AS cf, (runtime % 50) / 50.0 AS cb FROM catalogue)
, s AS (SELECT avg(cf) AS m, stddev_pop(cf) AS sd FROM x)
SELECT tmdb_id,
  round(greatest(1.0, least(10.0, (0.7 * greatest(0.0, least(1.0, ((cf - m) / sd + 3.0) / 6.0)) + 0.3 * cb) * 10.0)), 6) AS zscored,
  round(greatest(0.5, least(10.0, 0.7 * cf + 0.3 * cb)), 6) AS raw_mean, round(greatest(1.0, least(10.0, 0.7 * cf + 0.3 * cb)), 6) AS raw
FROM x, s
""")
def q_blend_variants(spark, sf):
    """The three blends of a collaborative and a content score."""
    x = V.catalogue(spark, sf).select("tmdb_id", F.col("popularity").alias("cf"), ((F.col("runtime") % 50) / 50.0).alias("cb"))
    m = x.agg(F.avg("cf").alias("m"), F.stddev_pop("cf").alias("sd")).first()
    cf, cb = F.col("cf"), F.col("cb")
    return x.select("tmdb_id", r6(S.blend(cf, cb, 0.7, "zscore", m.m, m.sd)).alias("zscored"), r6(S.blend(cf, cb, 0.7, "raw_mean")).alias("raw_mean"),
                    r6(S.blend(cf, cb, 0.7, "raw")).alias("raw"))


@query("dataset_versions", CAT + """
SELECT 'newest' AS asked, tmdb_id, title FROM catalogue
UNION ALL SELECT 'first', tmdb_id, title FROM catalogue WHERE tmdb_id % 2 = 0
""")
def q_dataset_versions(spark, sf):
    """Two runs of a dataset are written (one twice); the newest and a named one are read."""
    root = work_path(spark, f"versions/{uuid.uuid4().hex}")
    cat = V.catalogue(spark, sf).select("tmdb_id", "title")
    even = cat.where(F.col("tmdb_id") % 2 == 0)
    for run, rows in (("20250101_000000_000001", cat), ("20250102_000000_000001", cat), ("20250101_000000_000001", even)):
        io.write_table(rows, root, "catalogue", run, mode="overwrite")
    newest = io.read_latest(spark, root, "catalogue")
    first = io.read_latest(spark, root, "catalogue", "20250101_000000_000001")
    return newest.select(F.lit("newest").alias("asked"), "tmdb_id", "title").unionByName(first.select(F.lit("first").alias("asked"), "tmdb_id", "title"))
