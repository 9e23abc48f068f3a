"""Queries: item extraction, resolution and cleaning, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.vector import r6
from marquee.operators import catalog, resolve
from marquee.plans.oracle_views import clean_title_sql, normalize_title_sql, with_views
from marquee.plans.registry import query
from marquee.sources import views as V

CT = clean_title_sql("title")
NT = normalize_title_sql

# ---------------------------------------------------------------- A3 / J6 / J7

UNIQUE_ITEMS_SQL = with_views("reviews") + f"""
, active AS (SELECT username FROM reviews WHERE title IS NOT NULL GROUP BY username HAVING count(*) >= 10)
, r AS (SELECT *, {CT} AS clean_title FROM reviews
        WHERE title IS NOT NULL AND username IN (SELECT username FROM active))
SELECT arg_min(title, seq) AS title, year, clean_title, count(username) AS appearance_count
FROM r GROUP BY clean_title, year HAVING count(username) >= 5
"""


@query("unique_items", UNIQUE_ITEMS_SQL)
def q_unique_items(spark, sf):
    return catalog.unique_items(V.reviews(spark, sf), 10, 5)


@query("active_users", with_views("reviews") + """
SELECT username, count(*) AS n_ratings FROM reviews GROUP BY username HAVING count(*) >= 10
""")
def q_active_users(spark, sf):
    return catalog.active_users(V.reviews(spark, sf), 10)


@query("frequent_items", with_views("reviews") + """
SELECT item, count(*) AS n_ratings FROM reviews GROUP BY item HAVING count(*) >= 5
""")
def q_frequent_items(spark, sf):
    return catalog.frequent_items(V.reviews(spark, sf), 5, "item")


@query("unique_items_top10", UNIQUE_ITEMS_SQL.replace(
    "SELECT arg_min(title, seq) AS title", "SELECT * FROM (SELECT arg_min(title, seq) AS title", 1)
    + ") ORDER BY appearance_count DESC, title ASC LIMIT 10")
def q_unique_items_top10(spark, sf):
    # K1 + K4: a head-N report over the sorted items (the limit is the feature).
    return catalog.sort_unique_items(catalog.unique_items(V.reviews(spark, sf), 10, 5, stored=True)).limit(10)


# ---------------------------------------------------------------- J1-J3, A19

RESOLVE_CTE = with_views("reviews", "catalogue") + f"""
, ex AS (SELECT title AS lk_title, year AS lk_year, arg_max(tmdb_id, seq) AS exact_id
         FROM catalogue WHERE tmdb_id IS NOT NULL GROUP BY title, year)
, fl AS (SELECT {NT('title')} AS lk_norm, arg_max(tmdb_id, seq) AS flex_id
         FROM catalogue WHERE tmdb_id IS NOT NULL GROUP BY 1)
, resolved AS (
  SELECT r.*, coalesce(ex.exact_id, fl.flex_id) AS tmdb_id,
         CASE WHEN ex.exact_id IS NOT NULL THEN 'exact' WHEN fl.flex_id IS NOT NULL THEN 'flexible'
              ELSE 'none' END AS match_kind
  FROM reviews r LEFT JOIN ex ON r.title = ex.lk_title AND r.year = ex.lk_year
       LEFT JOIN fl ON {NT('r.title')} = fl.lk_norm)
"""


@query("resolve_two_tier", RESOLVE_CTE + """
SELECT username, title, year, rating, film_slug, item, tmdb_id, match_kind FROM resolved
""")
def q_resolve_two_tier(spark, sf):
    return resolve.resolve_two_tier(V.reviews(spark, sf), V.catalogue(spark, sf)).select(
        "username", "title", "year", "rating", "film_slug", "item", "tmdb_id", "match_kind")


@query("match_report", RESOLVE_CTE + """
SELECT match_kind, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM resolved GROUP BY match_kind
""")
def q_match_report(spark, sf):
    return resolve.match_report(resolve.resolve_two_tier(V.reviews(spark, sf), V.catalogue(spark, sf)))


CLEAN_CTE = RESOLVE_CTE + """
, repaired AS (SELECT * REPLACE (CAST(coalesce(year, TRY_CAST(substr(release_date, 1, 4) AS INTEGER)) AS INTEGER) AS year)
               FROM catalogue)
, idyear AS (SELECT tmdb_id AS _yid, arg_min_null(year, seq) AS _cat_year FROM repaired
             WHERE tmdb_id IS NOT NULL GROUP BY tmdb_id)
, final_reviews AS (
  SELECT r.username, r.title, CAST(coalesce(r.year, i._cat_year) AS INTEGER) AS year, r.rating,
         r.film_slug, r.item, r.seq, CAST(r.tmdb_id AS BIGINT) AS tmdb_id
  FROM resolved r LEFT JOIN idyear i ON r.tmdb_id = i._yid WHERE r.tmdb_id IS NOT NULL)
, final_metadata AS (
  SELECT * FROM repaired WHERE tmdb_id IN (SELECT tmdb_id FROM final_reviews))
"""


@query("final_reviews", CLEAN_CTE + """
SELECT username, title, year, rating, film_slug, item, tmdb_id FROM final_reviews
""")
def q_final_reviews(spark, sf):
    fr, _ = resolve.clean_dataset(V.reviews(spark, sf), V.catalogue(spark, sf))
    return fr.select("username", "title", "year", "rating", "film_slug", "item", "tmdb_id")


@query("year_repair", with_views("catalogue") + """
SELECT tmdb_id, title, CAST(coalesce(year, TRY_CAST(substr(release_date, 1, 4) AS INTEGER)) AS INTEGER) AS year,
       release_date FROM catalogue
""")
def q_year_repair(spark, sf):
    return resolve.repair_catalogue_year(V.catalogue(spark, sf)).select("tmdb_id", "title", "year", "release_date")


@query("used_catalogue", CLEAN_CTE + """
SELECT tmdb_id, title, year, release_date, runtime, budget, revenue, popularity, original_language
FROM final_metadata
""")
def q_used_catalogue(spark, sf):
    _, fm = resolve.clean_dataset(V.reviews(spark, sf), V.catalogue(spark, sf))
    return fm.select("tmdb_id", "title", "year", "release_date", "runtime", "budget", "revenue",
                     "popularity", "original_language")


@query("null_year_fallback", with_views("reviews", "catalogue") + """
, ex AS (SELECT title AS lk_title, year AS lk_year, arg_max(tmdb_id, seq) AS exact_id
         FROM catalogue WHERE tmdb_id IS NOT NULL GROUP BY title, year)
, ny AS (SELECT title AS ny_title, arg_max(tmdb_id, seq) AS ny_id FROM catalogue
         WHERE tmdb_id IS NOT NULL AND year IS NULL GROUP BY title)
SELECT r.username, r.title, r.year, r.rating, coalesce(ex.exact_id, ny.ny_id) AS tmdb_id
FROM reviews r LEFT JOIN ex ON r.title = ex.lk_title AND r.year = ex.lk_year
     LEFT JOIN ny ON r.title = ny.ny_title
""")
def q_null_year_fallback(spark, sf):
    out = resolve.resolve_with_null_year_fallback(V.reviews(spark, sf), V.catalogue(spark, sf))
    return out.select("username", "title", "year", "rating", "tmdb_id")


CASCADE_SQL = with_views("reviews", "catalogue") + """
, ty AS (SELECT title AS k, year AS y, arg_min(tmdb_id, seq) AS id, min(seq) AS s
         FROM catalogue WHERE tmdb_id IS NOT NULL GROUP BY title, year)
, ta AS (SELECT title AS k, arg_min(tmdb_id, seq) AS id FROM catalogue WHERE tmdb_id IS NOT NULL GROUP BY title)
, j AS (
  SELECT r.*, e.id AS e_id, a.id AS a_id,
         CASE WHEN m.id IS NULL THEN p.id WHEN p.id IS NULL THEN m.id WHEN m.s <= p.s THEN m.id ELSE p.id END AS n_id
  FROM reviews r
  LEFT JOIN ty e ON r.title = e.k AND r.year = e.y
  LEFT JOIN ta a ON r.title = a.k
  LEFT JOIN ty m ON r.title = m.k AND r.year - 1 = m.y
  LEFT JOIN ty p ON r.title = p.k AND r.year + 1 = p.y)
SELECT username, title, year, rating, coalesce(e_id, a_id, n_id) AS tmdb_id,
       CASE WHEN e_id IS NOT NULL THEN 'exact' WHEN a_id IS NOT NULL THEN 'title'
            WHEN n_id IS NOT NULL THEN 'near_year' ELSE 'none' END AS match_kind
FROM j
"""


@query("match_cascade", CASCADE_SQL)
def q_match_cascade(spark, sf):
    return resolve.match_cascade(V.reviews(spark, sf), V.catalogue(spark, sf)) \
        .select("username", "title", "year", "rating", "tmdb_id", "match_kind")


@query("match_case_insensitive", with_views("reviews", "catalogue") + """
, ty AS (SELECT lower(title) AS k, year AS y, arg_min(tmdb_id, seq) AS id FROM catalogue
         WHERE tmdb_id IS NOT NULL GROUP BY 1, 2)
, t AS (SELECT lower(title) AS k, arg_min(tmdb_id, seq) AS id FROM catalogue
        WHERE tmdb_id IS NOT NULL GROUP BY 1)
SELECT r.username, r.title, r.year, r.rating,
       CASE WHEN r.year IS NULL THEN t.id ELSE ty.id END AS tmdb_id
FROM reviews r LEFT JOIN ty ON lower(r.title) = ty.k AND r.year = ty.y
     LEFT JOIN t ON lower(r.title) = t.k
""")
def q_match_case_insensitive(spark, sf):
    return resolve.match_case_insensitive(V.reviews(spark, sf), V.catalogue(spark, sf)) \
        .select("username", "title", "year", "rating", "tmdb_id")


@query("match_exact_only", with_views("reviews", "catalogue") + """
, lk AS (SELECT title AS x_t, year AS x_y, arg_min(tmdb_id, seq) AS tmdb_id FROM catalogue
         WHERE tmdb_id IS NOT NULL GROUP BY 1, 2)
SELECT r.username, r.title, r.year, r.rating, lk.tmdb_id
FROM reviews r JOIN lk ON r.title = lk.x_t AND r.year = lk.x_y
""")
def q_match_exact_only(spark, sf):
    return resolve.match_exact_only(V.reviews(spark, sf), V.catalogue(spark, sf)) \
        .select("username", "title", "year", "rating", "tmdb_id")


# ---------------------------------------------------------------- J9, S21, A20

ENRICH_SQL = with_views("reviews", "catalogue") + f"""
, active AS (SELECT username FROM reviews WHERE title IS NOT NULL GROUP BY username HAVING count(*) >= 10)
, r AS (SELECT *, {CT} AS clean_title FROM reviews
        WHERE title IS NOT NULL AND username IN (SELECT username FROM active))
, items AS (SELECT arg_min(title, seq) AS title, year, clean_title, count(username) AS appearance_count
            FROM r GROUP BY clean_title, year HAVING count(username) >= 5)
, found AS (SELECT title, year, arg_min_null(tmdb_id, seq) AS tmdb_id, arg_min_null(runtime, seq) AS runtime,
                   arg_min_null(original_language, seq) AS original_language
            FROM catalogue GROUP BY title, year)
, enriched AS (
  SELECT i.title, i.year, i.clean_title, i.appearance_count, f.tmdb_id,
         coalesce(f.runtime, 0) AS runtime, coalesce(f.original_language, '') AS original_language
  FROM items i LEFT JOIN found f ON i.title IS NOT DISTINCT FROM f.title AND i.year IS NOT DISTINCT FROM f.year)
"""


def _enriched(spark, sf):
    items = catalog.unique_items(V.reviews(spark, sf), 10, 5)
    found = V.catalogue(spark, sf).select("title", "year", "tmdb_id", "runtime", "original_language", "seq")
    return catalog.enrich_unique_items(items, found)


@query("left_join_null_safe", ENRICH_SQL + "SELECT * FROM enriched")
def q_left_join_null_safe(spark, sf):
    return _enriched(spark, sf)


@query("enrichment_rate", ENRICH_SQL + """
SELECT count(*) AS n_items, count(tmdb_id) AS n_found,
       round(avg(CASE WHEN tmdb_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS found_rate FROM enriched
""")
def q_enrichment_rate(spark, sf):
    e = _enriched(spark, sf)
    return e.agg(F.count(F.lit(1)).alias("n_items"), F.count("tmdb_id").alias("n_found"),
                 r6(F.avg(F.when(F.col("tmdb_id").isNotNull(), 1.0).otherwise(0.0))).alias("found_rate"))


# ---------------------------------------------------------------- A30, U1, U2, U4, W3, S22, J20

@query("dedup_first", """
SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value,
       arg_min(ts, event_id) AS ts FROM events GROUP BY user_id, event_type
""")
def q_dedup_first(spark, sf):
    ev = V.events(spark, sf).select("user_id", "event_type", "event_id", "value", "ts") \
        .withColumn("seq", F.col("event_id"))
    return catalog.first_by_key(ev, ["user_id", "event_type"]).drop("seq")


@query("append", """
SELECT event_id, user_id, event_type, value FROM events
UNION ALL
SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click'
""")
def q_append(spark, sf):
    ev = V.events(spark, sf).select("event_id", "user_id", "event_type", "value")
    return catalog.append_rows(ev, ev.where(F.col("event_type") == "click"))


@query("replace_user", """
SELECT event_id, user_id, event_type, value FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
UNION ALL
SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase'
""")
def q_replace_user(spark, sf):
    # The purchase events act as a fresh batch replacing their users' rows.
    ev = V.events(spark, sf).select("event_id", "user_id", "event_type", "value")
    return catalog.replace_user_rows(ev, ev.where(F.col("event_type") == "purchase"), "user_id")


@query("per_user_cap", """
SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 20
""")
def q_per_user_cap(spark, sf):
    ev = V.events(spark, sf).select("event_id", "user_id", "event_type", "value").withColumn("seq", F.col("event_id"))
    return catalog.per_user_cap(ev, 20, "user_id").drop("seq")


@query("pending_keys", with_views("catalogue") + """
SELECT tmdb_id, title FROM catalogue c
WHERE NOT EXISTS (SELECT 1 FROM catalogue d WHERE d.runtime > 40 AND d.tmdb_id = c.tmdb_id)
""")
def q_pending_keys(spark, sf):
    # resume = the rows whose key is not stored yet (stored = runtime > 40 here).
    cat = V.catalogue(spark, sf)
    return catalog.pending_keys(cat.select("tmdb_id", "title"), cat.where(F.col("runtime") > 40), ["tmdb_id"])


@query("user_status", with_views("members", "reviews") + """
, known AS (SELECT DISTINCT username FROM reviews)
SELECT m.username, k.username IS NOT NULL AS exists_in_dataset, m.num_reviews
FROM members m LEFT JOIN known k ON m.username = k.username
""")
def q_user_status(spark, sf):
    from marquee.plans.runs import user_status
    return user_status(V.members(spark, sf), V.reviews(spark, sf))


@query("array_distinct", with_views("catalogue") + """
SELECT tmdb_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS services
FROM (SELECT tmdb_id, list_concat(genres, directors, genres) AS l FROM catalogue)
""")
def q_array_distinct(spark, sf):
    # Order-preserving distinct of concatenated lists.
    c = V.catalogue(spark, sf)
    return c.select("tmdb_id", F.array_distinct(F.concat("genres", "directors", "genres")).alias("services"))
