"""Queries: profiles and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.vector import r6
from marquee.operators import catalog, profile as P
from marquee.plans.oracle_views import clean_title_sql, with_views
from marquee.plans.registry import query
from marquee.session import checkpoint
from marquee.sources import views as V

NUM_COLS = ["runtime", "budget", "revenue", "popularity", "year"]
LIST_COLS = ["genres", "directors", "cast"]


def long_sql(src: str, cols: list[str], where: str = "") -> str:
    parts = [f"SELECT '{c}' AS field, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols]
    body = " UNION ALL ".join(parts)
    return f"(SELECT * FROM ({body}) {('WHERE ' + where) if where else ''})"


CAT = with_views("catalogue")
LF = long_sql("catalogue", NUM_COLS)
LFP = long_sql("catalogue", NUM_COLS, "value > 0")


@query("numeric_profile", CAT + f"""
SELECT field, count(*) AS total, count(value) AS non_null,
       round((count(*) - count(value)) * 100.0 / count(*), 6) AS null_pct,
       round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
       round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std
FROM {LF} GROUP BY field
""")
def q_numeric_profile(spark, sf):
    return P.numeric_profile(V.catalogue(spark, sf), NUM_COLS)


@query("numeric_profile_signed", f"""
SELECT field, count(*) AS total, count(value) AS non_null,
       round((count(*) - count(value)) * 100.0 / count(*), 6) AS null_pct,
       round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
       round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std
FROM (SELECT 's_acctbal' AS field, s_acctbal AS value FROM supplier
      UNION ALL SELECT 'c_acctbal', c_acctbal FROM customer) GROUP BY field
""")
def q_numeric_profile_signed(spark, sf):
    s = V.table(spark, sf, "supplier").select(F.lit("s_acctbal").alias("field"), F.col("s_acctbal").alias("value"))
    c = V.table(spark, sf, "customer").select(F.lit("c_acctbal").alias("field"), F.col("c_acctbal").alias("value"))
    return P.profile_long(s.unionByName(c))


@query("percentiles", CAT + f"""
SELECT field, {', '.join(f"round(q[{i + 1}], 6) AS p{int(round(p * 100)):02d}" for i, p in enumerate(P.PCTS))}
FROM (SELECT field, quantile_cont(value, {list(P.PCTS)}) AS q FROM {LFP} GROUP BY field)
""")
def q_percentiles(spark, sf):
    # distributed exact selection: no single buffer holds all distinct values
    return P.percentiles(V.catalogue(spark, sf), NUM_COLS, distributed=True)


IQR_CTE = CAT + f"""
, lf AS (SELECT * FROM {LFP} WHERE value IS NOT NULL)
, q AS (SELECT field AS _c, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
               quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY field)
, j AS (SELECT lf.*, q.*, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
        FROM lf JOIN q ON lf.field = q._c)
"""


@query("iqr_outliers", IQR_CTE + """
SELECT field, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3,
       round(any_value(lower), 6) AS lower, round(any_value(upper), 6) AS upper, count(*) AS n,
       count(*) FILTER (WHERE value < lower OR value > upper) AS n_outliers,
       round(count(*) FILTER (WHERE value < lower OR value > upper) * 100.0 / count(*), 6) AS outlier_pct,
       round(min(value) FILTER (WHERE value < lower OR value > upper), 6) AS min_outlier,
       round(max(value) FILTER (WHERE value < lower OR value > upper), 6) AS max_outlier
FROM j GROUP BY field
""")
def q_iqr_outliers(spark, sf):
    return P.iqr_outliers(V.catalogue(spark, sf), NUM_COLS)


@query("box_plot", IQR_CTE + """
SELECT field, round(min(value) FILTER (WHERE value >= lower AND value <= upper), 6) AS whisker_lo,
       round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
       round(max(value) FILTER (WHERE value >= lower AND value <= upper), 6) AS whisker_hi
FROM j GROUP BY field
""")
def q_box_plot(spark, sf):
    return P.box_plot(V.catalogue(spark, sf), NUM_COLS)


def _hist_sql(src: str, bins: int, log: bool) -> str:
    val = "log10(value)" if log else "value"
    return f"""
, lf AS (SELECT field, {val} AS value FROM {src} WHERE value IS NOT NULL AND value > 0)
, mm AS (SELECT field AS _c, min(value) AS lo, max(value) AS hi FROM lf GROUP BY field)
, b AS (SELECT field, lo, hi, CASE WHEN hi = lo THEN 1
               ELSE least({bins}, CAST(floor((value - lo) * {bins} / (hi - lo)) + 1 AS INTEGER)) END AS bin
        FROM lf JOIN mm ON lf.field = mm._c)
SELECT field, bin, round(any_value(lo) + (bin - 1) * (any_value(hi) - any_value(lo)) / {bins}, 6) AS edge_lo,
       round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / {bins}, 6) AS edge_hi, count(*) AS n
FROM b GROUP BY field, bin
"""


@query("histogram", CAT + _hist_sql(LF, 50, False))
def q_histogram(spark, sf):
    return P.histogram(V.catalogue(spark, sf), NUM_COLS, bins=50)


@query("histogram_log10", CAT + _hist_sql(long_sql("catalogue", ["budget", "revenue"]), 30, True))
def q_histogram_log10(spark, sf):
    return P.histogram(V.catalogue(spark, sf), ["budget", "revenue"], bins=30, log10=True)


def _list_long(cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, seq AS _seq, u.pos - 1 AS pos, u.element FROM catalogue, "
        f"unnest({c}) WITH ORDINALITY AS u(element, pos)"
        for c in cols).replace('unnest(cast)', 'unnest("cast")')


def _rows_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS _c, count(*) FILTER (WHERE len(\"{c}\") > 0) AS rows_with_data FROM catalogue"
        for c in cols)


@query("list_profile", CAT + f"""
, ex AS ({_list_long(LIST_COLS)})
, rows AS ({_rows_sql(LIST_COLS)})
, agg AS (SELECT field, count(DISTINCT element) AS unique_items, count(*) AS occurrences FROM ex GROUP BY field)
SELECT field, rows_with_data, unique_items, occurrences, round(occurrences / rows_with_data, 6) AS avg_per_row
FROM agg JOIN rows ON agg.field = rows._c
""")
def q_list_profile(spark, sf):
    return P.list_profile(V.catalogue(spark, sf), LIST_COLS)


@query("list_top", CAT + f"""
, ex AS ({_list_long(LIST_COLS)})
, rows AS ({_rows_sql(LIST_COLS)})
, cnt AS (SELECT field, element, count(*) AS n, min((_seq, pos)) AS first FROM ex GROUP BY field, element)
, top AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, first) AS rank FROM cnt)
SELECT field, rank, element, n, round(n * 100.0 / rows_with_data, 6) AS share_pct
FROM top JOIN rows ON top.field = rows._c WHERE rank <= 20
""")
def q_list_top(spark, sf):
    return P.list_top(V.catalogue(spark, sf), LIST_COLS, 20)


@query("categorical_profile", CAT + """
SELECT original_language AS value, count(*) AS n,
       row_number() OVER (ORDER BY count(*) DESC, original_language ASC NULLS LAST) AS rank
FROM catalogue GROUP BY original_language
""")
def q_categorical_profile(spark, sf):
    return P.categorical_profile(V.catalogue(spark, sf), "original_language")


@query("categorical_summary", CAT + """
SELECT count(*) - count(original_language) AS null_count, count(DISTINCT original_language) AS unique_values
FROM catalogue
""")
def q_categorical_summary(spark, sf):
    c = V.catalogue(spark, sf)
    return c.agg((F.count(F.lit(1)) - F.count("original_language")).alias("null_count"),
                 F.count_distinct("original_language").alias("unique_values"))


@query("tier_counts", CAT + """
SELECT tier, count(*) AS n, round(count(*) * 100.0 / (SELECT count(popularity) FROM catalogue), 6) AS share_pct
FROM (SELECT CASE WHEN popularity <= 1 THEN 'low' WHEN popularity <= 5 THEN 'medium' ELSE 'high' END AS tier
      FROM catalogue WHERE popularity IS NOT NULL) GROUP BY tier
""")
def q_tier_counts(spark, sf):
    from pyspark.sql import Window
    c = V.catalogue(spark, sf).where(F.col("popularity").isNotNull())
    tier = F.when(F.col("popularity") <= 1, "low").when(F.col("popularity") <= 5, "medium").otherwise("high")
    g = c.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    # the total is a window over the three aggregated rows, not a join
    total = F.sum("n").over(Window.partitionBy())
    return g.select("tier", "n", r6(F.col("n") * 100.0 / total).alias("share_pct"))


COMPLETE_LISTS = ["genres", "directors", "cast"]
COMPLETE_SCALARS = ["year", "release_date", "runtime", "original_language", "popularity"]


@query("completeness", CAT + " " + " UNION ALL ".join(
    [f"SELECT '{c}' AS field, round(avg(CASE WHEN len(\"{c}\") > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS complete_pct FROM catalogue"
     for c in COMPLETE_LISTS] +
    [f"SELECT '{c}', round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100, 6) FROM catalogue"
     for c in COMPLETE_SCALARS]))
def q_completeness(spark, sf):
    return P.completeness(V.catalogue(spark, sf), COMPLETE_LISTS, COMPLETE_SCALARS)


@query("presence_counts", CAT + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER (WHERE len(\"{c}\") > 0) AS n_present FROM catalogue"
    for c in LIST_COLS))
def q_presence_counts(spark, sf):
    return P.presence_counts(V.catalogue(spark, sf), LIST_COLS)


@query("group_size_stats", with_views("reviews") + " UNION ALL ".join(
    f"""SELECT '{k}' AS level, round(avg(_n), 6) AS mean, round(quantile_cont(_n, 0.5), 6) AS median,
        min(_n) AS min, max(_n) AS max, count(*) AS groups
        FROM (SELECT {k}, count(*) AS _n FROM reviews GROUP BY {k})""" for k in ("username", "item")))
def q_group_size_stats(spark, sf):
    return P.group_size_stats(V.reviews(spark, sf), ["username", "item"])


@query("user_profile", with_views("reviews") + """
SELECT username, count(rating) AS n, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS std,
       min(rating) AS min, max(rating) AS max FROM reviews GROUP BY username
""")
def q_user_profile(spark, sf):
    return P.user_profile(V.reviews(spark, sf))


@query("event_user_profile", """
SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, max(value) AS max FROM events GROUP BY user_id
""")
def q_event_user_profile(spark, sf):
    return P.user_profile(V.events(spark, sf), "user_id", "value")


@query("distinct_counts", with_views("reviews") + """
SELECT count(DISTINCT username) AS users, count(DISTINCT item) AS items, count(DISTINCT title) AS titles,
       count(*) AS ratings FROM reviews
""")
def q_distinct_counts(spark, sf):
    """A4 (exact); ``approx_count_distinct`` is the scale option."""
    r = V.reviews(spark, sf)
    return r.agg(F.count_distinct("username").alias("users"), F.count_distinct("item").alias("items"),
                 F.count_distinct("title").alias("titles"), F.count(F.lit(1)).alias("ratings"))


@query("member_summary", with_views("members") + """
SELECT count(*) AS total, count(*) FILTER (WHERE num_reviews > 0) AS with_reviews,
       round(avg(num_reviews), 6) AS mean, max(num_reviews) AS max, min(num_reviews) AS min FROM members
""")
def q_member_summary(spark, sf):
    m = V.members(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("num_reviews") > 0).alias("with_reviews"),
                 r6(F.avg("num_reviews")).alias("mean"), F.max("num_reviews").alias("max"),
                 F.min("num_reviews").alias("min"))


@query("collected_summary", with_views("reviews") + """
SELECT count(*) AS rows, count(DISTINCT username) AS users, count(DISTINCT title) AS titles,
       round(count(*) * 1.0 / count(DISTINCT username), 6) AS mean_per_user,
       count(rating) AS rated_rows FROM reviews
""")
def q_collected_summary(spark, sf):
    r = V.reviews(spark, sf)
    return r.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("username").alias("users"),
                 F.count_distinct("title").alias("titles"),
                 r6(F.count(F.lit(1)) / F.count_distinct("username")).alias("mean_per_user"),
                 F.count("rating").alias("rated_rows"))


@query("quality_report", with_views("reviews") + """
, u AS (SELECT username, count(*) AS n FROM reviews GROUP BY username)
, i AS (SELECT item, count(*) AS n FROM reviews GROUP BY item)
, r AS (SELECT count(*) AS ratings, round(avg(rating), 6) AS rating_mean, round(stddev_samp(rating), 6) AS rating_std,
               min(rating) AS rating_min, max(rating) AS rating_max,
               count(*) FILTER (WHERE rating = 1) AS suspected_implicit FROM reviews)
SELECT r.*, (SELECT min(n) FROM u) AS user_min, (SELECT max(n) FROM u) AS user_max,
       (SELECT round(avg(n), 6) FROM u) AS user_mean, (SELECT count(*) FILTER (WHERE n >= 10) FROM u) AS users_ge10,
       (SELECT min(n) FROM i) AS item_min, (SELECT max(n) FROM i) AS item_max,
       (SELECT round(avg(n), 6) FROM i) AS item_mean, (SELECT count(*) FILTER (WHERE n >= 5) FROM i) AS items_ge5
FROM r
""")
def q_quality_report(spark, sf):
    """A25 in one scan: grouping sets (user), (item), () then one global aggregate."""
    rv = V.reviews(spark, sf).select("username", "item", "rating")
    g = rv.groupingSets([["username"], ["item"], []], "username", "item").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.avg("rating").alias("m"),
        F.stddev_samp("rating").alias("s"), F.min("rating").alias("lo"), F.max("rating").alias("hi"),
        F.count_if(F.col("rating") == 1).alias("ones"))
    # gid: 1 = grouped by username only, 2 = by item only, 3 = grand total
    tot, usr, itm = F.col("gid") == 3, F.col("gid") == 1, F.col("gid") == 2
    n = F.col("n")
    return g.agg(
        F.max(F.when(tot, n)).alias("ratings"), r6(F.max(F.when(tot, F.col("m")))).alias("rating_mean"),
        r6(F.max(F.when(tot, F.col("s")))).alias("rating_std"), F.max(F.when(tot, F.col("lo"))).alias("rating_min"),
        F.max(F.when(tot, F.col("hi"))).alias("rating_max"), F.max(F.when(tot, F.col("ones"))).alias("suspected_implicit"),
        F.min(F.when(usr, n)).alias("user_min"), F.max(F.when(usr, n)).alias("user_max"),
        r6(F.avg(F.when(usr, n))).alias("user_mean"), F.count_if(usr & (n >= 10)).alias("users_ge10"),
        F.min(F.when(itm, n)).alias("item_min"), F.max(F.when(itm, n)).alias("item_max"),
        r6(F.avg(F.when(itm, n))).alias("item_mean"), F.count_if(itm & (n >= 5)).alias("items_ge5"))


@query("unique_item_stats", with_views("reviews") + f"""
, active AS (SELECT username FROM reviews WHERE title IS NOT NULL GROUP BY username HAVING count(*) >= 10)
, r AS (SELECT *, {clean_title_sql('title')} AS clean_title FROM reviews
        WHERE title IS NOT NULL AND username IN (SELECT username FROM active))
, items AS (SELECT arg_min(title, seq) AS title, year, clean_title, count(username) AS appearance_count
            FROM r GROUP BY clean_title, year HAVING count(username) >= 5)
SELECT count(*) AS total_items, count(year) AS with_year, count(*) - count(year) AS without_year,
       min(year) AS year_min, max(year) AS year_max, min(appearance_count) AS appear_min,
       max(appearance_count) AS appear_max, round(avg(appearance_count), 6) AS appear_mean,
       round(quantile_cont(appearance_count, 0.5), 6) AS appear_median FROM items
""")
def q_unique_item_stats(spark, sf):
    """A7."""
    it = checkpoint(catalog.unique_items(V.reviews(spark, sf), 10, 5))
    middle = P.median(it.select(F.col("appearance_count").cast("double").alias("value")))
    return it.agg(F.count(F.lit(1)).alias("total_items"), F.count("year").alias("with_year"),
                  (F.count(F.lit(1)) - F.count("year")).alias("without_year"),
                  F.min("year").alias("year_min"), F.max("year").alias("year_max"),
                  F.min("appearance_count").alias("appear_min"), F.max("appearance_count").alias("appear_max"),
                  r6(F.avg("appearance_count")).alias("appear_mean"),
                  r6(F.lit(middle).cast("double")).alias("appear_median"))


@query("insight_summary", CAT + """
SELECT min(year) AS year_min, max(year) AS year_max, max(year) - min(year) AS year_span,
       round(avg(runtime) FILTER (WHERE runtime > 0), 6) AS mean_runtime,
       (SELECT count(DISTINCT g) FROM (SELECT unnest(genres) AS g FROM catalogue)) AS unique_genres,
       count(*) FILTER (WHERE budget > 0 AND revenue > 0) AS with_money
FROM catalogue
""")
def q_insight_summary(spark, sf):
    """A15 + J21."""
    c = V.catalogue(spark, sf).select("year", "runtime", "budget", "revenue",
                                      F.posexplode_outer("genres").alias("_pos", "g"))
    # one scan: scalar aggregates read only the first exploded row of each item
    first = F.col("_pos").isNull() | (F.col("_pos") == 0)
    y = F.when(first, F.col("year"))
    return c.agg(F.min(y).alias("year_min"), F.max(y).alias("year_max"), (F.max(y) - F.min(y)).alias("year_span"),
                 r6(F.avg(F.when(first & (F.col("runtime") > 0), F.col("runtime")))).alias("mean_runtime"),
                 F.count_distinct("g").alias("unique_genres"),
                 F.count_if(first & (F.col("budget") > 0) & (F.col("revenue") > 0)).alias("with_money"))


@query("money_pairs", CAT + """
SELECT tmdb_id, round(log10(budget), 6) AS log_budget, round(log10(revenue), 6) AS log_revenue
FROM catalogue WHERE budget > 0 AND revenue > 0
""")
def q_money_pairs(spark, sf):
    """A18 + J21: log-log pairs of rows with both measures positive."""
    c = V.catalogue(spark, sf).where((F.col("budget") > 0) & (F.col("revenue") > 0))
    return c.select("tmdb_id", r6(F.log10("budget")).alias("log_budget"), r6(F.log10("revenue")).alias("log_revenue"))


VERSION_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("version_profile", "WITH li AS (SELECT * FROM lineitem WHERE year(l_shipdate) >= 1994)" + f"""
SELECT field, CAST(p AS DOUBLE) AS p, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, true AS within_bound
FROM {long_sql("li", VERSION_COLS)}, (VALUES (0.25), (0.5), (0.75), (0.99)) q(p) GROUP BY field, p
""")
def q_version_profile(spark, sf):
    """A5 / A8 / A9 / A17 over dataset versions: line items sketched once per ship year (a version), the versions from
    1994 on merged without a scan, and each quantile held against the exact ranks."""
    from marquee.operators import sketches
    probs = (0.25, 0.5, 0.75, 0.99)
    li = V.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("version"), *VERSION_COLS)
    stored = checkpoint(sketches.run_sketches(li, VERSION_COLS, by="version"))
    prof = checkpoint(sketches.profile(stored.where("version >= 1994"), probs))
    gaps = sketches.rank_gaps(li.where("version >= 1994"), VERSION_COLS, prof, probs)
    return gaps.join(prof, "field").select("field", "p", "n", r6("mean").alias("mean"), r6("min").alias("min"), r6("max").alias("max"),
                                           (F.col("gap") <= 2 * sketches.rank_error()).alias("within_bound"))
