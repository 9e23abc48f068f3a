"""Queries: interactions, scoring, top-N, evaluation, factor models (M*, A24-A35, J14-J19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.vector import dot, r6
from marquee.operators import features as FE
from marquee.operators import interactions as I
from marquee.operators import score as S
from marquee.operators.factor import vector_of, vsums
from marquee.plans.oracle_views import with_views
from marquee.plans.registry import query
from marquee.session import materialise
from marquee.sources import views as V

# ------------------------------------------------------------------ shared views

INTER_SQL = with_views("reviews", "catalogue") + """
, inter AS (SELECT username AS "user", item, CAST(arg_max(rating, seq) AS DOUBLE) AS rating
            FROM reviews GROUP BY username, item)
, split AS (SELECT *, (CAST(substr("user", 2) AS BIGINT) * 31 + item * 17) % 100 < 20 AS is_test FROM inter)
, train AS (SELECT "user", item, rating FROM split WHERE NOT is_test)
, test AS (SELECT "user", item, rating FROM split WHERE is_test)
"""


def inter(spark, sf):
    return I.build_interactions(V.reviews(spark, sf), item="item")


def split(spark, sf):
    key = (F.expr("substr(user, 2)").cast("bigint") * 31 + F.col("item") * 17) % 100
    return I.hash_split(inter(spark, sf), 20, key=key)


def train_test(spark, sf):
    s = materialise(split(spark, sf))  # both sides, read more than once
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")


@query("interactions_last", INTER_SQL + 'SELECT "user", item, rating FROM inter')
def q_interactions_last(spark, sf):
    return inter(spark, sf)


@query("interactions_sum", with_views("reviews") + """
SELECT username AS "user", item, CAST(sum(rating) AS DOUBLE) AS rating FROM reviews GROUP BY username, item
""")
def q_interactions_sum(spark, sf):
    return I.build_interactions(V.reviews(spark, sf), item="item", dup_policy="sum")


@query("density", INTER_SQL + """
SELECT count(DISTINCT "user") AS users, count(DISTINCT item) AS items, count(*) AS interactions,
       round(count(*) / (count(DISTINCT "user") * count(DISTINCT item)), 6) AS density,
       round(avg(rating), 6) AS rating_mean, round(stddev_samp(rating), 6) AS rating_std FROM inter
""")
def q_density(spark, sf):
    return I.density(inter(spark, sf))


@query("dense_ids", with_views("reviews") + """
SELECT username, row_number() OVER (ORDER BY username) - 1 AS idx FROM (SELECT DISTINCT username FROM reviews)
""")
def q_dense_ids(spark, sf):
    return I.dense_index(V.reviews(spark, sf), "username")


@query("dense_ids_first_seen", with_views("reviews") + """
SELECT item, row_number() OVER (ORDER BY min(seq), item) - 1 AS idx FROM reviews GROUP BY item
""")
def q_dense_ids_first_seen(spark, sf):
    """M1: items numbered in the order of their first rating."""
    return I.dense_index(V.reviews(spark, sf), "item", first_seen="seq")


@query("holdout_split", INTER_SQL + 'SELECT "user", item, rating, is_test FROM split')
def q_holdout_split(spark, sf):
    return split(spark, sf)


@query("hash_sample", INTER_SQL + """
SELECT "user", item, rating FROM inter ORDER BY (item * 2654435761 + CAST(substr("user", 2) AS BIGINT)) % 1000003,
       "user", item LIMIT 500
""")
def q_hash_sample(spark, sf):
    # M11 with an arithmetic key the oracle can reproduce; the library default is xxhash64.
    it = inter(spark, sf)
    k = (F.col("item") * 2654435761 + F.expr("substr(user, 2)").cast("bigint")) % 1000003
    return it.orderBy(k, "user", "item").limit(500)


# ------------------------------------------------------------------ neighbours over embeddings

EMB_UNIT = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)
, pairs AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_dot_product(a.v, b.v) AS sim
            FROM u a JOIN u b ON a.vec_id <> b.vec_id)
, top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS rank FROM pairs)
"""


def neighbours(spark, sf, k=10):
    return S.cosine_neighbours(V.embeddings(spark, sf), k, key="vec_id")


@query("item_neighbours", EMB_UNIT + """
SELECT id AS vec_id, neighbour, round(sim, 6) AS similarity, rank FROM top WHERE rank <= 10
""")
def q_item_neighbours(spark, sf):
    n = neighbours(spark, sf)
    return n.select("vec_id", "neighbour", r6("similarity").alias("similarity"), "rank")


@query("precision_recall_ndcg", EMB_UNIT + """
, lab AS (SELECT vec_id, label FROM embeddings)
, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
, hits AS (SELECT t.id, t.rank, (la.label = lb.label) AS hit FROM top t JOIN lab la ON t.id = la.vec_id
           JOIN lab lb ON t.neighbour = lb.vec_id WHERE t.rank <= 10)
, per AS (SELECT h.id, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS hits,
                 sum(CASE WHEN hit THEN 1.0 / log2(rank + 1) ELSE 0 END) AS dcg, any_value(s.n) - 1 AS relevant
          FROM hits h JOIN lab l ON h.id = l.vec_id JOIN sizes s ON l.label = s.label GROUP BY h.id)
, idcg AS (SELECT r AS m, sum(1.0 / log2(g + 1)) OVER (ORDER BY r) AS ideal FROM range(1, 11) t(r), range(1, 11) u(g) WHERE g = r)
SELECT round(avg(hits / 10.0), 6) AS precision_at_k,
       round(avg(CASE WHEN relevant > 0 THEN hits * 1.0 / relevant END), 6) AS recall_at_k,
       round(avg(CASE WHEN relevant > 0 THEN dcg / i.ideal END), 6) AS ndcg_at_k, 10 AS k, count(*) AS n_queries
FROM per LEFT JOIN idcg i ON i.m = least(per.relevant, 10)
""")
def q_precision_recall_ndcg(spark, sf):
    from marquee.operators.evaluate import ranking_metrics
    emb = V.embeddings(spark, sf)
    top = neighbours(spark, sf).select(F.col("vec_id").alias("user"), F.col("neighbour").alias("item"), "rank")
    lab = emb.select("vec_id", "label")
    # relevance counts per query come from label sizes; same-label pairs are never listed
    sizes = lab.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant"))
    hits = top.join(lab.withColumnRenamed("vec_id", "user").withColumnRenamed("label", "ul"), "user") \
        .join(lab.withColumnRenamed("vec_id", "item").withColumnRenamed("label", "il"), "item") \
        .withColumn("hit", F.col("ul") == F.col("il"))
    n_rel = lab.join(sizes, "label").select(F.col("vec_id").alias("user"), "relevant")
    return ranking_metrics(hits.select("user", "item", "rank", "hit"), n_rel, 10)


CENTROID_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
, d AS (SELECT label, u.pos, avg(u.x) AS x FROM e, unnest(e.v) WITH ORDINALITY AS u(x, pos) GROUP BY label, u.pos)
, c AS (SELECT label, list(x ORDER BY pos) AS v FROM d GROUP BY label)
, s AS (SELECT c.label, e.vec_id AS item, list_dot_product(c.v, e.v) AS score FROM c, e)
, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, item) AS rank FROM s)
SELECT label, item, round(score, 6) AS score, rank FROM r WHERE rank <= 20
"""


@query("dot_topn", CENTROID_SQL)
def q_dot_topn(spark, sf):
    """Top-20 items for each label centroid by dot product."""
    from pyspark.ml.stat import Summarizer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    e = V.embeddings(spark, sf).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    cent = e.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("factors"))
    top = S.blocked_topk(cent.select(F.col("label").alias("user"), "factors"),
                         e.select(F.col("vec_id").alias("item"), F.col("v").alias("factors")), 20)
    return top.select(F.col("user").alias("label"), "item", r6("score").alias("score"), "rank")


# ------------------------------------------------------------------ deterministic dense model on ratings

DENSE_SQL = INTER_SQL + """
, iv AS (SELECT tmdb_id AS item, popularity / 10.0 AS v0, (coalesce(year, 1990) - 1940) / 86.0 AS v1,
                (tmdb_id % 13) / 13.0 AS v2, CASE WHEN budget > 0 THEN 1.0 ELSE 0.0 END AS v3 FROM catalogue)
, uv AS (SELECT t."user", sum(t.rating * iv.v0) / sum(t.rating) AS u0, sum(t.rating * iv.v1) / sum(t.rating) AS u1,
                sum(t.rating * iv.v2) / sum(t.rating) AS u2, sum(t.rating * iv.v3) / sum(t.rating) AS u3
         FROM train t JOIN iv ON t.item = iv.item GROUP BY t."user")
, sc AS (SELECT uv."user", iv.item, ((u0 * v0 + u1 * v1) + u2 * v2) + u3 * v3 AS score FROM uv, iv)
"""


def weighted_means(rated, n):
    """(user, factors): the rating-weighted mean of the ``n`` factors over a user's rows (user, rating, factors)."""
    sums = rated.groupBy("user").agg(*vsums("factors", n, F.col("rating")), F.sum("rating").alias("_w"))
    return sums.select("user", F.transform(vector_of(n), lambda x: x / F.col("_w")).alias("factors"))


def dense_model(spark, sf):
    """Item vectors from catalogue fields; user vector = rating-weighted mean over training items."""
    cat = V.catalogue(spark, sf)
    iv = cat.select(F.col("tmdb_id").alias("item"), F.array(
        F.col("popularity") / 10.0, (F.coalesce("year", F.lit(1990)) - 1940) / 86.0,
        (F.col("tmdb_id") % 13) / 13.0, F.when(F.col("budget") > 0, 1.0).otherwise(0.0)).alias("factors"))
    train, test = train_test(spark, sf)
    j = train.join(iv, "item")
    uv = weighted_means(j, 4)
    # model outputs are materialised once (lineage cut; scoring and block sizing re-read them cheaply)
    from marquee.session import checkpoint
    return checkpoint(uv), checkpoint(iv), train, test


@query("topn_unseen", DENSE_SQL + """
, seen AS (SELECT DISTINCT username AS "user", item FROM reviews)
, c AS (SELECT sc.* FROM sc WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s."user" = sc."user" AND s.item = sc.item))
, r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM c)
SELECT "user", item, round(score, 6) AS score, rank FROM r WHERE rank <= 20
""")
def q_topn_unseen(spark, sf):
    """Top-20 among items the user never rated (anti-join before the cut)."""
    uv, iv, _, _ = dense_model(spark, sf)
    seen = V.reviews(spark, sf).select(F.col("username").alias("user"), "item").distinct()
    top = S.blocked_topk(uv, iv, 20, seen=seen)
    return top.select("user", "item", r6("score").alias("score"), "rank")


@query("recommendations", DENSE_SQL + """
, seen AS (SELECT DISTINCT username AS "user", item FROM reviews)
, r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM sc)
, meta AS (SELECT tmdb_id AS item, title, year, runtime, genres FROM catalogue)
SELECT r."user", r.rank, r.item, round(r.score, 6) AS score, m.title, m.year, m.runtime, m.genres,
       s.item IS NOT NULL AS already_reviewed
FROM r LEFT JOIN meta m ON r.item = m.item LEFT JOIN seen s ON s."user" = r."user" AND s.item = r.item
WHERE r.rank <= 5
""")
def q_recommendations(spark, sf):
    """Top-5 (seen included) enriched with metadata and the seen flag."""
    uv, iv, _, _ = dense_model(spark, sf)
    top = S.blocked_topk(uv, iv, 5)
    seen = V.reviews(spark, sf).select(F.col("username").alias("user"), "item")
    meta = V.catalogue(spark, sf).select("tmdb_id", "title", "year", "runtime", "genres", "seq")
    out = S.enrich(top, meta, seen)
    return out.select("user", "rank", "item", r6("score").alias("score"), "title", "year", "runtime", "genres",
                      "already_reviewed")


BLENDED_SQL = DENSE_SQL + """
, xv AS (SELECT tmdb_id AS item, runtime / 200.0 AS c0, CASE WHEN revenue > 0 THEN 1.0 ELSE 0.0 END AS c1, (tmdb_id % 5) / 5.0 AS c2 FROM catalogue)
, xu AS (SELECT t."user", sum(t.rating * c0) / sum(t.rating) AS w0, sum(t.rating * c1) / sum(t.rating) AS w1, sum(t.rating * c2) / sum(t.rating) AS w2
         FROM train t JOIN xv ON t.item = xv.item GROUP BY t."user")
, mo AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM sc)
, seen AS (SELECT DISTINCT username AS "user", item FROM reviews)
, two AS (SELECT sc."user", sc.item, sc.score AS cf, (w0 * c0 + w1 * c1) + w2 * c2 AS cb, ((1.0 / 3) * c0 + (1.0 / 3) * c1) + (1.0 / 3) * c2 AS mean
          FROM sc JOIN xu ON xu."user" = sc."user" JOIN xv ON xv.item = sc.item
          WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s."user" = sc."user" AND s.item = sc.item))
, v AS (SELECT 'raw' AS variant, "user", item, greatest(1.0, least(10.0, 0.7 * cf + 0.3 * cb)) AS score FROM two
        UNION ALL SELECT 'raw_mean', "user", item, greatest(0.5, least(10.0, 0.7 * cf + 0.3 * mean)) FROM two
        UNION ALL SELECT 'zscore', "user", item,
               greatest(1.0, least(10.0, (0.7 * greatest(0.0, least(1.0, ((cf - m) / s + 3.0) / 6.0)) + 0.3 * cb) * 10.0)) FROM two, mo)
, r AS (SELECT *, row_number() OVER (PARTITION BY variant, "user" ORDER BY score DESC, item) AS rank FROM v)
SELECT variant, "user", item, round(score, 6) AS score, rank FROM r WHERE rank <= 10
"""


@query("blended_topn", BLENDED_SQL)
def q_blended_topn(spark, sf):
    """M9 / M7: the ten best unseen items of every user under each of the three blends, by the threshold algorithm.
    Content score: the rating-weighted mean profile of the user's items times the item's content vector; for
    'raw_mean' the mean of the item's content fields."""
    from marquee.operators.blended import BlendedModel
    from marquee.operators.factor import score_moments
    from marquee.operators.score import blend
    from marquee.session import checkpoint
    uv, iv, train, _ = dense_model(spark, sf)
    content = V.catalogue(spark, sf).select(F.col("tmdb_id").alias("item"), F.array(
        F.col("runtime") / 200.0, F.when(F.col("revenue") > 0, 1.0).otherwise(0.0), (F.col("tmdb_id") % 5) / 5.0).alias("factors"))
    profile = checkpoint(weighted_means(train.join(content, "item"), 3))
    moments = score_moments(uv, iv).first()
    mean_, std_ = moments.cf_mean, moments.cf_std
    seen = checkpoint(V.reviews(spark, sf).select(F.col("username").alias("user"), "item").distinct())
    own = BlendedModel(uv, iv, profile, content)
    mean = BlendedModel(uv, iv, uv.select("user", F.array(*[F.lit(1.0 / 3)] * 3).alias("factors")), content)
    out = None
    for variant, model in (("raw", own), ("raw_mean", mean), ("zscore", own)):
        top = model.top(10, lambda cf, cb, v=variant: blend(cf, cb, 0.7, v, mean_, std_), seen)
        top = top.select(F.lit(variant).alias("variant"), "user", "item", r6("score").alias("score"), "rank")
        out = top if out is None else out.unionByName(top)
    return out


@query("auc", DENSE_SQL + """
, tp AS (SELECT DISTINCT "user", item FROM test)
, pos AS (SELECT tp."user", tp.item, sc.score FROM tp JOIN sc ON tp."user" = sc."user" AND tp.item = sc.item)
, neg AS (SELECT sc.* FROM sc WHERE sc."user" IN (SELECT "user" FROM pos)
          AND NOT EXISTS (SELECT 1 FROM tp WHERE tp."user" = sc."user" AND tp.item = sc.item)
          AND NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = sc."user" AND t.item = sc.item))
, cnt AS (SELECT p."user", p.item, sum(CASE WHEN n.score < p.score THEN 1.0 WHEN n.score = p.score THEN 0.5 ELSE 0 END) AS lower,
                 count(*) AS nneg FROM pos p JOIN neg n ON p."user" = n."user" GROUP BY p."user", p.item)
, per AS (SELECT "user", sum(lower) / (count(*) * max(nneg)) AS auc FROM cnt GROUP BY "user")
SELECT round(avg(auc), 6) AS auc, count(*) AS users FROM per
""")
def q_auc(spark, sf):
    """Mean per-user AUC of the held-out positives against the items that the user has not rated."""
    uv, iv, train, test = dense_model(spark, sf)
    per = S.blocked_auc(uv, iv, test.select("user", "item"), exclude=train.select("user", "item"))
    return per.agg(r6(F.avg("auc")).alias("auc"), F.count(F.lit(1)).alias("users"))


@query("precision_recall_at_k", DENSE_SQL + """
, tp AS (SELECT DISTINCT "user", item FROM test)
, c AS (SELECT sc.* FROM sc WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = sc."user" AND t.item = sc.item))
, r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM c)
, hits AS (SELECT tp."user", count(r.item) AS hits, any_value(n.n) AS n_test,
                  sum(CASE WHEN r.item IS NOT NULL THEN 1.0 / log2(r.rank + 1) ELSE 0 END) AS dcg
           FROM tp LEFT JOIN r ON r."user" = tp."user" AND r.item = tp.item AND r.rank <= 25
           JOIN (SELECT "user", count(*) AS n FROM tp GROUP BY "user") n ON n."user" = tp."user"
           GROUP BY tp."user")
, idcg AS (SELECT r AS m, sum(1.0 / log2(r + 1)) OVER (ORDER BY r) AS ideal FROM range(1, 26) t(r))
SELECT round(avg(hits / 25.0), 6) AS precision_at_k, round(avg(hits * 1.0 / n_test), 6) AS recall_at_k,
       round(avg(dcg / i.ideal), 6) AS ndcg_at_k, 25 AS k, count(*) AS n_queries
FROM hits JOIN idcg i ON i.m = least(hits.n_test, 25)
""")
def q_precision_recall_at_k(spark, sf):
    """A32 / A33 / A35 on a real hold-out with training positives masked (Q13)."""
    from marquee.operators.evaluate import ranking_metrics
    uv, iv, train, test = dense_model(spark, sf)
    top = S.blocked_topk(uv, iv, 25, seen=train.select("user", "item"))
    tp = test.select("user", "item").distinct()
    hits = tp.join(top, ["user", "item"], "inner").select("user", "item", "rank", F.lit(True).alias("hit"))
    n_rel = tp.groupBy("user").agg(F.count(F.lit(1)).alias("relevant"))
    return ranking_metrics(hits, n_rel, 25)


# ------------------------------------------------------------------ rating prediction and errors

CB_SQL = DENSE_SQL + """
, f AS (""" + " UNION ALL ".join(["""
SELECT tmdb_id, 'decade_' || CASE WHEN year < 1950 THEN 'Pre-1950' WHEN year >= 2020 THEN '2020s'
       ELSE CAST(CAST(floor(year / 10) * 10 AS INTEGER) AS VARCHAR) || 's' END AS feature, 1.0 AS weight
FROM catalogue WHERE year IS NOT NULL""", """
SELECT tmdb_id, 'popularity_' || CASE WHEN popularity <= 1 THEN 'Low' WHEN popularity <= 5 THEN 'Medium' ELSE 'High' END,
       1.0 FROM catalogue WHERE popularity IS NOT NULL""", """
SELECT tmdb_id, 'genre_' || g, 1.0 FROM (SELECT DISTINCT tmdb_id, unnest(genres) AS g FROM catalogue)"""]) + """)
, fn AS (SELECT tmdb_id, sqrt(sum(weight * weight)) AS n FROM f GROUP BY tmdb_id)
, x AS (SELECT f.tmdb_id AS item, f.feature, f.weight / fn.n AS weight FROM f JOIN fn ON f.tmdb_id = fn.tmdb_id WHERE fn.n > 0)
, prof AS (SELECT t."user", x.feature, sum(t.rating * x.weight) AS r_sum, sum(x.weight) AS s_sum
           FROM train t JOIN x ON t.item = x.item GROUP BY t."user", x.feature)
, nd AS (SELECT p."user", p.item, sum(x.weight * pr.r_sum) AS num, sum(x.weight * pr.s_sum) AS den
         FROM test p JOIN x ON p.item = x.item JOIN prof pr ON pr."user" = p."user" AND pr.feature = x.feature
         GROUP BY p."user", p.item)
, um AS (SELECT "user", avg(rating) AS m FROM train GROUP BY "user")
, cb AS (SELECT p."user", p.item, p.rating, CASE WHEN nd.den > 0 THEN nd.num / nd.den WHEN um.m IS NOT NULL THEN um.m ELSE 0.5 END AS cb
         FROM test p LEFT JOIN nd ON nd."user" = p."user" AND nd.item = p.item LEFT JOIN um ON um."user" = p."user")
, g AS (SELECT avg(rating) AS g FROM train)
, im AS (SELECT item, avg(rating) AS m FROM train GROUP BY item)
, base AS (SELECT p."user", p.item, p.rating,
                  CASE WHEN um.m IS NULL OR im.m IS NULL THEN 6.0 ELSE um.m + im.m - g.g END AS pred
           FROM test p LEFT JOIN um ON um."user" = p."user" LEFT JOIN im ON im.item = p.item, g)
"""


def cb_features(spark, sf):
    cat = V.catalogue(spark, sf)
    f = FE.decade_features(cat).unionByName(FE.popularity_features(cat)).unionByName(
        cat.select(F.col("tmdb_id"), F.explode("genres").alias("g")).distinct()
        .select("tmdb_id", F.lit("genre").alias("family"), F.concat(F.lit("genre_"), "g").alias("feature"),
                F.lit(1.0).alias("weight")))
    return S.unit_rows(f)


@query("content_score", CB_SQL + 'SELECT "user", item, round(cb, 6) AS cb FROM cb')
def q_content_score(spark, sf):
    """M6 for every held-out pair, from training ratings only."""
    train, test = train_test(spark, sf)
    out = S.content_scores(test.select("user", "item"), train, cb_features(spark, sf))
    return out.select("user", "item", r6("cb").alias("cb"))


@query("baseline_means", CB_SQL + 'SELECT "user", item, round(pred, 6) AS pred FROM base')
def q_baseline_means(spark, sf):
    """A26 + P13 + M17: baseline predictions for the held-out pairs."""
    train, test = train_test(spark, sf)
    out = S.baseline_predictions(test.select("user", "item"), train)
    return out.select("user", "item", r6("pred").alias("pred"))


@query("rmse_mae", CB_SQL + """
SELECT round(sqrt(avg((pred - rating) * (pred - rating))), 6) AS rmse, round(avg(abs(pred - rating)), 6) AS mae,
       round(sqrt(avg((pred - rating) * (pred - rating))) * 10, 6) AS rmse_pct, round(avg(abs(pred - rating)) * 10, 6) AS mae_pct,
       count(*) AS n FROM base
""")
def q_rmse_mae(spark, sf):
    """Errors of the baseline predictor on the hold-out (percent of a 10-point scale)."""
    from marquee.operators.evaluate import rating_errors
    train, test = train_test(spark, sf)
    pred = S.baseline_predictions(test, train)
    return rating_errors(pred, "pred", "rating", scale=10.0)


@query("blend", CB_SQL + """
SELECT b."user", b.item, round(greatest(1.0, least(10.0, 0.7 * b.pred + 0.3 * c.cb)), 6) AS score
FROM base b JOIN cb c ON b."user" = c."user" AND b.item = c.item
""")
def q_blend(spark, sf):
    """M7 (raw variant): 0.7 * CF + 0.3 * CB clipped to [1, 10]; CF = baseline, CB = content."""
    train, test = train_test(spark, sf)
    tp = test.select("user", "item")
    base = S.baseline_predictions(tp, train)
    cb = S.content_scores(tp, train, cb_features(spark, sf))
    j = base.join(cb, ["user", "item"])
    return j.select("user", "item", r6(S.blend(F.col("pred"), F.col("cb"), 0.7, "raw")).alias("score"))


@query("predict_pairs", DENSE_SQL + """
SELECT t."user", t.item, round(((u0 * v0 + u1 * v1) + u2 * v2) + u3 * v3, 6) AS score
FROM test t JOIN uv ON t."user" = uv."user" JOIN iv ON t.item = iv.item
""")
def q_predict_pairs(spark, sf):
    """Score given (user, item) pairs: pairs JOIN user factors JOIN item factors, then dot."""
    uv, iv, _, test = dense_model(spark, sf)
    j = test.select("user", "item").join(uv.withColumnRenamed("factors", "uf"), "user") \
        .join(iv.withColumnRenamed("factors", "vf"), "item")
    return j.select("user", "item", r6(dot("uf", "vf")).alias("score"))


# ------------------------------------------------------------------ factor models (rows-only checks)

@query("svd_topn_unseen")
def q_svd_topn_unseen(spark, sf):
    """M4 -> M9: truncated SVD (k=25) and the top-25 unseen items of every user."""
    from marquee.operators.factor import truncated_svd
    it = materialise(inter(spark, sf))
    uf, vf, _ = truncated_svd(it, k=25)
    top = S.blocked_topk(uf.withColumnRenamed("user", "user"), vf, 25, seen=it.select("user", "item"))
    return top.select("user", "item", r6("score").alias("score"), "rank")


@query("svd_score_moments")
def q_svd_score_moments(spark, sf):
    """A27 over the SVD factors: all user x item pairs."""
    from marquee.operators.factor import score_moments, truncated_svd
    uf, vf, _ = truncated_svd(inter(spark, sf), k=25)
    return score_moments(uf, vf)


@query("train_hybrid")
def q_train_hybrid(spark, sf):
    """M3: hybrid ranking-loss factorisation; top-10 unseen per user."""
    from marquee.operators.hybrid import HybridModel
    train, test = train_test(spark, sf)
    items = train.select("item").union(test.select("item")).distinct()
    feats = FE.mode_scaling(cb_features(spark, sf).withColumnRenamed("item", "tmdb_id")
                            .withColumn("family", F.lit("content")),
                            items.withColumnRenamed("item", "tmdb_id"), "hybrid")
    model = HybridModel(k=32, epochs=5, loss="warp").fit(train, feats)
    return model.recommend(train.select("user").distinct(), 10, seen=train)


@query("evaluate_modes")
def q_evaluate_modes(spark, sf):
    """The three modes on one split -> (mode, precision, recall, ndcg, auc)."""
    from marquee.operators.evaluate import evaluate_modes
    train, test = train_test(spark, sf)
    return evaluate_modes(train, test, cb_features(spark, sf), k=25, epochs=5, dims=32)
