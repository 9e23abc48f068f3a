"""Item feature engineering (F1-F13, A36) into a long table.

Output rows are ``(tmdb_id, family, feature, weight)``: a sparse item x feature
matrix whose size is the number of non-zeros, never a dense wide frame.

Fitted parameters follow Spark ML's fit/transform split: quartile edges and
document counts are computed by one aggregate job and applied as literals;
top-N vocabularies are computed with an ordered limit (at most N rows) and
joined back with a broadcast whose size is bounded by N.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import checkpoint

# Fixed values that results depend on:
# decade labels, in order; years >= 2020 fall in the last one
DECADES = ("Pre-1950", "1950s", "1960s", "1970s", "1980s", "1990s", "2000s", "2010s", "2020s")
# budget / revenue bucket labels
MONEY_BUCKETS = ("Zero", "Low", "Medium", "High", "VeryHigh")
# popularity tiers: <= 1, <= 5, above
POPULARITY_TIERS = ("Low", "Medium", "High")
# genres of the fixed one-hot (archived engine)
FIXED_GENRES = ("Action", "Drama", "Comedy", "Thriller", "Horror", "Romance", "Sci-Fi")
# token pattern: maximal runs of letters, digits and underscore (Unicode)
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"

FEATURE_SCHEMA = "tmdb_id bigint, family string, feature string, weight double"


def _rows(df: DataFrame, family: str, feature, weight=None, key: str = "tmdb_id") -> DataFrame:
    weight = F.lit(1.0) if weight is None else weight
    return df.select(F.col(key).cast("bigint").alias("tmdb_id"), F.lit(family).alias("family"),
                     feature.alias("feature"), weight.cast("double").alias("weight")) \
        .where(F.col("feature").isNotNull())


def decade_features(cat: DataFrame) -> DataFrame:
    """decade one-hot; null year gives no row."""
    y = F.col("year")
    label = F.when(y < 1950, F.lit("Pre-1950")).when(y >= 2020, F.lit("2020s")) \
        .otherwise(F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s")))
    return _rows(cat.where(y.isNotNull()), "decade", F.concat(F.lit("decade_"), label))


def fit_quartiles(df: DataFrame, expr) -> list[float] | None:
    """Exact linear-interpolated quartiles of ``expr``, without one buffer for all its values.

    Returns None when there are no values. The result is three numbers, so
    bringing it to the driver is bounded.
    """
    from marquee.operators.profile import exact_percentiles
    lf = df.select(F.lit("v").alias("field"), expr.cast("double").alias("value"))
    q = {r["p"]: r["value"] for r in exact_percentiles(lf, (0.25, 0.5, 0.75)).collect()}
    return [float(q[p]) for p in (0.25, 0.5, 0.75)] if q else None


def runtime_quartile_features(cat: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """runtime quartile one-hot; edges from positive runtimes; <= 0 / null -> none.

    Names are runtime_Q1..Q4 (Q22: edges that round to the same number would
    otherwise give equal names); ``runtime_edges`` reports the edges.
    """
    rt = F.col("runtime")
    if edges is None:
        edges = fit_quartiles(cat.where(rt > 0), rt.cast("double"))
    if edges is None:
        return cat.sparkSession.createDataFrame([], FEATURE_SCHEMA)
    q1, q2, q3 = edges
    label = F.when(rt <= q1, "Q1").when(rt <= q2, "Q2").when(rt <= q3, "Q3").otherwise("Q4")
    return _rows(cat.where(rt > 0), "runtime", F.concat(F.lit("runtime_"), label))


def top_elements(df: DataFrame, col: str, n: int, key: str = "seq", is_list: bool = True) -> DataFrame:
    """K3: the ``n`` most frequent values (count desc, then first appearance).

    Lists count every occurrence (Q28). Result has at most ``n`` rows.
    """
    if is_list:
        ex = df.select(F.col(key).alias("_seq"), F.posexplode(col).alias("_pos", "value"))
    else:
        ex = df.select(F.col(key).alias("_seq"), F.lit(0).alias("_pos"), F.col(col).alias("value")) \
            .where(F.col("value").isNotNull())
    cnt = ex.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_seq", "_pos")).alias("_first"))
    return cnt.orderBy(F.col("n").desc(), F.col("_first").asc()).limit(n).select("value", "n")


def multihot_features(cat: DataFrame, col: str, top_n: int, prefix: str, key: str = "seq",
                      other_bucket: bool = False) -> DataFrame:
    """multi-hot of the top-N list elements; weight 1 per distinct (item, element).

    ``other_bucket=True`` adds ``<prefix>_Other`` for items with an element
    outside the top N (the documented form; the code form has none, Q12).
    """
    top = F.broadcast(top_elements(cat, col, top_n, key).select(F.col("value").alias("_v")))
    ex = cat.select("tmdb_id", F.explode(col).alias("_e")).distinct()
    j = ex.join(top, ex._e == top._v, "left")
    feat = F.when(F.col("_v").isNotNull(), F.concat(F.lit(f"{prefix}_"), F.col("_e")))
    if other_bucket:
        feat = F.coalesce(feat, F.lit(f"{prefix}_Other"))
    return _rows(j, prefix, feat).distinct()


def money_bucket_features(cat: DataFrame, col: str, prefix: str) -> DataFrame:
    """Zero / Low / Medium / High / VeryHigh by quartiles of log1p over positives."""
    v = F.col(col)
    lg = F.log1p(F.when(v > 0, v).otherwise(F.lit(0)).cast("double"))
    edges = fit_quartiles(cat.where(v > 0), lg)
    if edges is None:
        return _rows(cat.where(v == 0), prefix, F.lit(f"{prefix}_Zero"))
    q1, q2, q3 = edges
    label = F.when(v.isNull() | (v <= 0), "Zero").when(lg <= q1, "Low").when(lg <= q2, "Medium") \
        .when(lg <= q3, "High").otherwise("VeryHigh")
    return _rows(cat, prefix, F.concat(F.lit(f"{prefix}_"), label))


def popularity_features(cat: DataFrame) -> DataFrame:
    """<= 1 Low, <= 5 Medium, else High; null -> none (Q15: code, not README)."""
    p = F.col("popularity")
    label = F.when(p <= 1, "Low").when(p <= 5, "Medium").otherwise("High")
    return _rows(cat.where(p.isNotNull()), "popularity", F.concat(F.lit("popularity_"), label))


def language_features(cat: DataFrame, top_n: int = 10, col: str = "original_language") -> DataFrame:
    """one-hot of the top-N languages plus language_Other; null -> none."""
    top = F.broadcast(top_elements(cat, col, top_n, is_list=False).select(F.col("value").alias("_v")))
    c = cat.where(F.col(col).isNotNull())
    j = c.join(top, c[col] == top._v, "left")
    label = F.when(F.col("_v").isNotNull(), F.col(col)).otherwise(F.lit("Other"))
    return _rows(j, "language", F.concat(F.lit("language_"), label))


def tokens(text) -> "F.Column":
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def tfidf(docs: DataFrame, id_col: str, text_col: str, max_features: int | None = 1000,
          lowercase: bool = False, min_len: int = 1, stop_words: list[str] | None = None,
          min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """TF-IDF with smooth idf ln((1+n)/(1+df)) + 1 and L2-normalised rows.

    Steps (all distributed): tokenise -> without df bounds, the top ``max_features`` terms first
    -> (doc, term) counts (map-side combined)
    -> per-term document frequency and corpus count -> df bounds -> top
    ``max_features`` terms by corpus count (term asc on ties; at most that
    many rows, broadcast) -> weights -> per-document L2 norm.
    Returns (doc, term, weight).
    """
    spark = docs.sparkSession
    txt = F.col(text_col)
    if lowercase:
        txt = F.lower(txt)
    d = docs.select(F.col(id_col).alias("doc"), F.coalesce(txt, F.lit("")).alias("_t"))
    n_docs = d.count()
    tok = d.select("doc", F.explode(tokens(F.col("_t"))).alias("term"))
    counted = max_features is not None and min_df <= 1 and max_df >= 1.0
    if min_len > 1:
        tok = tok.where(F.length("term") >= min_len)
    if stop_words:
        sw = spark.createDataFrame([(w,) for w in stop_words], "sw string")
        tok = tok.join(F.broadcast(sw), tok.term == sw.sw, "left_anti")
    if counted:
        # corpus counts alone choose the terms: only chosen ones are counted by document
        chosen = checkpoint(tok.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
                            .orderBy(F.col("total").desc(), F.col("term").asc()).limit(max_features).select("term"))
        tok = tok.join(F.broadcast(chosen), "term", "left_semi")
    tf = tok.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if min_df > 1:
        stats = stats.where(F.col("df") >= min_df)
    if max_df < 1.0:
        stats = stats.where(F.col("df") <= F.lit(max_df * n_docs))
    if counted:
        stats = F.broadcast(stats)
    elif max_features is not None:
        stats = stats.orderBy(F.col("total").desc(), F.col("term").asc()).limit(max_features)
        stats = F.broadcast(stats)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    vocab = stats.select(F.col("term").alias("_term"), idf.alias("idf"))
    w = tf.join(vocab, tf.term == vocab._term).select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy(F.col("doc").alias("_d")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return w.join(norms, w.doc == norms._d).select("doc", "term", (F.col("w") / F.col("_n")).alias("weight"))


def item_features(cat: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """F8: all families as one long table (union; names are disjoint by family prefix)."""
    parts = [
        decade_features(cat),
        runtime_quartile_features(cat),
        multihot_features(cat, "directors", 200, "director"),
        multihot_features(cat, "cast", 500, "cast"),
        multihot_features(cat, "genres", 19, "genre"),
        money_bucket_features(cat, "budget", "budget"),
        money_bucket_features(cat, "revenue", "revenue"),
        language_features(cat),
        popularity_features(cat),
    ]
    if keywords is not None:
        kw = tfidf(keywords, "tmdb_id", "text", 1000)
        parts.append(kw.select(F.col("doc").cast("bigint").alias("tmdb_id"), F.lit("keyword").alias("family"),
                               F.concat(F.lit("keyword_tfidf_"), F.col("term")).alias("feature"),
                               F.col("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_counts(features: DataFrame) -> DataFrame:
    """Distinct features per family."""
    return features.groupBy("family").agg(F.count_distinct("feature").alias("n_features"))


def mode_scaling(features: DataFrame, items: DataFrame, mode: str = "hybrid",
                 cb_weight: float = 0.5, cf_weight: float = 2.0, item: str = "tmdb_id") -> DataFrame:
    """the model's item feature matrix for a mode (Q17: cf_only uses weight 1).

    ``items`` are the interaction items; features of other items are dropped
    (J14) and items without features simply have no content rows.
    """
    ids = items.select(F.col(item).cast("bigint").alias("tmdb_id")).distinct()
    ident_w = 1.0 if mode == "cf_only" else cf_weight
    ident = ids.select("tmdb_id", F.lit("id").alias("family"),
                       F.concat(F.lit("id:"), F.col("tmdb_id").cast("string")).alias("feature"),
                       F.lit(ident_w).alias("weight"))
    if mode == "cf_only":
        return ident
    content = features.join(ids, "tmdb_id", "left_semi") \
        .select("tmdb_id", "family", "feature", (F.col("weight") * cb_weight).alias("weight"))
    if mode == "cb_only":
        return content
    if mode == "hybrid":
        return content.unionByName(ident)
    raise ValueError(f"unknown mode {mode!r}")


def main_other_split(cat: DataFrame, col: str, min_count: int, key: str = "tmdb_id") -> DataFrame:
    """split a list into elements with global frequency >= min_count and the rest.

    Element frequencies are a distributed aggregate joined back by element
    (AQE broadcasts it when small); each item's lists are rebuilt in their
    original order from (position, element) pairs.
    """
    ex = cat.select(F.col(key).alias("_k"), F.posexplode(col).alias("pos", "el"))
    freq = ex.groupBy(F.col("el").alias("_el")).agg(F.count(F.lit(1)).alias("_n"))
    j = ex.join(freq, ex.el == freq._el)
    main = F.array_sort(F.collect_list(F.when(F.col("_n") >= min_count, F.struct("pos", "el"))))
    other = F.array_sort(F.collect_list(F.when(F.col("_n") < min_count, F.struct("pos", "el"))))
    g = j.groupBy("_k").agg(main.alias("_m"), other.alias("_o"))
    g = g.select(F.col("_k").alias(key), F.transform("_m", lambda s: s["el"]).alias(f"{col}_main"),
                 F.transform("_o", lambda s: s["el"]).alias(f"{col}_other"))
    empty = F.array().cast("array<string>")
    base = cat.select(key)
    out = base.join(g, key, "left")
    return out.select(key, F.coalesce(f"{col}_main", empty).alias(f"{col}_main"),
                      F.coalesce(f"{col}_other", empty).alias(f"{col}_other"))


def rare_group_language(cat: DataFrame, min_count: int = 10, col: str = "original_language") -> DataFrame:
    """languages seen fewer than ``min_count`` times become 'other'.

    Null first becomes 'unknown', which is not among the counted languages and
    so also ends as 'other'.
    """
    cnt = cat.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    common = cnt.where(F.col("_n") >= min_count).select("_l")
    j = cat.join(common, cat[col] == common._l, "left")
    grp = F.when(F.col("_l").isNotNull(), F.col(col)).otherwise(F.lit("other"))
    return j.select("tmdb_id", grp.alias("language_group"))


def fixed_genre_features(cat: DataFrame) -> DataFrame:
    """fixed-list genre indicators, has_director / has_cast, numeric defaults (a catalogue without ``vote_average``
    has the default in every row)."""
    vote = F.col("vote_average").cast("double") if "vote_average" in cat.columns else F.lit(None).cast("double")
    cols = [F.col("tmdb_id")]
    for g in FIXED_GENRES:
        cols.append(F.when(F.array_contains(F.coalesce("genres", F.array()), g), 1).otherwise(0)
                    .alias(f"genre_{g.lower().replace('-', '_')}"))
    cols += [
        F.when(F.coalesce(F.size("directors"), F.lit(0)) > 0, 1).otherwise(0).alias("has_known_director"),
        F.when(F.coalesce(F.size("cast"), F.lit(0)) > 0, 1).otherwise(0).alias("has_known_cast"),
        F.coalesce(F.col("year").cast("double"), F.lit(2000.0)).alias("year"),
        F.coalesce(vote, F.lit(6.0)).alias("vote_average"),
        F.coalesce(F.col("popularity").cast("double"), F.lit(1.0)).alias("popularity"),
    ]
    return cat.select(*cols)


# This library's own short English stop list (common function words), used by
# ``tfidf_weighted`` and by its oracle.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "but", "by", "can", "could", "did", "do", "does", "down", "each", "for", "from", "had", "has", "have",
    "he", "her", "here", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most",
    "my", "no", "nor", "not", "now", "of", "off", "on", "only", "or", "other", "our", "out", "over", "own", "same",
    "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this",
    "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where",
    "which", "while", "who", "whom", "why", "will", "with", "you", "your",
)


def zscore_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Z-score with the sample std; a column with std 0 (or null) is left as is."""
    r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
               *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    out = df
    for c in cols:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        if s is not None and s > 0:
            out = out.withColumn(c, (F.col(c) - F.lit(m)) / F.lit(s))
    return out


def tfidf_weighted(df: DataFrame, key: str, fields: list[tuple[str, int, float]], stop_words=None,
                   min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """one TF-IDF per text field (lower-cased, tokens of 2+ characters, stop
    words removed, document-frequency bounds, per-field vocabulary cap), each
    row L2-normalised within its field and then multiplied by the field weight.

    ``fields`` = [(column, max_features, weight)]; list columns are joined with spaces.
    Returns (tmdb_id, family = field, feature = field:term, weight).
    """
    from marquee.functions.text import list_to_text
    sw = STOP_WORDS if stop_words is None else stop_words
    out = None
    for col, cap, w in fields:
        dt = dict(df.dtypes)[col]
        text = list_to_text(col) if dt.startswith("array") else F.coalesce(F.col(col).cast("string"), F.lit(""))
        docs = df.select(F.col(key).alias("_k"), text.alias("_t"))
        t = tfidf(docs, "_k", "_t", max_features=cap, lowercase=True, min_len=2, stop_words=sw,
                  min_df=min_df, max_df=max_df)
        part = t.select(F.col("doc").cast("bigint").alias("tmdb_id"), F.lit(col).alias("family"),
                        F.concat(F.lit(f"{col}:"), F.col("term")).alias("feature"),
                        (F.col("weight") * w).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out
