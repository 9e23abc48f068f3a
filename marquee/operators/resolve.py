"""Entity resolution of ratings onto catalogue ids, year repair.

Every lookup is first reduced to one row per join key (last or first in
source order), so no join can fan out, whatever the duplication in the
catalogue. The fact side (ratings) is only ever joined to these key-unique
dimensions; AQE picks broadcast when the lookup is small at runtime and a
skew-aware sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import normalize_title, year_from_date_text


def exact_lookup(catalogue: DataFrame) -> DataFrame:
    """(title, year) -> id, last row in source order wins; null ids excluded.

    Null years are kept as keys but never match, because the join uses ``=``
    (Q3: the reference's dict never matches a missing year).
    """
    c = catalogue.where(F.col("tmdb_id").isNotNull())
    return c.groupBy(F.col("title").alias("lk_title"), F.col("year").alias("lk_year")) \
        .agg(F.max_by("tmdb_id", "seq").alias("exact_id"))


def flexible_lookup(catalogue: DataFrame) -> DataFrame:
    """Normalized title -> id, last wins."""
    c = catalogue.where(F.col("tmdb_id").isNotNull())
    return c.groupBy(normalize_title("title").alias("lk_norm")) \
        .agg(F.max_by("tmdb_id", "seq").alias("flex_id"))


def resolve_two_tier(reviews: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Exact (title, year) match first, then normalized title.

    Adds ``tmdb_id`` and ``match_kind`` in {exact, flexible, none}.
    """
    ex = exact_lookup(catalogue)
    fl = flexible_lookup(catalogue)
    r = reviews.join(ex, (reviews.title == ex.lk_title) & (reviews.year == ex.lk_year), "left")
    r = r.withColumn("_norm", normalize_title("title"))
    r = r.join(fl, r._norm == fl.lk_norm, "left")
    kind = F.when(F.col("exact_id").isNotNull(), "exact") \
        .when(F.col("flex_id").isNotNull(), "flexible").otherwise("none")
    return r.select(*reviews.columns,
                    F.coalesce("exact_id", "flex_id").alias("tmdb_id"),
                    kind.alias("match_kind"))


def resolve_with_null_year_fallback(reviews: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Exact (title, year), else the catalogue row with the same title and no year."""
    ex = exact_lookup(catalogue)
    ny = catalogue.where(F.col("tmdb_id").isNotNull() & F.col("year").isNull()) \
        .groupBy(F.col("title").alias("ny_title")).agg(F.max_by("tmdb_id", "seq").alias("ny_id"))
    r = reviews.join(ex, (reviews.title == ex.lk_title) & (reviews.year == ex.lk_year), "left")
    r = r.join(ny, r.title == ny.ny_title, "left")
    return r.select(*reviews.columns, F.coalesce("exact_id", "ny_id").alias("tmdb_id"))


def repair_catalogue_year(catalogue: DataFrame) -> DataFrame:
    """P5: missing year <- first four characters of release_date."""
    return catalogue.withColumn(
        "year", F.coalesce(F.col("year"), year_from_date_text("release_date")).cast("int"))


def id_year_lookup(catalogue: DataFrame) -> DataFrame:
    """J5 source: id -> year of the first catalogue row with that id."""
    return catalogue.where(F.col("tmdb_id").isNotNull()).groupBy(F.col("tmdb_id").alias("_yid")) \
        .agg(F.min_by("year", "seq").alias("_cat_year"))


def fill_review_years(resolved: DataFrame, repaired_catalogue: DataFrame) -> DataFrame:
    """Fill only missing review years from the catalogue year of the matched id."""
    lk = id_year_lookup(repaired_catalogue)
    j = resolved.join(lk, resolved.tmdb_id == lk._yid, "left")
    return j.withColumn("year", F.coalesce(F.col("year"), F.col("_cat_year")).cast("int")) \
        .drop("_yid", "_cat_year")


def used_catalogue(catalogue: DataFrame, final_reviews: DataFrame) -> DataFrame:
    """Catalogue rows whose id occurs in the final ratings (all such rows kept)."""
    used = final_reviews.select(F.col("tmdb_id").alias("_uid")).distinct()
    return catalogue.join(used, catalogue.tmdb_id == used._uid, "left_semi")


def clean_reviews(reviews: DataFrame, catalogue: DataFrame, repaired: DataFrame) -> DataFrame:
    """R1, ratings: J3 -> J5 -> keep matched -> typed ids. The exact lookup is built from the
    catalogue before its years are repaired (Q21)."""
    filled = fill_review_years(resolve_two_tier(reviews, catalogue), repaired)
    return filled.where(F.col("tmdb_id").isNotNull()) \
        .withColumn("tmdb_id", F.col("tmdb_id").cast("bigint")).drop("match_kind")


def clean_dataset(reviews: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``clean_reviews``, then J8 over the repaired catalogue (P5).

    Returns (final_reviews, final_metadata).
    """
    repaired = repair_catalogue_year(catalogue)
    final_reviews = clean_reviews(reviews, catalogue, repaired)
    return final_reviews, used_catalogue(repaired, final_reviews)


def match_report(resolved: DataFrame) -> DataFrame:
    """Rows per match kind with share of all rows (percent)."""
    total = F.sum("n").over(Window.partitionBy())
    return resolved.groupBy("match_kind").agg(F.count(F.lit(1)).alias("n")) \
        .select("match_kind", "n", F.round(F.col("n") * 100.0 / total, 6).alias("pct"))


# --- match cascades over pre-aggregated lookups (J10-J13) -------------------

def _title_year_first(catalogue: DataFrame, key) -> DataFrame:
    return catalogue.where(F.col("tmdb_id").isNotNull()).groupBy(key.alias("_k"), F.col("year").alias("_y")) \
        .agg(F.min_by("tmdb_id", "seq").alias("_id"), F.min("seq").alias("_s"))


def match_cascade(reviews: DataFrame, catalogue: DataFrame, year_first: bool = False) -> DataFrame:
    """title+year, then title with any year, then title with year +-1.

    Each tier is an equi-join against a lookup with one row per key, so the
    cascade is three 1:1 left joins and no candidate list is materialised.
    With the reference's tier order the +-1 tier can only fire for ratings
    whose title tier already failed, i.e. never (Q6); ``year_first`` puts it
    second.
    """
    ty = _title_year_first(catalogue, F.col("title"))
    t_any = catalogue.where(F.col("tmdb_id").isNotNull()).groupBy(F.col("title").alias("_k")) \
        .agg(F.min_by("tmdb_id", "seq").alias("_id"))
    r = reviews.alias("r")
    exact = ty.select(F.col("_k").alias("e_k"), F.col("_y").alias("e_y"), F.col("_id").alias("e_id"))
    r = r.join(exact, (F.col("r.title") == F.col("e_k")) & (F.col("r.year") == F.col("e_y")), "left")
    anyy = t_any.select(F.col("_k").alias("a_k"), F.col("_id").alias("a_id"))
    r = r.join(anyy, F.col("r.title") == F.col("a_k"), "left")
    # +-1 year: two equi-joins on (title, year - 1) and (title, year + 1); the
    # lower catalogue seq wins between them.
    lo = ty.select(F.col("_k").alias("m_k"), F.col("_y").alias("m_y"), F.col("_id").alias("m_id"),
                   F.col("_s").alias("m_s"))
    hi = ty.select(F.col("_k").alias("p_k"), F.col("_y").alias("p_y"), F.col("_id").alias("p_id"),
                   F.col("_s").alias("p_s"))
    r = r.join(lo, (F.col("r.title") == F.col("m_k")) & (F.col("r.year") - 1 == F.col("m_y")), "left")
    r = r.join(hi, (F.col("r.title") == F.col("p_k")) & (F.col("r.year") + 1 == F.col("p_y")), "left")
    near = F.when(F.col("m_id").isNull(), F.col("p_id")).when(F.col("p_id").isNull(), F.col("m_id")) \
        .when(F.col("m_s") <= F.col("p_s"), F.col("m_id")).otherwise(F.col("p_id"))
    if year_first:
        tiers = [("exact", F.col("e_id")), ("near_year", near), ("title", F.col("a_id"))]
    else:
        tiers = [("exact", F.col("e_id")), ("title", F.col("a_id")), ("near_year", near)]
    tid = F.coalesce(*[t for _, t in tiers])
    kind = F.lit("none")
    for name, t in reversed(tiers):
        kind = F.when(t.isNotNull(), F.lit(name)).otherwise(kind)
    return r.select(*[F.col(f"r.{c}") for c in reviews.columns], tid.alias("tmdb_id"),
                    kind.alias("match_kind"))


def match_case_insensitive(reviews: DataFrame, catalogue: DataFrame) -> DataFrame:
    """lower(title) equality; the year must agree only when the rating has one.

    Picks the first catalogue row (source order). Two 1:1 joins: one on
    (lower title, year) for ratings with a year, one on lower title for the rest.
    """
    c = catalogue.where(F.col("tmdb_id").isNotNull())
    by_ty = c.groupBy(F.lower("title").alias("ty_k"), F.col("year").alias("ty_y")) \
        .agg(F.min_by("tmdb_id", "seq").alias("ty_id"))
    by_t = c.groupBy(F.lower("title").alias("t_k")).agg(F.min_by("tmdb_id", "seq").alias("t_id"))
    r = reviews.withColumn("_lt", F.lower("title"))
    r = r.join(by_ty, (r._lt == by_ty.ty_k) & (r.year == by_ty.ty_y), "left")
    r = r.join(by_t, r._lt == by_t.t_k, "left")
    tid = F.when(F.col("year").isNull(), F.col("t_id")).otherwise(F.col("ty_id"))
    return r.select(*reviews.columns, tid.alias("tmdb_id"))


def match_exact_only(reviews: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Exact (title, year) pairs only; first catalogue row wins; unmatched dropped."""
    lk = catalogue.where(F.col("tmdb_id").isNotNull()).groupBy(
        F.col("title").alias("x_t"), F.col("year").alias("x_y")).agg(F.min_by("tmdb_id", "seq").alias("tmdb_id"))
    return reviews.join(lk, (reviews.title == lk.x_t) & (reviews.year == lk.x_y), "inner") \
        .select(*reviews.columns, "tmdb_id")


def match_exact_else_title(reviews: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Exact (title, year) pair, else the first catalogue row with that title;
    the rating adopts the catalogue year of the chosen row."""
    c = catalogue.where(F.col("tmdb_id").isNotNull())
    ex = c.groupBy(F.col("title").alias("e_t"), F.col("year").alias("e_y")) \
        .agg(F.min_by(F.struct("tmdb_id", "year"), "seq").alias("e"))
    ti = c.groupBy(F.col("title").alias("t_t")).agg(F.min_by(F.struct("tmdb_id", "year"), "seq").alias("t"))
    r = reviews.join(ex, (reviews.title == ex.e_t) & (reviews.year == ex.e_y), "left")
    r = r.join(ti, r.title == ti.t_t, "left")
    hit = F.coalesce(F.col("e"), F.col("t"))
    cols = [c for c in reviews.columns if c != "year"]
    return r.select(*cols, F.coalesce(hit["year"], F.col("year")).alias("year"), hit["tmdb_id"].alias("tmdb_id"))


def enrich_by_title_year(rows: DataFrame, catalogue: DataFrame, cols: list[str]) -> DataFrame:
    """Display fields looked up by (title, year), first catalogue row wins."""
    first = catalogue.groupBy(F.col("title").alias("_t"), F.col("year").alias("_y")) \
        .agg(F.min_by(F.struct(*cols), "seq").alias("_m"))
    j = rows.join(first, (rows.title == first._t) & (rows.year == first._y), "left")
    return j.select(*rows.columns, *[F.col(f"_m.{c}").alias(c) for c in cols])
