"""Item extraction and table-level set operations.

A1-A3, J6, J7, K1, A30, U1-U5, S21, S22.

Scale notes: activity counts are map-side combined aggregates; the semi-joins
against them are chosen by AQE (broadcast when the runtime size is small,
otherwise a skew-aware sort-merge join), so a hot user never lands whole in
one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.text import clean_title
from marquee.session import materialise


def ratings_per_user(reviews: DataFrame, user: str = "username") -> DataFrame:
    """A1."""
    return reviews.groupBy(user).agg(F.count(F.lit(1)).alias("n_ratings"))


def ratings_per_item(reviews: DataFrame, item: str = "tmdb_id") -> DataFrame:
    """A2."""
    return reviews.groupBy(item).agg(F.count(F.lit(1)).alias("n_ratings"))


def active_users(reviews: DataFrame, min_reviews: int = 10, user: str = "username") -> DataFrame:
    """J6 source: users with at least ``min_reviews`` rows (counted globally, Q4)."""
    return ratings_per_user(reviews, user).where(F.col("n_ratings") >= min_reviews)


def keep_active_users(reviews: DataFrame, min_reviews: int = 10, user: str = "username") -> DataFrame:
    """Left-semi join to active users."""
    return reviews.join(active_users(reviews, min_reviews, user).select(user), user, "left_semi")


def frequent_items(reviews: DataFrame, min_reviews: int = 5, item: str = "item") -> DataFrame:
    """J7 source: items with at least ``min_reviews`` rows."""
    return ratings_per_item(reviews, item).where(F.col("n_ratings") >= min_reviews)


def leading(df: DataFrame, order: str):
    """What leads the order of the column ``order`` as one number, which a hash aggregate can keep: a whole number itself, of a
    struct that begins with whole numbers the first field, and with it the second if that has 32 bits. Null fields come before all others;
    null where the column is null. None for other columns."""
    kind, column = df.schema[order].dataType, F.col(order)
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    if not isinstance(kind, T.StructType) or not isinstance(kind.fields[0].dataType, T.IntegralType):
        return None
    # decimals: a null field is one less than the least number
    number = F.coalesce(column[kind.fields[0].name].cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)))
    if len(kind.fields) > 1 and isinstance(kind.fields[1].dataType, T.IntegralType) and not isinstance(kind.fields[1].dataType, T.LongType):
        second = F.coalesce(column[kind.fields[1].name].cast("long") + F.lit(1 << 31), F.lit(-1))
        number = number * F.lit(Decimal(1 << 33)) + second.cast("decimal(11,0)")
    return F.when(column.isNotNull(), number)


def unique_items(reviews: DataFrame, min_user_reviews: int = 10, min_item_reviews: int = 5,
                 drop_empty_keys: bool = False, stored: bool = False) -> DataFrame:
    """A3: distinct items by (clean title, year) among active users' ratings.

    ``title`` is the first title in source order (``seq``); ``appearance_count``
    counts ratings; items under ``min_item_reviews`` are dropped (J7 in the
    same aggregate). Sorting (K1) is left to ``sort_unique_items`` so that the
    plan only sorts when a caller wants ordered output.

    With ``stored`` active users and items are written tables, at once: ratings are counted by their own title and year
    in a hash aggregate, with the least of what leads ``seq`` (a min_by over a struct sorts all ratings, whole
    structs with them), and only these rows are cleaned and grouped. Where titles of one item tie in that, the whole
    ``seq`` of its ratings there decides, in a second pass. Without it the result is a plan over the ratings.
    """
    r = reviews.where(F.col("title").isNotNull())
    lead = leading(reviews, "seq") if stored else None
    if lead is None:
        kept = keep_active_users(r, min_user_reviews).withColumn("clean_title", clean_title("title"))
        if drop_empty_keys:
            kept = kept.where(F.col("clean_title") != "")
        g = kept.groupBy("clean_title", "year").agg(
            F.min_by("title", "seq").alias("title"),
            F.count("username").alias("appearance_count"),
        ).where(F.col("appearance_count") >= min_item_reviews)
        return g.select("title", "year", "clean_title", "appearance_count")
    active = materialise(active_users(r, min_user_reviews).select("username"))
    by_title = r.select("username", "title", "year", lead.alias("_lead")).join(active, "username", "left_semi") \
        .groupBy("title", "year").agg(F.min("_lead").alias("_lead"), F.count("username").alias("_n")) \
        .withColumn("clean_title", clean_title("title"))
    if drop_empty_keys:
        by_title = by_title.where(F.col("clean_title") != "")

    def first(h):  # of equal leads the title with the least ``h``
        return F.min_by("title", F.when(F.col("_lead").isNotNull(), F.struct("_lead", h)))

    h = F.xxhash64("title")
    found = materialise(by_title.groupBy("clean_title", "year").agg(
        first(h).alias("title"), first(F.bitwise_not(h)).alias("_other"), F.min("_lead").alias("_lead"),
        F.sum("_n").alias("appearance_count")).where(F.col("appearance_count") >= min_item_reviews))
    tied = found.where(F.col("title") != F.col("_other"))
    if not tied.isEmpty():
        t = tied.select(F.col("clean_title").alias("_c"), F.col("year").alias("_y"), F.col("_lead").alias("_l"))
        own = r.select("username", "title", "year", "seq", lead.alias("_lead"))
        own = own.join(t.select(F.col("_l").alias("_lead")).distinct(), "_lead", "left_semi").join(active, "username", "left_semi")
        own = own.withColumn("clean_title", clean_title("title"))
        own = own.join(t, (own.clean_title == t._c) & own.year.eqNullSafe(t._y) & (own._lead == t._l)) \
            .groupBy("_c", "_y").agg(F.min_by("title", "seq").alias("_title"))
        found = found.join(own, (found.clean_title == own._c) & found.year.eqNullSafe(own._y), "left") \
            .withColumn("title", F.coalesce("_title", "title"))
    return found.select("title", "year", "clean_title", "appearance_count")


def sort_unique_items(items: DataFrame) -> DataFrame:
    """K1: appearances desc, title asc."""
    return items.orderBy(F.col("appearance_count").desc(), F.col("title").asc())


def first_by_key(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Keep the first row per key in source order (never ``dropDuplicates``).

    Implemented as a grouped ``min_by`` over a struct of the row, which is a
    partial (map-side) aggregate: a key that owns a third of the table is
    reduced before the shuffle instead of being sorted whole in one task.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    return df.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("_r")) \
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def append_rows(base: DataFrame, new: DataFrame) -> DataFrame:
    """UNION ALL by column name, no dedup."""
    return base.unionByName(new, allowMissingColumns=True)


def replace_user_rows(base: DataFrame, new: DataFrame, user: str = "username") -> DataFrame:
    """Delete the batch's users from ``base`` then append the batch."""
    kept = base.join(new.select(user).distinct(), user, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_catalogue_rows(catalogue: DataFrame, fresh: DataFrame, key: str = "tmdb_id",
                          order: str = "seq") -> DataFrame:
    """Append fetched catalogue rows, then keep the first row per id."""
    return first_by_key(catalogue.unionByName(fresh, allowMissingColumns=True), [key], order)


def metadata_defaults() -> dict:
    """The value each metadata column takes when nothing was found."""
    return {
        "tmdb_title": F.lit(""), "release_date": F.lit(""), "original_language": F.lit(""),
        "overview": F.lit(""), "poster_path": F.lit(""),
        "runtime": F.lit(0), "budget": F.lit(0).cast("bigint"), "revenue": F.lit(0).cast("bigint"),
        "popularity": F.lit(0.0),
        "directors": F.array().cast("array<string>"), "cast": F.array().cast("array<string>"),
        "genres": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>"),
        "streaming_services": F.array().cast("array<string>"),
    }


def enrich_unique_items(items: DataFrame, found: DataFrame, key_cols=("title", "year"),
                        order: str = "seq") -> DataFrame:
    """J9 + S21: left join found metadata on (title, year), null year matching null year.

    ``found`` is first reduced to one row per key (A30), so the join is 1:1 and
    cannot fan out; the join condition uses ``<=>`` on every key.
    """
    f = first_by_key(found, list(key_cols), order)
    cond = None
    for k in key_cols:
        c = items[k].eqNullSafe(f[k])
        cond = c if cond is None else cond & c
    j = items.join(f, cond, "left")
    extra = [c for c in f.columns if c not in key_cols and c != order]
    defaults = metadata_defaults()
    out = [items[c] for c in items.columns]
    for c in extra:
        out.append(F.coalesce(f[c], defaults[c]).alias(c) if c in defaults else f[c].alias(c))
    return j.select(*out)


def pending_keys(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose keys are not stored yet (idempotent resume)."""
    cond = None
    for k in keys:
        c = todo[k].eqNullSafe(done[k])
        cond = c if cond is None else cond & c
    return todo.join(done.select(*keys), cond, "left_anti")


def per_user_cap(df: DataFrame, cap: int, user: str = "username", order: str = "seq") -> DataFrame:
    """Keep each user's first ``cap`` rows in source order.

    Spark plans ``row_number() <= cap`` as a window group-limit, which keeps
    only ``cap`` rows per user before the window is computed.
    """
    w = Window.partitionBy(user).orderBy(F.col(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def explicit_only(df: DataFrame, threshold: float = 0.0, rating: str = "rating") -> DataFrame:
    """Keep explicit ratings only (present and above ``threshold``)."""
    return df.where(F.col(rating).isNotNull() & (F.col(rating) > threshold))


def check_range(name: str, value: int, lo: int = 1, hi: int = 100) -> int:
    """Validate a request parameter before any plan is built."""
    if not isinstance(value, int) or not lo <= value <= hi:
        raise ValueError(f"{name} must be an integer in [{lo}, {hi}], got {value!r}")
    return value


def top_items(items: DataFrame, n: int) -> DataFrame:
    """K5: the n most popular unique items (appearances desc, title asc) before enrichment."""
    return sort_unique_items(items).limit(n)


def truncate_listing(members: DataFrame, max_users: int, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """K6: the first ``max_users`` members in listing order (page, then position)."""
    return members.orderBy(F.col(page), F.col(pos)).limit(max_users)


def in_model(catalogue: DataFrame, model_items: DataFrame, key: str = "tmdb_id", item: str = "item") -> DataFrame:
    """Catalogue rows whose id is one of the model's items (left-semi)."""
    ids = model_items.select(F.col(item).alias("_mi")).distinct()
    return catalogue.join(ids, catalogue[key] == ids._mi, "left_semi")
