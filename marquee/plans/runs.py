"""Composite jobs: dataset run, feature preparation, reports, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import list_len
from marquee.operators import catalog, features as FE, profile as P, resolve
from marquee.sources import io


def user_status(requested: DataFrame, reviews: DataFrame, user: str = "username") -> DataFrame:
    """Requested users flagged by presence in the rating data."""
    known = reviews.select(F.col(user).alias("_known")).distinct()
    j = requested.join(known, requested[user] == known._known, "left")
    return j.select(*[requested[c] for c in requested.columns if c == user],
                    F.col("_known").isNotNull().alias("exists_in_dataset"),
                    *[requested[c] for c in requested.columns if c not in (user, "display_name")])


def prepare_features(final_metadata: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """R2: F1-F8 over the used catalogue -> long item_features."""
    return FE.item_features(final_metadata, keywords)


def run_dataset(spark: SparkSession, reviews_raw: DataFrame, metadata: DataFrame, out_root: str,
                run_id: str | None = None, min_user_reviews: int = 10, min_item_reviews: int = 5) -> DataFrame:
    """Landed ratings + catalogue -> unique items -> enrichment (J9, S21) -> cleaning -> features (keywords included).

    Every stage output is written as a ``run_id`` partition (which also cuts
    lineage) and gated on being non-empty (S13, record counts, Q14). Readers see the run's tables together, by its
    manifest, once all stages have passed; a run that stops on its way stays unseen. Returns
    the one-row run summary (S8), also written next to the tables. The ratings are computed once, from
    their landed table, and the used catalogue is derived from the written final ratings.
    """
    rid = run_id or io.new_run_id()
    counts = {}

    def stage(df, name):
        """Write a stage's rows, gate on their number, continue from the written table."""
        path = io.write_table(df, out_root, name, rid, mode="overwrite", visible=False)
        out = spark.read.parquet(f"{path}/run_id={rid}")
        counts[name] = io.stage_gate(out, name)
        return out

    raw = stage(reviews_raw, "raw_ratings")
    items = stage(catalog.unique_items(raw, min_user_reviews, min_item_reviews, stored=True), "unique_items")
    found = metadata.select("title", "year", *[c for c in ("runtime", "genres", "directors", "cast", "release_date") if c in metadata.columns], "seq")
    stage(catalog.enrich_unique_items(items, found), "enriched_items")
    repaired = resolve.repair_catalogue_year(metadata)
    fr = stage(resolve.clean_reviews(raw, metadata, repaired), "final_ratings")
    fm = stage(resolve.used_catalogue(repaired, fr), "final_items")
    keywords = fm.select("tmdb_id", F.concat_ws(" ", F.array_join("cast", " "), F.array_join("genres", " ")).alias("text"))
    stage(prepare_features(fm, keywords), "feature_rows")
    summary = io.run_summary(spark, rid, counts,
                             {"min_user_reviews": min_user_reviews, "min_item_reviews": min_item_reviews},
                             fr.select("username", "tmdb_id", F.col("rating").cast("double")))
    summary.coalesce(1).write.mode("overwrite").json(f"{out_root.rstrip('/')}/summary/run_id={rid}")
    io.publish(spark, out_root, rid, counts)
    return summary


def catalogue_report(cat: DataFrame, numeric=("runtime", "budget", "revenue", "popularity", "year"),
                     lists=("genres", "directors", "cast")) -> DataFrame:
    """The catalogue profile as one tidy table (section, field, metric, value)."""
    num = P.numeric_profile(cat, list(numeric))
    metrics = [c for c in num.columns if c != "field"]
    parts = [num.select(F.lit("numeric").alias("section"), "field",
                        F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]),
                                                    F.array(*[F.col(m).cast("double") for m in metrics])))
                        .alias("metric", "value"))]
    lp = P.list_profile(cat, list(lists))
    lm = [c for c in lp.columns if c != "field"]
    parts.append(lp.select(F.lit("list").alias("section"), "field",
                           F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in lm]),
                                                       F.array(*[F.col(m).cast("double") for m in lm])))
                           .alias("metric", "value")))
    comp = P.completeness(cat, list(lists), [c for c in numeric])
    parts.append(comp.select(F.lit("completeness").alias("section"), "field", F.lit("complete_pct").alias("metric"),
                             F.col("complete_pct").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_rows(recs: DataFrame) -> DataFrame:
    """Display fields of recommended (or catalogue) rows: top-5 cast, money text,
    services or 'Not available'."""
    def money(c):
        return F.when(F.col(c) > 0, F.concat(F.lit("$"), F.format_number(F.col(c).cast("double"), 0))) \
            .otherwise(F.lit("Unknown"))
    services = F.coalesce(F.col("streaming_services"), F.array().cast("array<string>")) \
        if "streaming_services" in recs.columns else F.array().cast("array<string>")
    return recs.select(
        "tmdb_id",
        F.concat(F.col("title"), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("Unknown")), F.lit(")")).alias("heading"),
        F.when(F.col("runtime") > 0, F.concat(F.col("runtime").cast("string"), F.lit(" min"))).otherwise(F.lit("Unknown")).alias("runtime_text"),
        F.array_join(F.slice(F.coalesce("cast", F.array().cast("array<string>")), 1, 5), ", ").alias("top_cast"),
        F.array_join(F.coalesce("directors", F.array().cast("array<string>")), ", ").alias("directors_text"),
        money("budget").alias("budget_text"), money("revenue").alias("revenue_text"),
        F.when(list_len(services) > 0, F.array_join(services, ", ")).otherwise(F.lit("Not available")).alias("services"))


def ingest_ratings(base: DataFrame, batch: DataFrame, catalogue: DataFrame, mode: str = "replace") -> DataFrame:
    """Match a batch of collected ratings to the catalogue (J13) and merge it.

    ``mode='replace'`` drops the batch users' old rows first (U2, default,
    Q23); ``'append'`` only adds (U1). Unmatched batch rows are dropped; the
    caller can check the match count (the reference raises when it is 0).
    """
    matched = resolve.match_case_insensitive(batch, catalogue).where(F.col("tmdb_id").isNotNull())
    if mode == "replace":
        return catalog.replace_user_rows(base, matched)
    if mode == "append":
        return catalog.append_rows(base, matched)
    raise ValueError(mode)


def acceptance_report(recs: DataFrame, requested: DataFrame, reviews: DataFrame, top: int = 5) -> DataFrame:
    """Per requested user: status, top recommendations with seen flags.

    ``recs`` has (user, rank, item, already_reviewed); the per-user list holds
    at most ``top`` entries, so the collect is bounded.
    """
    st = user_status(requested, reviews, "user")
    r = recs.where(F.col("rank") <= top)
    g = r.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("rank", "item", "already_reviewed"))).alias("top"))
    return st.join(g, "user", "left")
