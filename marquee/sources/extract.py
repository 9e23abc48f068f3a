"""Row extraction from saved pages and JSON documents.

Every extractor is a built-in expression over a text column (``regexp_*``,
``from_json``, higher-order array functions): a page or document is one row,
``explode`` turns its blocks into rows (the built-in generator replaces a
Python UDTF), and attributes are pulled with ``regexp_extract``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import count_text_to_int, rating_from_class, slug_year

# Fixed patterns of the saved pages (values the extraction depends on):
LINK_RE = r'<a\s+href="([^"]*)"[^>]*>([^<]*)</a>'
TITLE_RE = r"<title>([^<]*)</title>"
H1_RE = r"<h1>([^<]*)</h1>"
LANG_RE = r'<html[^>]*\blang="([^"]*)"'
MEMBER_BLOCK_RE = r'(?s)<td class="table-person">(.*?)</td>'
POSTER_BLOCK_RE = r'(?s)<li class="poster-container">(.*?)</li>'
NEXT_RE = r'<a[^>]*class="next"[^>]*href="([^"]*)"'

DETAILS_SCHEMA = (
    "struct<id: bigint, title: string, release_date: string, runtime: int, original_language: string,"
    " overview: string, budget: bigint, revenue: bigint, popularity: double,"
    " credits: struct<crew: array<struct<job: string, name: string>>, cast: array<struct<name: string>>>,"
    " genres: array<struct<name: string>>, keywords: struct<keywords: array<struct<name: string>>>,"
    " providers: struct<results: map<string, struct<flatrate: array<struct<provider_name: string>>,"
    " rent: array<struct<provider_name: string>>, buy: array<struct<provider_name: string>>>>>>")
SEARCH_SCHEMA = "struct<results: array<struct<id: bigint, release_date: string>>>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """D3 / S14 pattern: one row per anchor, with its position on the page."""
    blocks = F.regexp_extract_all(_c(html), F.lit(LINK_RE), 0)
    ex = pages.select(key, F.posexplode(blocks).alias("pos", "_a"))
    return ex.select(key, "pos", F.regexp_extract("_a", LINK_RE, 1).alias("href"),
                     F.regexp_extract("_a", LINK_RE, 2).alias("text"))


def page_meta(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Title, language, first heading and block counts of each page."""
    h = _c(html)
    return pages.select(
        key, F.regexp_extract(h, LANG_RE, 1).alias("lang"), F.regexp_extract(h, TITLE_RE, 1).alias("title"),
        F.regexp_extract(h, H1_RE, 1).alias("h1"),
        F.size(F.regexp_extract_all(h, F.lit(LINK_RE), 0)).alias("n_links"),
        F.size(F.regexp_extract_all(h, F.lit("<p>"), 0)).alias("n_paragraphs"))


def member_rows(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Member handle, display name and review count from listing pages.

    Count text may carry thousands separators or no-break spaces; anything
    unparseable becomes 0 (X10).
    """
    ex = pages.select(key, F.posexplode(F.regexp_extract_all(_c(html), F.lit(MEMBER_BLOCK_RE), 1)).alias("pos", "_b"))
    return ex.select(
        key, "pos",
        F.regexp_extract("_b", r'href="/([^/"]+)/"', 1).alias("username"),
        F.regexp_extract("_b", r'class="name"[^>]*>([^<]*)<', 1).alias("display_name"),
        count_text_to_int(F.regexp_extract("_b", r'class="count"[^>]*>([^<]*)<', 1)).alias("num_reviews"))


def film_rows(pages: DataFrame, html: str = "html", user: str = "username", explicit_only: bool = True) -> DataFrame:
    """S15 + X8 + X9: film title (img alt), year (attribute, else slug tail), rating (rated-N)."""
    ex = pages.select(user, F.posexplode(F.regexp_extract_all(_c(html), F.lit(POSTER_BLOCK_RE), 1)).alias("pos", "_b"))
    slug = F.regexp_extract("_b", r'data-film-slug="([^"]*)"', 1)
    yattr = F.regexp_extract("_b", r'data-film-release-year="(\d{4})"', 1)
    out = ex.select(
        user, "pos",
        F.regexp_extract("_b", r'alt="([^"]*)"', 1).alias("title"),
        F.coalesce(F.when(yattr != "", yattr.cast("int")), slug_year(slug)).alias("year"),
        rating_from_class(F.regexp_extract("_b", r'class="[^"]*\b(rated-\d+)\b', 1)).alias("rating"),
        slug.alias("film_slug"))
    return out.where(F.col("rating").isNotNull()) if explicit_only else out


def star_rating(block) -> Column:
    """Filled stars + 0.5 per half star; no star at all -> null (Q25)."""
    full = F.size(F.regexp_extract_all(_c(block), F.lit(r"star-full"), 0))
    half = F.size(F.regexp_extract_all(_c(block), F.lit(r"star-half"), 0))
    v = full + F.lit(0.5) * half
    return F.when(v > 0, v)


def next_link(html) -> Column:
    """Href of the a.next link, or null."""
    v = F.regexp_extract(_c(html), NEXT_RE, 1)
    return F.when(v != "", v)


def best_search_hit(search_json, year) -> Column:
    """First result released in ``year`` (release_date starts with it), else the first result.

    ``get`` instead of ``[0]`` because indexing an empty array raises under ANSI.
    """
    res = F.from_json(_c(search_json), SEARCH_SCHEMA)["results"]
    match = F.filter(res, lambda r: F.startswith(r["release_date"], _c(year).cast("string")))
    return F.coalesce(F.get(match, 0), F.get(res, 0))


def parse_details(df: DataFrame, col: str, keep: list[str], cast_cap: int = 10, country: str = "US") -> DataFrame:
    """S19 / S20 over a table: the document is parsed once into a struct column
    (its own projection, so the parse is not repeated per extracted field)."""
    parsed = df.select(*keep, F.from_json(F.col(col), DETAILS_SCHEMA).alias("_d"))
    return parsed.select(*keep, *details_to_row(F.col("_d"), cast_cap, country, parsed=True))


def details_to_row(details_json, cast_cap: int = 10, country: str = "US", parsed: bool = False) -> list[Column]:
    """S19 + S20 + X19-X22: a details document as metadata columns with defaults."""
    d = _c(details_json) if parsed else F.from_json(_c(details_json), DETAILS_SCHEMA)
    empty = F.array().cast("array<string>")
    crew = F.coalesce(d["credits"]["crew"], F.array().cast("array<struct<job: string, name: string>>"))
    directors = F.transform(F.filter(crew, lambda c: c["job"] == "Director"), lambda c: c["name"])
    cast = F.filter(F.transform(F.slice(F.coalesce(d["credits"]["cast"], F.array().cast("array<struct<name: string>>")),
                                        1, cast_cap), lambda c: c["name"]), lambda n: n.isNotNull())
    prov = d["providers"]["results"][country]

    def names(part):
        return F.coalesce(F.transform(prov[part], lambda p: p["provider_name"]), empty)
    return [
        d["id"].alias("tmdb_id"),
        F.coalesce(d["title"], F.lit("")).alias("tmdb_title"),
        F.coalesce(d["release_date"], F.lit("")).alias("release_date"),
        F.coalesce(d["runtime"], F.lit(0)).alias("runtime"),
        F.coalesce(d["original_language"], F.lit("")).alias("original_language"),
        F.coalesce(d["budget"], F.lit(0).cast("bigint")).alias("budget"),
        F.coalesce(d["revenue"], F.lit(0).cast("bigint")).alias("revenue"),
        F.coalesce(d["popularity"], F.lit(0.0)).alias("popularity"),
        F.coalesce(directors, empty).alias("directors"),
        F.coalesce(cast, empty).alias("cast"),
        F.coalesce(F.transform(d["genres"], lambda g: g["name"]), empty).alias("genres"),
        F.coalesce(F.transform(d["keywords"]["keywords"], lambda g: g["name"]), empty).alias("keywords"),
        F.array_distinct(F.concat(names("flatrate"), names("rent"), names("buy"))).alias("streaming_services"),
    ]
