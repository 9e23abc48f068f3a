"""Queries: extraction from saved pages and JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.sources import extract as X
from marquee.plans.registry import query
from marquee.sources import views as V

LINK_SQL = X.LINK_RE.replace("'", "''")


@query("page_links", f"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK_SQL}')) AS a,
                  CAST(generate_subscripts(regexp_extract_all(html, '{LINK_SQL}'), 1) - 1 AS INTEGER) AS pos FROM pages)
SELECT page_id, pos, regexp_extract(a, '{LINK_SQL}', 1) AS href, regexp_extract(a, '{LINK_SQL}', 2) AS text FROM a
""")
def q_page_links(spark, sf):
    return X.links(V.pages(spark, sf))


@query("page_meta", f"""
SELECT page_id, regexp_extract(html, '{X.LANG_RE.replace("\\b", "")}', 1) AS lang,
       regexp_extract(html, '{X.TITLE_RE}', 1) AS title, regexp_extract(html, '{X.H1_RE}', 1) AS h1,
       CAST(len(regexp_extract_all(html, '{LINK_SQL}')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_paragraphs
FROM pages
""")
def q_page_meta(spark, sf):
    return X.page_meta(V.pages(spark, sf))


@query("event_props", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k,
       coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events
""")
def q_event_props(spark, sf):
    """JSON field access with defaults."""
    e = V.events(spark, sf)
    return e.select("event_id",
                    F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)).alias("k"),
                    F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


DOC_SQL = """
WITH src AS (SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
, docs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(json_object(
    'id', l_partkey, 'title', 't' || CAST(l_partkey AS VARCHAR), 'release_date', strftime(o_orderdate, '%Y-%m-%d'),
    'runtime', l_linenumber * 30,
    'credits', json_object(
        'crew', json_array(json_object('job', 'Director', 'name', 's' || CAST(l_suppkey AS VARCHAR)),
                           json_object('job', 'Writer', 'name', 'c' || CAST(o_custkey AS VARCHAR)),
                           json_object('job', CASE WHEN l_returnflag = 'R' THEN 'Director' ELSE 'Editor' END,
                                       'name', 'p' || CAST(l_partkey AS VARCHAR))),
        'cast', json_array(json_object('name', 'n' || CAST(l_linenumber AS VARCHAR)), json_object('name', NULL),
                           json_object('name', 'q' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)))),
    'genres', json_array(json_object('name', l_returnflag), json_object('name', l_linestatus)),
    'providers', json_object('results', json_object('US', json_object(
        'flatrate', json_array(json_object('provider_name', 'f' || CAST(l_suppkey % 5 AS VARCHAR))),
        'rent', json_array(json_object('provider_name', 'f' || CAST(l_partkey % 5 AS VARCHAR)),
                           json_object('provider_name', 'f' || CAST(l_suppkey % 5 AS VARCHAR)))))))
  AS VARCHAR) AS details FROM src)
, p AS (SELECT *, from_json(details, '{"id": "BIGINT", "title": "VARCHAR", "release_date": "VARCHAR", "runtime": "INTEGER",
     "budget": "BIGINT", "credits": {"crew": [{"job": "VARCHAR", "name": "VARCHAR"}], "cast": [{"name": "VARCHAR"}]},
     "genres": [{"name": "VARCHAR"}],
     "providers": {"results": {"US": {"flatrate": [{"provider_name": "VARCHAR"}], "rent": [{"provider_name": "VARCHAR"}],
                                      "buy": [{"provider_name": "VARCHAR"}]}}}}') AS d FROM docs)
, s AS (SELECT *, list_concat(coalesce(list_transform(d.providers.results.US.flatrate, lambda x: x.provider_name), []),
                              coalesce(list_transform(d.providers.results.US.rent, lambda x: x.provider_name), []),
                              coalesce(list_transform(d.providers.results.US.buy, lambda x: x.provider_name), [])) AS sv FROM p)
SELECT l_orderkey, l_linenumber, d.id AS tmdb_id, coalesce(d.title, '') AS tmdb_title,
       coalesce(d.release_date, '') AS release_date, coalesce(d.runtime, 0) AS runtime, coalesce(d.budget, 0) AS budget,
       list_transform(list_filter(d.credits.crew, lambda c: c.job = 'Director'), lambda c: c.name) AS directors,
       list_filter(list_transform(d.credits.cast[1:10], lambda c: c.name), lambda n: n IS NOT NULL) AS "cast",
       list_transform(d.genres, lambda g: g.name) AS genres,
       list_filter(sv, lambda x, i: list_position(sv, x) = i) AS streaming_services
FROM s
"""


def _details_docs(spark, sf, parts: int | None = None):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                               "l_returnflag", "l_linestatus", "l_shipdate")
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    j = j.repartition(parts, "l_orderkey", "l_linenumber", "l_partkey") if parts else j
    s = lambda x: x.cast("string")
    pn = lambda v: F.struct(v.alias("provider_name"))
    doc = F.to_json(F.struct(
        F.col("l_partkey").alias("id"), F.concat(F.lit("t"), s(F.col("l_partkey"))).alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"),
        (F.col("l_linenumber") * 30).alias("runtime"),
        F.struct(
            F.array(F.struct(F.lit("Director").alias("job"), F.concat(F.lit("s"), s(F.col("l_suppkey"))).alias("name")),
                    F.struct(F.lit("Writer").alias("job"), F.concat(F.lit("c"), s(F.col("o_custkey"))).alias("name")),
                    F.struct(F.when(F.col("l_returnflag") == "R", "Director").otherwise("Editor").alias("job"),
                             F.concat(F.lit("p"), s(F.col("l_partkey"))).alias("name"))).alias("crew"),
            F.array(F.struct(F.concat(F.lit("n"), s(F.col("l_linenumber"))).alias("name")),
                    F.struct(F.lit(None).cast("string").alias("name")),
                    F.struct(F.concat(F.lit("q"), s(F.col("l_quantity").cast("int"))).alias("name"))).alias("cast"),
        ).alias("credits"),
        F.array(F.struct(F.col("l_returnflag").alias("name")), F.struct(F.col("l_linestatus").alias("name"))).alias("genres"),
        F.struct(F.create_map(F.lit("US"), F.struct(
            F.array(pn(F.concat(F.lit("f"), s(F.col("l_suppkey") % 5)))).alias("flatrate"),
            F.array(pn(F.concat(F.lit("f"), s(F.col("l_partkey") % 5))),
                    pn(F.concat(F.lit("f"), s(F.col("l_suppkey") % 5)))).alias("rent"))).alias("results")).alias("providers"),
    ))
    return j.select("l_orderkey", "l_linenumber", doc.alias("details"))


@query("json_details", DOC_SQL)
def q_json_details(spark, sf):
    # the scan may be one split: deal the rows out before the costly building and parsing
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = _details_docs(spark, sf, parts)
    out = X.parse_details(d, "details", keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "tmdb_id", "tmdb_title", "release_date", "runtime", "budget",
                      "directors", "cast", "genres", "streaming_services")


SEARCH_SQL = """
WITH src AS (SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
, docs AS (SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) + l_linenumber % 2 AS INTEGER) AS want, CAST(json_object('results', json_array(
    json_object('id', l_partkey, 'release_date', strftime(o_orderdate, '%Y-%m-%d')),
    json_object('id', l_suppkey, 'release_date', strftime(l_shipdate, '%Y-%m-%d')),
    json_object('id', o_custkey, 'release_date', strftime(l_shipdate + INTERVAL 1 YEAR, '%Y-%m-%d')))) AS VARCHAR) AS search
  FROM src)
, p AS (SELECT *, from_json(search, '{"results": [{"id": "BIGINT", "release_date": "VARCHAR"}]}').results AS r FROM docs)
, h AS (SELECT *, coalesce(list_filter(r, lambda x: starts_with(x.release_date, CAST(want AS VARCHAR)))[1], r[1]) AS hit FROM p)
SELECT l_orderkey, l_linenumber, want, hit.id AS hit_id, hit.release_date AS hit_date FROM h
"""


@query("json_best_hit", SEARCH_SQL)
def q_json_best_hit(spark, sf):
    """S18 + X11: the search result released in the wanted year, else the first result."""
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    r = lambda i, d: F.struct(F.col(i).alias("id"), F.date_format(d, "yyyy-MM-dd").alias("release_date"))
    doc = F.to_json(F.struct(F.array(r("l_partkey", F.col("o_orderdate")), r("l_suppkey", F.col("l_shipdate")),
                                     r("o_custkey", F.add_months("l_shipdate", 12))).alias("results")))
    want = (F.year("l_shipdate") + F.col("l_linenumber") % 2).alias("want")
    d = j.select("l_orderkey", "l_linenumber", want, doc.alias("search"))
    hit = X.best_search_hit(F.col("search"), F.col("want"))
    return d.select("l_orderkey", "l_linenumber", "want", hit["id"].alias("hit_id"),
                    hit["release_date"].alias("hit_date"))
