"""SQL text of the canonical views, for the DuckDB oracle.

These mirror ``marquee.sources.views`` expression for expression. Tables
``lineitem orders part …`` are the driver's pre-registered views.
"""

REVIEWS = """
reviews AS (
  SELECT 'u' || CAST(o.o_custkey AS VARCHAR) AS username,
         CASE WHEN l.l_linenumber % 7 = 0 THEN p.p_name || ' (' || p.p_brand || ')'
              WHEN l.l_linenumber % 3 = 0 THEN upper(p.p_name) || ': ' || p.p_brand
              ELSE p.p_name || ' ' || p.p_brand END AS title,
         CAST(CASE WHEN l.l_linenumber % 5 = 0 OR p.p_partkey % 4 = 0 THEN NULL
                   ELSE 1940 + p.p_partkey % 86 END AS INTEGER) AS year,
         CAST(1 + CAST(l.l_quantity AS BIGINT) % 10 AS INTEGER) AS rating,
         replace(p.p_name, ' ', '-') || '-' || CAST(1940 + p.p_partkey % 86 AS VARCHAR) AS film_slug,
         l.l_partkey AS item,
         o.o_orderdate AS rated_at,
         (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
          l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate) AS seq
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN part p ON l.l_partkey = p.p_partkey
)"""

CATALOGUE = """
catalogue AS (
  SELECT p_partkey AS tmdb_id,
         p_name || ' ' || p_brand AS title,
         CAST(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1940 + p_partkey % 86 END AS INTEGER) AS year,
         CASE WHEN p_partkey % 8 = 0 THEN NULL
              ELSE CAST(1940 + p_partkey % 86 AS VARCHAR) || '-0' || CAST(1 + p_partkey % 9 AS VARCHAR) || '-15'
         END AS release_date,
         CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 4 END AS INTEGER) AS runtime,
         CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE floor(p_retailprice * (1 + p_partkey % 97)) END AS BIGINT) AS budget,
         CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE floor(p_retailprice * (p_partkey % 13) * 3) END AS BIGINT) AS revenue,
         p_size / 5.0 AS popularity,
         CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'l' || CAST(p_partkey % 14 AS VARCHAR) END AS original_language,
         [p_type, string_split(p_name, ' ')[2]] AS genres,
         [p_brand] AS directors,
         [string_split(p_name, ' ')[1], p_brand || '-' || CAST(p_size % 7 AS VARCHAR),
          'n' || CAST(p_partkey % 50 AS VARCHAR)] AS "cast",
         p_partkey AS seq
  FROM part
)"""

MEMBERS = """
members AS (
  SELECT 'u' || CAST(c.c_custkey AS VARCHAR) AS username, c.c_name AS display_name,
         CAST(coalesce(n.n, 0) AS INTEGER) AS num_reviews
  FROM customer c LEFT JOIN (
    SELECT o.o_custkey, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    GROUP BY o.o_custkey) n ON c.c_custkey = n.o_custkey
)"""

# X1 and X2 as SQL expressions over a column reference.
def clean_title_sql(c: str) -> str:
    x = f"regexp_replace({c}, '\\b(The|A|An)\\s+', '', 'gi')"
    x = f"regexp_replace({x}, '[^a-zA-Z0-9\\s]', '', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"lower(trim({x}))"


def normalize_title_sql(c: str) -> str:
    return f"coalesce(translate(trim(lower({c})), ' -:.''\"', ''), '')"


def with_views(*names: str) -> str:
    parts = {"reviews": REVIEWS, "catalogue": CATALOGUE, "members": MEMBERS}
    return "WITH " + ",".join(parts[n] for n in names)
