"""Scalar text functions (X1-X11) as built-in Column expressions.

None of these is a Python UDF: each one is a composition of JVM-side
expressions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on:
# leading articles removed by the title cleaner (case-insensitive, whole words)
TITLE_ARTICLES = ("The", "A", "An")
# characters deleted by the flexible title normalizer
NORMALIZE_DELETE = " -:.'\""


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_title(c) -> Column:
    """Drop articles, keep ASCII letters/digits/whitespace, squeeze, trim, lower.

    ``(?U)`` makes ``\\b`` and ``\\s`` Unicode-aware, as in Python's ``re``.
    """
    art = "|".join(TITLE_ARTICLES)
    x = F.regexp_replace(_c(c), rf"(?iU)\b({art})\s+", "")
    x = F.regexp_replace(x, r"(?U)[^a-zA-Z0-9\s]", "")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return F.lower(F.trim(x))


def normalize_title(c) -> Column:
    """Lower, strip, delete space - : . ' \" ; null becomes ''."""
    x = F.regexp_replace(F.lower(_c(c)), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.translate(x, NORMALIZE_DELETE, ""), F.lit(""))


def year_key(year) -> Column:
    """Year as text with 'Unknown' for null."""
    return F.coalesce(_c(year).cast("string"), F.lit("Unknown"))


def item_key(clean, year) -> Column:
    """Movie id = clean_title + '_' + year key."""
    return F.concat_ws("_", _c(clean), year_key(year))


def _python_literal_to_json(c) -> Column:
    # \xNN escapes become \u00NN and bare None elements become null, so the
    # JSON reader (with single quotes allowed) accepts Python list literals.
    x = F.regexp_replace(_c(c), r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    return F.regexp_replace(x, r"(^\[|,)\s*None\s*(?=,|\])", "$1null")


def parse_list_strict(c) -> Column:
    """Python/JSON list literal -> array<string>; anything unparseable -> []."""
    parsed = F.from_json(_python_literal_to_json(c), "array<string>",
                         {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast("array<string>"))


def parse_list_lenient(c) -> Column:
    """Strict parse, else for bracketed text split on commas and strip quotes."""
    src = _c(c)
    parsed = F.from_json(_python_literal_to_json(src), "array<string>",
                         {"allowSingleQuotes": "true"})
    inner = F.regexp_extract(src, r"^\[(.*)\]$", 1)
    fallback = F.when(
        src.rlike(r"^\[.*\]$") & (F.trim(inner) != ""),
        F.transform(F.split(inner, ","),
                    lambda s: F.regexp_replace(F.trim(s), r"^['\"]+|['\"]+$", "")))
    return F.coalesce(parsed, fallback, F.array().cast("array<string>"))


def list_to_text(c, sep: str = " ") -> Column:
    """X5."""
    return F.coalesce(F.array_join(_c(c), sep), F.lit(""))


def list_len(c) -> Column:
    """Size with null -> 0."""
    return F.coalesce(F.size(_c(c)), F.lit(0))


def slug_year(slug) -> Column:
    """Year from a slug: the last 19xx/20xx group ending the slug, else null."""
    y = F.regexp_extract(_c(slug), r"-((?:19|20)\d{2})$", 1)
    return F.when(y != "", y.cast("int"))


def rating_from_class(cls) -> Column:
    """Integer N from a CSS class 'rated-N'."""
    v = F.regexp_extract(_c(cls), r"rated-(\d+)", 1)
    return F.when(v != "", v.cast("int"))


def count_text_to_int(c) -> Column:
    """X10: '1,234' / '1 234' (nbsp) -> 1234; anything else -> 0."""
    x = F.regexp_replace(F.trim(_c(c)), "[,  ]", "")
    return F.coalesce(x.try_cast("int"), F.lit(0))


def year_prefix_match(date_text, year) -> Column:
    """X11: does a YYYY-MM-DD text start with the given integer year."""
    return F.startswith(_c(date_text), _c(year).cast("string"))


def year_from_date_text(c) -> Column:
    """Integer year from the first four characters of a date text."""
    return F.substring(_c(c), 1, 4).try_cast("int")


def year_fallback(*candidates) -> Column:
    """First usable year among integer columns and date texts; null, not 'Unknown'."""
    parts = []
    for c in candidates:
        col = _c(c)
        parts.append(F.substring(col.cast("string"), 1, 4).try_cast("int"))
    return F.coalesce(*parts)
