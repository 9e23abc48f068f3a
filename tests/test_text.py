"""Scalar text functions (X1-X11) on hand-made edge cases."""

from pyspark.sql import functions as F

from marquee.functions import text as X


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


def test_clean_title(spark):
    cases = {
        "The Glass Harbor": "glass harbor",
        "A Quiet Place: Part II": "quiet place part ii",
        "Nightfall - An Epic": "nightfall epic",
        "Éclair³": "clair",
        "  Many   spaces here ": "many spaces here",
        "Theory of Everything": "theory of everything",   # 'The' only as a whole word
        "!!!": "",
    }
    for src, want in cases.items():
        assert _one(spark, X.clean_title, src) == want, src


def test_normalize_title(spark):
    assert _one(spark, X.normalize_title, "  The Glass-Harbor: Part 2. 'x' \"y\" ") == "theglassharborpart2xy"
    assert _one(spark, X.normalize_title, None) == ""


def test_parse_list_strict(spark):
    cases = {
        "['Ada Ray', \"Cy O'Dell\"]": ["Ada Ray", "Cy O'Dell"],
        "[]": [],
        "": [],
        None: [],
        "['a', None, 'b']": ["a", None, "b"],
        "['caf\\xe9']": ["café"],
        "['missing bracket'": [],
        "not a list": [],
    }
    for src, want in cases.items():
        assert _one(spark, X.parse_list_strict, src) == want, src


def test_parse_list_lenient(spark):
    assert _one(spark, X.parse_list_lenient, "[Drama, 'Horror']") == ["Drama", "Horror"]
    assert _one(spark, X.parse_list_lenient, "['ok']") == ["ok"]
    assert _one(spark, X.parse_list_lenient, "garbage") == []
    assert _one(spark, X.parse_list_lenient, "[ ]") == []


def test_slug_rating_counts(spark):
    assert _one(spark, X.slug_year, "nightfall-part-ii-2012") == 2012
    assert _one(spark, X.slug_year, "the-glass-harbor") is None
    assert _one(spark, X.slug_year, "the-film-1850") is None              # not 19xx/20xx
    assert _one(spark, X.rating_from_class, "poster rated-8 x") == 8
    assert _one(spark, X.rating_from_class, "poster") is None
    assert _one(spark, X.count_text_to_int, "1,234") == 1234
    assert _one(spark, X.count_text_to_int, "12 345") == 12345
    assert _one(spark, X.count_text_to_int, "n/a") == 0


def test_year_helpers(spark):
    df = spark.createDataFrame([("1999-05-02", 1999), ("2001-01-01", 1999), (None, 1999)], "d string, y int")
    got = df.select(X.year_prefix_match("d", "y").alias("m"), X.year_from_date_text("d").alias("yy")).collect()
    assert [r["m"] for r in got] == [True, False, None]
    assert [r["yy"] for r in got] == [1999, 2001, None]
