"""Extraction from invented saved pages and JSON documents."""

import json


from marquee.sources import extract as X

LISTING = """<table><tr><td class="table-person"><a href="/alice/"><span class="name">Alice Q</span></a>
<span class="count">1,234</span></td><td class="table-person"><a href="/bob/"><span class="name">Bób</span></a>
<span class="count">n/a</span></td></tr></table>"""

PROFILE = """<ul><li class="poster-container"><img alt="The Glass Harbor" /><div data-film-slug="the-glass-harbor"
data-film-release-year="1999"></div><span class="rating rated-8"></span></li>
<li class="poster-container"><img alt="Nightfall: Part II" /><div data-film-slug="nightfall-part-ii-2012"></div>
<span class="rating rated-4"></span></li><li class="poster-container"><img alt="Unrated" />
<div data-film-slug="unrated"></div></li></ul><a class="next" href="/alice/films/page/2/">Next</a>"""


def test_member_rows(spark):
    df = spark.createDataFrame([(1, LISTING)], "page_id long, html string")
    got = [tuple(r) for r in X.member_rows(df).orderBy("pos").collect()]
    assert got == [(1, 0, "alice", "Alice Q", 1234), (1, 1, "bob", "Bób", 0)]


def test_film_rows_and_next(spark):
    df = spark.createDataFrame([("alice", PROFILE)], "username string, html string")
    got = [tuple(r) for r in X.film_rows(df).orderBy("pos").collect()]
    assert got == [("alice", 0, "The Glass Harbor", 1999, 8, "the-glass-harbor"),
                   ("alice", 1, "Nightfall: Part II", 2012, 4, "nightfall-part-ii-2012")]
    assert X.film_rows(df, explicit_only=False).count() == 3
    assert df.select(X.next_link("html")).first()[0] == "/alice/films/page/2/"


def test_star_rating(spark):
    df = spark.createDataFrame([('<i class="star-full"></i><i class="star-full"></i><i class="star-half"></i>',),
                                ("<span>no stars</span>",)], "b string")
    assert [r[0] for r in df.select(X.star_rating("b")).collect()] == [2.5, None]


def test_best_search_hit(spark):
    doc = json.dumps({"results": [{"id": 1, "release_date": "2001-03-01"}, {"id": 2, "release_date": "1999-05-02"}]})
    df = spark.createDataFrame([(doc, 1999), (doc, 1980), ('{"results": []}', 1999)], "s string, y int")
    got = [r[0] for r in df.select(X.best_search_hit("s", "y")["id"]).collect()]
    assert got == [2, 1, None]


def test_details_defaults_and_services(spark):
    doc = json.dumps({"id": 7, "credits": {"crew": [{"job": "Director", "name": "Ada"}, {"job": "Writer", "name": "Bo"}],
                                           "cast": [{"name": f"c{i}"} for i in range(12)] + [{"name": None}]},
                      "providers": {"results": {"US": {"flatrate": [{"provider_name": "A"}],
                                                       "rent": [{"provider_name": "B"}, {"provider_name": "A"}]}}}})
    df = spark.createDataFrame([(doc,), ("{}",)], "d string")
    rows = X.parse_details(df, "d", []).collect()
    r = rows[0]
    assert r["tmdb_id"] == 7 and r["directors"] == ["Ada"] and r["cast"] == [f"c{i}" for i in range(10)]
    assert r["streaming_services"] == ["A", "B"] and r["runtime"] == 0 and r["tmdb_title"] == ""
    e = rows[1]
    assert e["directors"] == [] and e["streaming_services"] == [] and e["budget"] == 0
