import pytest

#: (doc_id, text, lang, source, n_chars) with the awkward cases: null and empty texts, no letters, a very long text,
#: equal texts, repeated rows, null ids, white space of all kinds, marks of the tokenizers inside texts.
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(12_000))
ODD = [
    (1, None, None, None, 0),
    (2, "", "en", "a", 0),
    (3, "  \t\n ", "en", "a", 5),
    (4, "1234 !! 56", None, "b", 10),
    (5, LONG, "en", "b", len(LONG)),
    (6, "the cat sat on the mat and it was good", "en", "a", 38),
    (7, "the cat sat on the mat and it was good", "en", None, 38),
    (7, "the cat sat on the mat and it was good", "en", None, 38),
    (8, "The  CAT sat\ton the mat and it was good", "en", "a", 39),
    (9, "x <|endoftext|> y <|startoftext|>\x1cz　日本 ▁ it's", "en", "c", 30),
    (None, "a text without an id", "en", "c", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns whose names clash with those that the operators use
    return spark.createDataFrame([(*r, 9, "x", 1.5, [1]) for r in ODD], SCHEMA + ", size long, id string, score double, n array<int>")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)
