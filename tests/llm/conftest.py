import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, bucket int, shard int, h string, t string, key double, fp long, hash binary, score string, kept string, size string"

PARA = "the quick brown fox jumps over the lazy dog and runs away from it all\n"


def rows():
    long_text = "".join(f"word{k % 977} of the {k % 31} sea, and {k * k % 1009}.\n" for k in range(9000))
    texts = [
        (1, "Hello world, this is a small text of the kind that is to be read.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, PARA * 4, "en", "a"),
        (5, PARA * 4, "en", None),
        (5, PARA * 4, "en", None),
        (6, PARA + "éàü 日本 😀\t\x0b x", "fr", "c"),
        (7, long_text, "en", "a"),
        (8, "!!! ### 123 $$$ 456", None, "d"),
        (9, "one two", "de", "a"),
        (None, PARA, None, "a"),
        (None, None, "en", "b"),
        (10, " \t\n ", "en", "a"),
        (11, "Released under the MIT License. " + "licensed under the Apache License, Version 2.0 (the License)", "en", "e"),
        (12, long_text[:5000] + "x" + long_text[5001:], "en", "a"),
    ]
    extra = (0, 1, 2, "h", "t", 0.5, 3, b"x", "s", "k", "z")
    return [(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1], r[2], r[3]) for r in rows()]


def result(df, *cols):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: [(x is not None, str(type(x)), x if x is not None else 0) for x in t])


def ordered(rows):
    return sorted(rows, key=lambda t: [(x is not None, str(type(x)), x if x is not None else 0) for x in t])
