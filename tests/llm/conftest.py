import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
)
CLASH = ("score", "kept", "component_id", "n_words", "block", "slot", "key", "learn", "h1", "rejected", "n_dropped", "keep", "license", "base_failed", "run", "bits")

PROSE = "The quick brown fox jumps over the lazy dog, and then it rests under a tall tree near the quiet river for a while."
LONG = " ".join(f"word{k % 977}x{k}" for k in range(60_000))
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\r\x0b\x0c ", None, "a"),
    (4, "\n\n", "de", None),
    (5, "12 34 !!", "en", "b"),
    (6, PROSE, "en", "b"),
    (6, PROSE, "en", "b"),
    (7, PROSE, None, None),
    (8, LONG, "en", "c"),
    (9, LONG + " tail", "en", "c"),
    (10, "É\xa0é x one two", "fr", "c"),
    (None, PROSE + " more", "en", "c"),
    (-4, "x" * 300_000, "en", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeats, ties and long texts, with extra columns whose names clash with results."""
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in ODD]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASH])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts, with ids from 0."""

    def build(texts, **columns):
        n = len(texts)
        langs, sources = columns.get("lang", ["en"] * n), columns.get("source", ["s"] * n)
        ids = columns.get("ids", range(n))
        return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in zip(ids, texts, langs, sources, strict=True)], SCHEMA)

    return build
