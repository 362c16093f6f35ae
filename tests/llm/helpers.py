"""Small tables with every awkward case: nulls, empty, very long, tied and repeated rows, clashing extra columns."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("Score", T.StringType()),  # clashes with operators' own columns
        T.StructField("fp", T.StringType()),
    ]
)

PROSE = "the quick brown fox jumps over the lazy dog and runs away from the angry hound through fields of wheat and barley under a pale sky"


def rows():
    long_text = " ".join(f"word{i % 977} {PROSE}" for i in range(2500))
    texts = [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "b"),
        (2, PROSE, "en", "b"),  # repeated row
        (3, PROSE + " today", "en", "a"),
        (4, None, "en", "a"),
        (5, "", None, None),
        (6, " \t\n ", "en", "a"),
        (7, long_text, "en", "a"),
        (8, "Straße ÄÖÜ naïve 日本語 🙂  x y", "de", None),
        (None, "no key but some text of its own here", None, "c"),
        (None, PROSE, "en", "a"),
        (9, "1234 !!! ###", None, "b"),
        (10, "one two three", "en", "b"),
    ]
    return [(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in texts]


def awkward(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def named(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in enumerate(texts, first)], DOCS)
