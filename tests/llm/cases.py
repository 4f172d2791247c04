"""Documents that every operator must take: nulls, empties, long texts, repeated rows, clashing column names."""

from pyspark.sql import types as T

SCHEMA = (
    T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string")
    .add("n_chars", "long").add("size", "string").add("score", "string").add("target", "string"))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def odd_documents(spark):
    rows = [
        (0, None, "en", "a", None), (1, "", "en", "a", 0), (2, " \t\n ", None, None, 4), (3, "one two", "en", "b", 7),
        (4, "one two", "en", "b", 7), (5, "The quick brown fox jumps over the lazy dog.\nAgain and again.", "en", "c", 61),
        (6, LONG, "en", "a", len(LONG)), (None, "no id here at all", "en", None, 17), (8, "é 😀 ñandú ß", "es", "b", 12),
        (9, "one two", "en", "b", 7), (9, "one two", "en", "b", 7),
    ]
    return spark.createDataFrame([(*r, "s", "x", "t") for r in rows], SCHEMA)


def rows_by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
