"""Small awkward tables: nulls, empty and long texts, ties, repeats, extra columns with clashing names."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "shard slot size law fp words at seed key row block bucket rank score label line site vec host rule verdict order doc".split()

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "One plain text of some words.", "en", "b", 29),
    (2, "One plain text of some words.", "en", "a", 29),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (None, "A text without an id", "en", "b", 20),
    (5, LONG, "en", "a", len(LONG)),
    (6, " \n\t ", "", "", 4),
    (7, "äöü ß É — ñ 漢字", "de", None, 15),
    (8, "tie tie tie", None, "c", 11),
    (8, "tie tie tie", None, "c", 11),
    (9, "line one\nline two\n\nline one", "en", "c", 27),
]


def docs(spark, rows=None, clash=True):
    df = spark.createDataFrame(ROWS if rows is None else rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
