"""Small tables with everything that tends to break an operator."""

LONG = "x" * 60_000
ROWS = [
    (1, "The first text, with a mail to bob@example.com and 10.0.0.1 in it.", "en", "a", 10),
    (2, "The first text, with a mail to bob@example.com and 10.0.0.1 in it.", "en", "a", 10),
    (2, "The first text, with a mail to bob@example.com and 10.0.0.1 in it.", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "   \n \t ", "en", "a", 6),
    (6, "word", "en", "a", 4),
    (7, LONG, "en", "a", len(LONG)),
    (8, "many words again and again " * 3000, "en", "b", 0),
    (None, "A row without an id.", "en", "b", 20),
    (9, "Ünïcode \U0001f600 ﬁ x\r\n\x00 end é", "xx", "b", 1),
    (10, "Some other text that has nothing to do with any of the ones above it.", "en", "b", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("key", "label", "digest", "start", "end", "n", "component", "piece", "length", "salt", "rep", "patterns", "vector", "item", "html")


def documents(spark, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def nothing(spark):
    return documents(spark).where("false")
