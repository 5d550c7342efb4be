"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing names."""

LONG = "The quick brown fox jumps. " * 9000
EDGE = [
    (1, None, "en"),
    (2, "", "en"),
    (3, "   \n\t ", None),
    (4, LONG, "en"),
    (5, "one", "en"),
    (5, "one", "en"),
    (6, "mail a.b@c.example.org or +1 (555) 123-4567 now", "de"),
    (7, "same text of several words here", "de"),
    (8, "same text of several words here", "fr"),
    (None, "a row without an id", None),
    (9, "123 456 !!! ???", "es"),
]
#: Columns that operators use themselves, under the same names.
CLASHES = {"score": 1.5, "tail": 2.5, "key": 3, "row": 4, "bucket": 5, "fp": b"x", "component_id": 6, "part": 7, "spans": "s", "label": 8, "term": "t", "lang_pred": "q", "held_out": True, "host": "h", "stream": 1, "digest": "d", "grade": 3}


def frame(spark, rows=EDGE):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({n: F.lit(v) for n, v in CLASHES.items()})
