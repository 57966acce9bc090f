"""Small inputs with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
PASSAGE = "first line of it\nsecond line of it\nthird line of it"
SECRET = 'token = "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1"'

# columns that are named as the operators name theirs
CLASHES = ("_id", "_row", "_text", "node", "root", "print", "first", "last", "h", "shard", "score", "n", "piece")

ROWS = [
    (1, "Hello World, this is one text\n" + PASSAGE, "en", "a", 5),
    (2, "hello world, this is one text\n" + PASSAGE.title(), "en", "a", 5),
    (3, "", "en", None, 0),
    (4, None, None, None, None),
    (5, "   \n\n \t\n", "fr", "b", 7),
    (6, PASSAGE + "\nand more of its own", "en", "b", 9),
    (7, "x\n" + PASSAGE + "\n\n" + PASSAGE, "en", "b", 9),
    (8, LONG, "en", "c", len(LONG)),
    (9, "été 漢字 🙂 don't we'll 's 'S 12 ½\r\n" + SECRET, "fr", "c", 3),
    (9, "été 漢字 🙂 don't we'll 's 'S 12 ½\r\n" + SECRET, "fr", "c", 3),
    (9, "another text with the same id", "en", "c", 3),
    (None, "a row without id " + SECRET, "en", "c", 3),
    (None, "a row without id " + SECRET, "en", "c", 3),
    (12, "<|endoftext|> is a special token<|endoftext|>", None, "c", 3),
    (13, "same\nsame\nsame\nsame\nsame", "de", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def nothing(spark):
    return awkward(spark).limit(0)
