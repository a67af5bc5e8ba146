"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("node", "places", "starts", "ends", "other", "h1", "shard", "salt", "bucket", "_id", "key", "rank", "component", "score", "words", "toxic")

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit " * 4000


def odd_rows():
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t", "en", "a", 3),
        (4, "one", "en", None, 3),
        (5, LONG, "en", "a", len(LONG)),
        (6, LONG + "x", None, "a", None),
        (7, "the same words in two rows, under the MIT license " * 3, "en", "a", 1),
        (7, "the same words in two rows, under the MIT license " * 3, "en", "a", 1),
        (None, "the same words in two rows, under the MIT license " * 3, "en", "a", 1),
        (8, "the same words in two rows, under the MIT license " * 3, "de", "b", 1),
        (9, "x" * 30_000, "en", "a", 1),
        (10, "日本語のテキスト é ñ 1234 … " * 20, "ja", "a", 1),
        (11, "#*$%&|<>" * 50, "en", "b", 1),
        (12, "a\x00b \x1c c\x85d  e 's 'LL <|endoftext|> İ Σς ｆｕｌｌ", "en", "b", 1),
    ]


def frame(spark, rows, clashing=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASHING if clashing else ():
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
