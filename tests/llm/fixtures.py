"""Small documents that the tests of several operators share: nulls, empty and long texts, copies, a clashing column."""

ODD = [
    (1, "Hello  world,   this is   a text ", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, "  ", "en", "b"),
    (5, "▁ ▁▁x \t\n é ﬁ ́́ 日本語 <s></s> <unk> <|endoftext|> \x00   \U0001f600", "xx", "a"),
    (6, "same text here", "en", "a"),
    (7, "same text here", "en", None),
    (7, "same text here", "en", None),
    (8, "word " * 30_000 + "end", "en", "c"),
    (None, "no id", "en", "a"),
    (None, "no id either\x85 \x1c x", "en", "c"),
    (9, "a\n\n  b \n c\r\n", "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def odd_docs(spark):
    """With columns whose names results use too."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "length(text) n_chars", "'x' n_tokens", "'y' size", "'z' score", "0 shard")


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")
