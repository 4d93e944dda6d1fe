"""A small table with every odd case: nulls, empty and long texts, ties, repeated rows, and columns with names that
operators use themselves."""

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size long, score double, kept boolean, _text string, _id long, n int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    (1, "one two three four five six seven eight nine ten", "a"),
    (1, "one two three four five six seven eight nine ten", "a"),
    (2, "One two THREE four five six seven eight nine ten", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, " \n\t ", "b"),
    (6, LONG, "b"),
    (7, LONG + " end", "c"),
    (8, "é ß 日本 🙂 <|endoftext|> x", "ü"),
    (9, "alpha beta", None),
    (10, "alpha beta", "Z"),
    (None, "text without id", "a"),
    (None, None, None),
]


def docs(spark, rows=None):
    return spark.createDataFrame([(i, t, s, "en", 1, 2, 0.5, True, "clash", 3, 4) for i, t, s in (TEXTS if rows is None else rows)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
