"""Documents that break careless code: nulls, empty and long texts, repeats, clashing columns."""

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["key", "size", "_size", "rows", "taken", "copies", "id", "_key", "bucket", "lang_pred_", "n_words", "_text",
            "_lang_pred", "_score", "score", "lang_pred", "hash", "draw"]
LONG = "lorem ipsum dolor sit amet " * 40_000


def documents(spark, rows, extra=True):
    """Rows (doc_id, text, lang, source) with columns whose names operators may use themselves."""
    schema = T._parse_datatype_string(DOCS)
    data = [(*row, len(row[1]) if row[1] is not None else None) for row in rows]
    if extra:
        for name in CLASHING:
            schema = schema.add(name, "string")
        data = [(*row, *("x" for _ in CLASHING)) for row in data]
    return spark.createDataFrame(data, schema)


def hard_rows():
    sentence = "the quick brown fox jumps over the lazy dog near the river bank today "
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", "en", "a"),
        (4, LONG, "en", "b"),
        (5, sentence * 9, None, "b"),
        (6, sentence * 9, "en", None),
        (None, sentence * 9, "en", "b"),
        (None, None, "en", "b"),
        (7, "Ünïcode   wörds\r\nand spaces\x0b12345 !!!", "de", ""),
        (8, "a b c", "xx", "c"),
    ]
    return rows + [rows[4]] * 3 + [rows[0]]
