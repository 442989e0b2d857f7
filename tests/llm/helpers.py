"""Small tables with the odd rows that every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"

ODD = [
    (1, "The cat sat on the mat and looked at the moon tonight.", "en", "a", 1, 0.5, "x"),
    (2, "The cat sat on the mat and looked at the moon tonight.", "en", "a", 1, 0.5, "y"),
    (2, "The cat sat on the mat and looked at the moon tonight.", "en", "a", 1, 0.5, "y"),
    (3, None, "en", None, None, None, None),
    (4, "", None, "b", 0, 0.0, "z"),
    (5, "   \n\t ", "fr", "b", 0, 0.0, "z"),
    (None, "Une phrase sans numéro, écrite en français pour ce test.", "fr", "b", 0, 0.0, "z"),
    (None, None, None, None, None, None, None),
    (6, "1234 !!! ???", "fr", "b", 0, 0.0, "z"),
    (7, "word " * 30_000, "en", "b", 0, 0.0, "z"),
    (8, "x" * 50_000, "en", "b", 0, 0.0, "z"),
    (9, "日本語のテキスト 😀 mixed with ASCII", "ja", "b", 0, 0.0, "z"),
    (10, "Une phrase courte en français", "fr", "b", 0, 0.0, "z"),
]


def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
