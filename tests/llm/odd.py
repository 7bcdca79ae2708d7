"""Rows that every operator has to bear, and brute-force helpers."""

from __future__ import annotations

import re

LONG = " ".join(f"word{i % 977} and more" for i in range(12_000))
CLASHING = ["score", "fp", "n", "row", "word", "s", "block", "size", "h", "held_out", "spans", "rank", "paths", "token"]

DOCS = [
    (1, None, "en", "a"), (2, "", "en", None), (None, "the text of no one", None, "a"), (3, LONG, "en", "b"),
    (4, "the same row twice, as it is", "en", "b"), (4, "the same row twice, as it is", "en", "b"),
    (5, " \t\n ", None, "c"), (6, "12345 67890 !!!", "de", "c"), (7, "Straße und Öl, für die Welt", "de", None),
]


def docs(spark, rows=None):
    rows = DOCS if rows is None else rows
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASHING:
        plain = plain.withColumn(name, plain.doc_id.cast("string"))
    return plain


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
