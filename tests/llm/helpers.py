"""Small frames and brute-force versions for the tests of the corpus operators."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], *(r[2:] or ("en", "src1")), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


EDGE_TEXTS = [None, "", " \n\t", "a", "é", "word " * 30_000, "x" * 100_000, "Ünï códe 漢字 😀 text", "\x00\x01 odd \x7f bytes"]
