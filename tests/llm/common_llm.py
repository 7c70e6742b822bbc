"""Tables for the tests of the training-data operators."""

from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names the operators use for their own.
CLASHING = ", kept boolean, size string, key string, block string, _quality string, _key string, _row string, component string"


def documents(spark, texts, extra=False):
    """Rows (doc_id, text[, source]) as a documents table; with ``extra`` also columns of clashing names."""
    rows = []
    for row in texts:
        doc_id, text, source = (*row, "s")[:3]
        rows.append((doc_id, text, "en", source, None if text is None else len(text)) + ((True,) + ("x",) * 7 if extra else ()))
    return spark.createDataFrame(rows, DOCUMENTS + CLASHING * extra)


def by_id(df, *columns):
    return {row[0]: tuple(row)[1:] for row in df.select(df.columns[0], *columns).collect()}
