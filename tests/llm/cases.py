"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import pandas as pd

SF = "/root/testdata/sf0.001"

EDGE = [
    (1, "The cat sat on the mat, and the dog sat on the cat. " * 8),
    (2, "The cat sat on the mat, and the dog sat on the cat. " * 8),
    (3, None),
    (4, ""),
    (5, "   \n\t  "),
    (6, "a  b \n c<|endoftext|> d  e  x"),
    (7, "don't STOP, ÉÀÜ ß 日本語 עברית 👩‍👩 é " * 3),
    (8, "word " * 30_000),
    (9, "x" * 50_000),
    (9, "x" * 50_000),
    (None, "no id here"),
]


def edge(spark, extra: bool = True):
    """Rows with nulls, empty and very long texts, equal rows, and extra columns with clashing names."""
    rows = [(d, t, 1, "s", 0, 0, 0, "", 0, 0) for d, t in EDGE]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, source string, bucket int, rank int, row int, __sha string, __bad int, toxic int")
    return df if extra else df.select("doc_id", "text")


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def documents() -> pd.DataFrame:
    return pd.read_parquet(f"{SF}/documents.parquet")
