"""Rows that every operator must take: nulls, empty, blank, odd and long texts, ties, repeats, clashing column names."""

import pandas as pd

ODD = [
    None, "", "  \t\n", "one", "a b", "it's I'LL x''s don't!", "café ÀÉ ß ﬁ İstanbul Σας <|endoftext|>x a<|startoftext|>b",
    "é ́x 漢字123 ١٢ a b a b c \x00 \x85", "😀 👍🏽 a\x1cb \x0b\x0c", "Ǆ ŉ ª º µ ² ½", "  lead  and   trail  ", "line one here\nline one here\n\n x \nline one here",
    "▁under▁ ▁▁x", "K Å 'S 'Re ''ll", "a b c a b c a b c d", "zzzz " * 3000, "q" * 30000,
]


def odd_documents(spark, texts=None):
    texts = (ODD if texts is None else texts) * 2
    rows = [(i if i != 5 else None, t, "x", "y", None) for i, t in enumerate(texts)] + [(1, texts[-1], "x", "y", None)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT string, kind string, n long").repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")
