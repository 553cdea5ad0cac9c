"""Corpus preparation: toxicity filter, near-duplicate removal, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages run one after the other, each on the
written Parquet of the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertloom.llm.frames import cleared, made, pick, removed, shared_dir, table
from alertloom.llm.packing import pack_documents
from alertloom.llm.secret_net import without_secrets
from alertloom.llm.shingle_join import without_near_texts
from alertloom.llm.suffix_dedup import without_repeats
from alertloom.llm.toxicity import without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic.

    Null and empty texts stay, rows with null or repeated ids are judged like others, long texts whole; an empty table gives none.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Null, empty and blank texts have no copies and stay; rows with null or repeated ids are documents of their own; of equal
    rows one stays; an empty table gives none.
    """
    return without_near_texts(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of 100 bytes or more stays where it first occurs only (smallest doc_id, nulls first, then by text).

    Documents stay, with null texts null and such as are wholly repeated empty; an empty table gives none.
    """
    return without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``[secret]``; documents stay, null texts null and empty ones empty; an empty table gives none."""
    return without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    Null and empty texts are one piece, the end id; rows with null or repeated ids are packed each on its own; an empty table
    gives none.
    """
    return pack_documents(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Stages such as suffix sorting, a trained network and BPE have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, other columns than those of documents left out.

    Each stage takes null, empty and very long texts, null and repeated ids and empty tables as its docstring says. What a stage
    wrote for itself, and the table that it read, are deleted when its own table is written.
    """
    base = shared_dir(spark)
    docs = pick(table(spark, sf_dir, "documents"), **{c: c for c in COLUMNS})
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path, before = f"{base}/{k}", made()
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        cleared(spark, before)
        if k:
            removed(spark, f"{base}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
