"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .frames import shared_dir, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_checksums, write_store

    path = shared_dir(spark)
    write_store(table(spark, sf_dir, "documents"), path)
    return read_checksums(spark, path)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shingle_join import near_texts

    return near_texts(table(spark, sf_dir, "documents"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests, find_personal_data

    return digests(find_personal_data(table(spark, sf_dir, "documents")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests
    from .secret_net import BASE_KINDS, find_secrets

    return digests(find_secrets(table(spark, sf_dir, "documents")), BASE_KINDS)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_forest import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_copies

    return exact_copies(table(spark, sf_dir, "documents"))


def op12_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .target_sampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .late_sessions import session_versions, turn_events

    return session_versions(turn_events(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_embeddings,
        op3_toxicity,
        op4_packing,
        op5_shingle_join,
        op6_piece_codec,
        op7_suffix_dedup,
        op8_pii,
        op9_secrets,
        op10_quality_rules,
        op11_exact_dedup,
        op12_target_sampling,
        op13_late_sessions,
    )
}

ORACLE: dict[str, str] = {}
