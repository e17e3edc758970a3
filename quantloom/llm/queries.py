"""The queries of this subpackage, by their registered names, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, decontaminate, licenses, media, neardup, pages, pii, secrets, sharding, spelling, substrings, toxicity
from .shared import table


def _op1(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _op8(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.report(table(spark, d, "documents"), table(spark, d, "labels"))


def _over(name: str, report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: report(table(spark, d, name))


def _documents(report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return _over("documents", report)


def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": _op1,
        "op2_minhash": _documents(neardup.report),
        "op3_sharding": _documents(sharding.report),
        "op4_progressive_jpeg": _documents(media.report),
        "op5_skip_chain_pii": _documents(pii.report),
        "op6_substring_dedup": _documents(substrings.report),
        "op7_license_digests": _documents(licenses.report),
        "op8_weak_toxicity": _op8,
        "op9_assignment_secrets": _documents(secrets.report),
        "op10_byte_bpe": _documents(bpe.report),
        "op11_spelling_variants": _documents(spelling.report),
        "op12_conversation_repair": _over("conversations", conversations.report),
        "op13_html_extraction": _over("pages", pages.report),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from .sql import DECONTAMINATION, SUBSTRINGS

    return {
        "op1_decontamination": DECONTAMINATION,
        "op6_substring_dedup": SUBSTRINGS,
        "op7_license_digests": licenses.oracle(),
        "op11_spelling_variants": spelling.oracle(),
        "op12_conversation_repair": conversations.oracle(),
    }
