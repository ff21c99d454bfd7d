"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import decontaminate, line_dedup, near_dups, quality
from orderlens.llm.common import table
from orderlens.session import scratch_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.pii import span_digest
    return span_digest(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from orderlens.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.suffix_dedup import removal_digest
    return removal_digest(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.html_text import extracted
    return extracted(table(spark, sf_dir, "pages"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.component_rows(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.secrets import Ledger, span_digest
    docs = table(spark, sf_dir, "documents")
    ledger = Ledger(spark, scratch_path(spark, "llm", f"ledger-{uuid.uuid4().hex}"))
    ledger.scan(docs)
    return span_digest(ledger.findings(docs))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"), keep=("doc_id",)).select(
        "row.doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.whitening import whitened
    return whitened(table(spark, sf_dir, "embeddings"))


def op12_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.classifier import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.llm.spelling import variants
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html_text": op7_html_text,
    "op8_near_dups": op8_near_dups,
    "op9_secrets": op9_secrets,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_classifier": op12_classifier,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_quality": quality.oracle_sql(),
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op8_near_dups": near_dups.ORACLE_SQL,
}
