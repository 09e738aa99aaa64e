"""Queries of the subpackage: one opN_ entry per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontaminate, exact_dedup, html_text, imatch, langid, pii, secrets, signature_join, suffix_dedup, vector_codes, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = langid.held_out()
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = langid.fit(langid.labelled_sample(rows, ~F.col("held_out")))
    return langid.predict(rows, model, keep=("held_out",))


def op2_imatch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_edits(_table(spark, sf_dir, "documents"))


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(_table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op5_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.components_report(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    ranks = bpe.read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.decontamination_report(found)


def op11_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(*vector_codes.compress(_table(spark, sf_dir, "embeddings")))


def op12_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op13_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_revisit_resolution": warc.REPORT_SQL, "op11_elkan_codes": vector_codes.REPORT_SQL, "op12_extendible_dedup": exact_dedup.REPORT_SQL}
