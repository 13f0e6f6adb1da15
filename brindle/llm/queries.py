"""The subpackage's queries, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import chat_format, fingerprints, language_id, line_crf, mixing, ngram_join, packing, pseudonyms, quality_rules, secrets
from brindle.llm.session import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_rows(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr("-1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", f"'{chat_format.PROBE}' text")
    return chat_format.chat_digests(turns.unionByName(probe))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_rows(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_secret_scan": op2_secret_scan,
        "op3_line_crf": op3_line_crf,
        "op4_fingerprints": op4_fingerprints,
        "op5_pseudonyms": op5_pseudonyms,
        "op6_chat_format": op6_chat_format,
        "op7_mix_sources": op7_mix_sources,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_language_id": op9_language_id,
        "op10_pack": op10_pack,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.oracle(),
        "op6_chat_format": chat_format.ORACLE,
        "op7_mix_sources": mixing.ORACLE,
        "op8_ngram_jaccard_join": ngram_join.ORACLE,
    }
