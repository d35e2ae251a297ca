"""The queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .oracles import CODES, LEAKS, LINKS, REPAIRS

BYTE_BPE, BYTE_RANKS, WORD_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leak_report

    return leak_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints_with_edits

    return fingerprints_with_edits(read_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(BYTE_RANKS))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_report

    return dedup_report(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_report

    return language_report(read_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import link_classes

    return link_classes(read_table(spark, sf_dir, "documents"), size=3, percent=90)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_verdicts

    return url_verdicts(read_table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damage, repair_report

    return repair_report(damage(read_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_fingerprints, op3_best_fit_packing, op4_line_dedup, op5_language_id, op6_sharding, op7_token_counts, op8_quality, op9_jaccard_join, op10_toxicity, op11_vector_codes, op12_url_filter, op13_conversation_repair)}
ORACLE_SQL = {"op1_decontamination": LEAKS, "op9_jaccard_join": LINKS, "op11_vector_codes": CODES, "op13_conversation_repair": REPAIRS}
