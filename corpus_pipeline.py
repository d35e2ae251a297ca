"""The training-corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row it gets and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import registry
from tessera.llm.common import materialize, read_table, release
from tessera.llm.decontamination import drop_leaks
from tessera.llm.jaccard_join import near_duplicates
from tessera.llm.language_id import keep_identified
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; texts that are null, empty or have no letter go.

    Long texts are read whole; repeated rows stay or go alike; of languages as likely the first by name counts.
    Without any labelled text nothing is recognised, and nothing stays; an empty table stays empty.
    """
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur before (by doc_id, text hash and place); documents of which nothing is left go.

    Null and empty texts stay; rows that repeat a doc_id and its text are one document and stay alike; a null doc_id
    comes first; n_chars is that of the new text; an empty table stays empty.
    """
    return dedup_lines(docs, keep_emptied=False).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles, the one with the least id.

    Of rows that repeat a doc_id and its text one stays. Null and empty texts are linked with nothing, a null doc_id with
    repeated rows alone; an empty table stays empty.
    """
    return near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item occur (all words of a shorter item).

    Null and empty texts stay, repeated rows stay or go alike; without items every document stays.
    """
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens; a null or empty text is its end id alone.

    Repeated rows are documents of their own; an empty table gives no pieces.
    """
    return pack_documents(docs, registry.tokenizer_path(registry.BYTE_BPE), registry.tokenizer_path(registry.BYTE_RANKS))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("packing", packing)]
#: Language ID and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder, read again, and deleted after the next."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
        before = docs
    return docs
