"""The corpus pipeline: five stages that turn documents into token ids for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, lines, pieces, quality, simhash
from tessera.llm.common import load, materialize


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, load(spark, sf_dir, "labels"))


def line_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that a line before them equals or nearly equals."""
    return lines.deduplicated(docs)


def near_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.kept_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, restored."""
    import public_tokenizers

    return pieces.round_trip(docs, pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [("quality", classified), ("line_dedup", line_deduped), ("near_dedup", near_deduped), ("decontamination", decontaminated), ("sentencepiece", encoded)]

#: The first stage is a trained model and the last a tokenizer, which SQL doesn't express; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
