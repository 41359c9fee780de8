"""A training corpus from `documents` in five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, mixing, near_dedup, quality
from siltstone.llm.queries import encoded_and_decoded
from siltstone.llm.shared import matching, scratch, stage, staged_texts, table

#: A document goes if the probability that its quality is good is below this.
LEAST_QUALITY = 0.5

#: Documents are near copies from this similarity on, in hundredths.
LEAST_SIMILARITY = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels outside the held-out
    fold. A row goes by its identifier, which may be null, and its text."""
    model = quality.learnt(docs, table(spark, sf_dir, "labels"))
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    keyed = docs.select(F.struct(docs["doc_id"].alias("id"), digest.alias("digest")).alias("row"), "text")
    scores = quality.score(keyed, model, "row")
    rejected = staged_texts(scores.where(F.col("score") < LEAST_QUALITY).select("id.id", "id.digest").distinct(), "pipeline-rejected")
    return matching(docs, {"id": docs["doc_id"], "digest": digest}, rejected, "left_anti")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest identifier stays."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate links reach the document with the least identifier stays."""
    return near_dedup.deduplicated(docs, least=LEAST_SIMILARITY)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (0 to 2 times), in training order."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256. The rows are written once, as
    the batches that Python gets of the texts are small only while they are."""
    return encoded_and_decoded(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mix_stage), ("bpe", bpe_stage)]

#: SQL can express neither the classifier nor BPE; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted when its documents are written."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        with scratch():
            docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
