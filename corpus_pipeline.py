"""The corpus pipeline: documents in, a shard and place for every document kept.

1. The quality classifier rejects texts below its cutoff.
2. SimHash near-duplicates: the document with the smallest id of each group stays.
3. Documents that hold a benchmark item go.
4. Mixing to target weights takes ``MIX_SHARE`` of all tokens, once at most, so leaves that the weights
   make small give a part of their documents.
5. Fixed virtual slots give every document its shard and place.

The first four keep the columns of documents.  Texts are filtered where they lie, but for the second
stage, which joins them with the ids that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fareloom.llm import latent_leaks, mixing, quality_classifier, simhash, slots
from fareloom.llm.catalog import domain, tree_weights
from fareloom.llm.frames import table
from fareloom.session import materialise

CUTOFF = 0.3
MIX_SHARE = 0.9


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    weights = quality_classifier.fit(docs, labels.where(~quality_classifier.held_out()))
    return quality_classifier.accepted(docs, weights, CUTOFF)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return latent_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, domain(), tree_weights(spark), MIX_SHARE)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return slots.shard(docs)


STAGES = [("quality classifier", good_quality), ("simhash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminated), ("mixing to weights", mixed), ("sharding", sharded)]
#: hashes, a fitted model and components are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:  # later stages read their input more than once
            docs = materialise(docs, f"pipeline-{k}")
    return docs
