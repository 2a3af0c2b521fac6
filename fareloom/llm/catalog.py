"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (class_lm, compact_windows, conversation_trie, language_id, latent_leaks, licenses, maxscore,
               mixing, quality_classifier, quality_rules, simhash, slots, token_counts)
from . import oracles
from .frames import table

QUERIES = {}
ORACLES = {"op11_conversation_trie": oracles.TRIE, "op13_ranked_search": oracles.SEARCH}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_latent_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return latent_leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return compact_windows.repeats(table(spark, folder, "documents"))


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_slot_shards(spark: SparkSession, folder: str) -> DataFrame:
    return slots.shard(table(spark, folder, "documents"))


@query
def op7_simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def domain():
    """The given documents name no domain: sources are dealt into three, by their number."""
    return F.concat(F.lit("domain"), F.regexp_extract("source", r"(\d+)", 1).try_cast("int") % 3)


TREE_WEIGHTS = [("domain", "domain0", 3.0), ("domain", "domain1", 2.0), ("domain", "domain2", 1.0),
                ("lang", "en", 5.0), ("lang", "de", 2.0), ("lang", "fr", 2.0), ("lang", "es", 1.0)]


def tree_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TREE_WEIGHTS, "level string, name string, weight double")


@query
def op8_weighted_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), domain(), tree_weights(spark))


@query
def op9_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.score(table(spark, folder, "documents"))


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(table(spark, folder, "conversations"))


@query
def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.languages(table(spark, folder, "documents"))


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return maxscore.search_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
