"""License scan by diagonal voting, in DataFrame operations only.

Every text is cut into words; the hashes of all rolling word pairs are joined with the positions of
the same pairs in license templates (a small fixed table, broadcast).  A hit at word p of the text
and position t of the template votes for the diagonal p - t.  Votes of a diagonal are the bits of the
template positions that met, so repeated rows count once.  A diagonal that has all pairs of a phrase
is one exact place of it.  For long templates, neighbouring diagonals are merged, as words put in or left
out shift the diagonal.  Every such edit also breaks a pair, and a span has to keep ``COVER`` of the
template's pairs; so a merged span may be wider than the template by ``GAP`` words for each pair that may
be missing and no more, and a template whose pairs are strung out with filler words is none.  A span is
accepted if its votes cover at least ``COVER`` of the template's pairs; its score is the share of the
span's pairs that are the template's.  Accepted spans that overlap are reported as the best one of them.

Each text also sends one marker row through the join, so texts without any hit stay in the result and
no text is read twice.  Rows are grouped by key and text hash, then repeated as often as they came.

Defined results: null and empty texts have no words, no places and empty labels; a null key is a key;
equal rows come back as often as they were given; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import ascii_lower

#: fixed values: phrases that are looked for exactly, with their labels
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: fixed values: openings of public licenses, matched approximately
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is "
     "distributed on an as is basis without warranties or conditions of any kind", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the creative commons attribution noncommercial license", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gnu-gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation", "gnu-gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free "
     "documentation license", "gfdl"),
    ("this work has been released into the public domain", "public-domain"),
)
GAP = 2
COVER = 0.8
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = -1  # template number of the marker row


def template_pairs(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(template, at, first, second, pairs) of every word pair; at most 64 pairs a template."""
    rows = []
    for number, (text, _) in enumerate([*phrases, *templates]):
        words = text.split()
        if not 2 <= len(words) <= 65:
            raise ValueError("a template has 2 to 65 words")
        rows += [(number, at, a, b, len(words) - 1) for at, (a, b) in enumerate(zip(words, words[1:]))]
    pairs = spark.createDataFrame(rows, "template int, at int, first string, second string, pairs int")
    marker = spark.createDataFrame([(_MARK, 0, 1)], "template int, at int, pairs int")
    return (pairs.withColumn("pair", F.xxhash64("first", "second"))
            .unionByName(marker.withColumn("pair", F.lit(0).cast("long")), allowMissingColumns=True))


def pair_hits(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Votes: (id, hash, template, diagonal, bits, pairs) and, at template -1, n_words and times."""
    cut = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"),
                      F.split(ascii_lower(F.col(text)), _SEPARATORS).alias("words"))
    lead = F.when(F.col("words")[0] == "", 1).otherwise(0)
    # a separator at either end leaves an empty word there
    n = F.size(F.filter(F.array(F.element_at("words", 1), F.element_at("words", -1)), lambda w: w == ""))
    words = cut.select("id", "hash", "words", lead.alias("lead"),
                       F.when(F.size("words") == 1, F.when(F.col("words")[0] == "", 0).otherwise(1))
                       .otherwise(F.size("words") - n).cast("long").alias("n_words"))
    rolling = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b:
                         F.xxhash64(a, b))
    marked = F.concat(rolling, F.array(F.lit(0).cast("long")))
    rows = words.select("*", F.posexplode(marked).alias("pos", "pair"))
    met = rows.join(F.broadcast(templates), "pair").where(
        F.col("first").isNull() | ((F.col("words")[F.col("pos")] == F.col("first"))
                                   & (F.col("words")[F.col("pos") + 1] == F.col("second"))))
    mark = F.col("template") == _MARK
    return met.groupBy(
        "id", "hash", "template", "pairs",
        F.when(mark, 0).otherwise(F.col("pos") - F.col("lead") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"),
        F.max(F.when(mark, F.col("n_words"))).alias("n_words"), F.sum(F.when(mark, 1)).alias("times"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; spans of the
    accepted templates (label, first and last word), one for each place."""
    spark = docs.sparkSession
    votes = pair_hits(docs, template_pairs(spark, phrases, templates), key, text)
    label = F.element_at(F.array(*[F.lit(name) for _, name in [*phrases, *templates]]), F.col("template") + 1)
    base = F.col("template").between(0, len(phrases) - 1)
    # how far a span's diagonals may lie apart; a phrase's place is one diagonal, the marker is alone
    drift = F.when(F.col("template") < len(phrases), 0).otherwise(
        GAP * (F.col("pairs") - F.ceil(F.col("pairs") * COVER - 1e-9)).cast("int"))
    # in steps of the drift and half a word, the span of a diagonal is the range of one step from it
    near = W.partitionBy("id", "hash", "template").orderBy("step")
    span = near.rangeBetween(0, 1)
    whole = votes.withColumn("drift", drift).withColumn("step", F.col("diagonal") / (F.col("drift") + 0.5)).select(
        "*", F.bit_count(F.bit_or("bits").over(span)).alias("met"), F.max("diagonal").over(span).alias("end"))
    one, merged = F.bit_count("bits") / F.col("pairs"), F.col("met") / F.col("pairs")
    whole = whole.withColumn("ok", F.when(base, one == 1.0).otherwise((F.col("template") >= 0) & (merged >= COVER)))
    # spans that start within the drift of the accepted one before them are the same place
    last = F.max(F.when(F.col("ok"), F.col("diagonal"))).over(near.rowsBetween(W.unboundedPreceding, -1))
    other = F.col("ok") & (last.isNull() | (F.col("diagonal") - last > F.col("drift")))
    share = F.greatest(one, F.col("met") / (F.col("pairs") + F.col("end") - F.col("diagonal")))
    spans = whole.select(
        "id", "hash", "template", "pairs", "ok", "n_words", "times", other.alias("other"),
        F.col("step"), F.when(F.col("ok"), F.struct(
            share.alias("cover"), (-F.col("diagonal")).alias("start"), "end")).alias("best"))
    spans = spans.withColumn("span", F.sum(F.col("other").cast("int")).over(near)).where(
        F.col("ok") | (F.col("template") == _MARK))
    spans = spans.groupBy("id", "hash", "template", "pairs", "span", "ok").agg(
        F.max("best").alias("best"), F.max("n_words").alias("n_words"), F.max("times").alias("times")).select(
        "*", "best.cover", (-F.col("best.start")).alias("start"), "best.end")
    place = F.when(base & F.col("ok"), F.col("start").cast("long"))
    found = spans.groupBy("id", "hash").agg(
        F.max("n_words").alias("n_words"), F.count(place).alias("n_base"), F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base & F.col("ok"), label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok"), label))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("ok") & ~base, F.struct(
            label.alias("label"), F.col("start").alias("first"),
            (F.col("end") + F.col("pairs")).alias("last"))))).alias("spans"),
        F.max("times").alias("times"))
    return found.select(
        F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        "spans", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("col")
