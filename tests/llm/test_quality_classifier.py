import random

import numpy as np
from pyspark.sql import functions as F

from fareloom.llm import quality_classifier as Q


def corpus(spark, n=400):
    rng = random.Random(3)
    words = ["ba", "lo", "mi", "ter", "oni", "quel", "asto", "venir"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(20, 90)))
        bad = i % 4 == 0
        if bad:
            text = " ".join(w + "###" for w in text.split()) if i % 8 else text.upper().replace(" ", "!! ")
        rows.append((i, text, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score long")


def test_learns_labels_it_has_not_seen(spark):
    docs = corpus(spark)
    labels = docs.select("doc_id", F.col("score").alias("quality"))
    got = Q.classify(docs, labels).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 40 and (out.predicted == out.quality).mean() >= 0.95
    assert got.score.between(0, 1).all()
    fold = docs.select("doc_id", F.crc32(F.col("doc_id").cast("string")).alias("c")).toPandas()
    assert dict(zip(got.doc_id, got.held_out)) == {r.doc_id: r.c % 5 == 0 for r in fold.itertuples()}


def test_dot_product_is_that_of_plain_python(spark):
    docs = corpus(spark, 40)
    weights = Q.fit(docs, docs.select("doc_id", F.col("score").alias("quality")), bits=12)
    again = Q.fit(docs.repartition(3), docs.select("doc_id", F.col("score").alias("quality")), bits=12)
    assert np.array_equal(weights, again)
    text = docs.first().text
    index, dense = Q.features(text, 12)
    margin = sum(float(weights[i]) * Q.WORD_SCALE / len(index) for i in index)
    margin += sum(float(weights[4096 + k]) * v for k, v in enumerate(dense))
    assert abs(Q.probabilities([text], weights)[0] - 1 / (1 + np.exp(-margin))) < 1e-6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "x " * 40_000)],
                                 "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    got = Q.classify(docs, none).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    assert Q.classify(docs, one).count() == 4
    assert Q.classify(docs.limit(0), one).count() == 0
