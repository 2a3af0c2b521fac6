"""Quality rules whose cutoffs are chosen under a risk limit.

Every text gets a few measures (symbols, repeated lines, repeated words, capitals, ...).  Each rule
has a loosest and a strictest cutoff; strictness runs from 0 (loosest) to ``STEPS``, and a text's level under
a rule is the first strictness at which that rule rejects it.  A path is a fixed set of rules that get stricter
together: all of them, or all but one; a text's level on a path is the smallest of its rules' levels.

Per stratum (language), and over all strata pooled, the labelled good texts are the holdout: going from loose to
strict on a path, a strictness is accepted while the exact binomial (Clopper-Pearson) upper bound on its
share of rejected good texts stays below ``alpha``.  Going in that fixed order and stopping at the first
failure needs no further correction on a path.  ``delta`` is divided over the strata and the pool (Bonferroni),
and inside each over its paths (``FULL`` of it for the path of all rules, the rest in equal parts), so with
probability 1 - delta every accepted strictness keeps its bound at once and any of them may be used.

A stratum uses the path of all rules where that certifies something, else the strictest certified path without
one rule (the first such rule), so a rule that is unfit for a language switches off itself alone.  A stratum that
certifies nothing of its own uses the pool's choice: its bound then holds for the pooled good texts and
not for that stratum by itself (``bound_on`` says which).  Where the pool has too few labelled texts as
well, the base rules alone reject.

Only counts per stratum, path and level meet in one place (strata x paths x STEPS rows).

Defined results: null texts have no words and fail the base rules; a null or empty stratum is one
stratum; a key with several labels counts as good only if all say so; null labels are left out;
repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .frames import over_batches

STEPS = 20
ALPHA, DELTA = 0.02, 0.05  #: allowed share of good texts rejected, chance that some bound fails
FULL = 0.6
#: name: (loosest, strictest) cutoff; a rule rejects values above its cutoff
RULES = {
    "symbol_share": (0.30, 0.02),       # symbols per code point in words
    "dup_line_share": (0.90, 0.30),     # repeated lines of lines with a word
    "repeat_share": (0.50, 0.15),       # words in repeated 3-word windows
    "same_word_share": (0.80, 0.10),    # words equal to the one before
    "upper_share": (0.95, 0.40),        # A-Z of A-Z and a-z
    "top_word_share": (0.60, 0.25),     # the commonest word's share
    "mean_word_chars": (40.0, 12.0),
}
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str) -> tuple:
    """The five counts, then the values of RULES in their order."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * 5 + (0.0,) * len(RULES)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeat = 0
    if n > 3:
        wide = len(number)
        _, pairs = np.unique(ids[:-1] * wide + ids[1:], return_inverse=True)
        _, at, count = np.unique(pairs[:-1] * wide + ids[2:], return_inverse=True, return_counts=True)
        twice = count[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= twice
        repeat = int(covered.sum())
    bytes_ = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((bytes_ - 65) < 26))
    letters = upper + int(np.count_nonzero((bytes_ - 97) < 26))
    values = (symbols / chars, dup_lines / len(lines), repeat / n,
              float(np.count_nonzero(ids[1:] == ids[:-1])) / n, upper / letters if letters else 0.0,
              float(np.bincount(ids).max()) / n, chars / n)
    return (n, chars, symbols, dup_lines, repeat, *values)


PATHS = ["", *RULES]  #: the rule that a path leaves out


def levels_of(values: tuple) -> list[int]:
    """Per rule the first strictness that rejects; STEPS + 1 where none does."""
    out = []
    for value, (loose, strict) in zip(values, RULES.values()):
        if value <= strict:
            out.append(STEPS + 1)
        elif value > loose:
            out.append(0)
        else:
            out.append(math.floor((loose - value) / (loose - strict) * STEPS) + 1)
    return out


def level_on(path) -> Column:
    """Level on the path that leaves out rule number ``path`` (from 1; 0: none) of a row with ``levels``."""
    return F.array_min(F.transform("levels", lambda x, i: F.when(i + 1 == path, STEPS + 1).otherwise(x)))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Per row: id, stratum, the five counts and the levels under each rule."""
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                        F.coalesce(text, F.lit("")).alias("text"))

    def work(batch):
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        return {"id": batch.column("id"), "stratum": batch.column("stratum"),
                **{name: [r[k] for r in rows] for k, name in enumerate(_COUNTS)},
                "levels": [levels_of(r[5:]) for r in rows]}

    return over_batches(plain, f"id {kind}, stratum string, " + "".join(f"{c} long, " for c in _COUNTS)
                        + "levels array<int>", work)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def upper_bound(rejected: int, total: int, miss: float) -> float:
    """Exact binomial upper confidence bound: the p where P(X <= rejected) = miss."""
    if rejected >= total:
        return 1.0
    logs = [math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1)
            for i in range(rejected + 1)]
    low, high = rejected / total, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.exp(c + i * math.log(p) + (total - i) * math.log1p(-p))
                   for i, c in enumerate(logs)) if p < 1 else 0.0
        low, high = (p, high) if tail > miss else (low, p)
    return high


def strictest(levels: pd.Series, counts: pd.Series, alpha: float, miss: float) -> int:
    """Last strictness accepted in the fixed order; -1 if not even the loosest is."""
    total, chosen, at = int(counts.sum()), -1, dict(zip(levels, counts))
    rejected = 0
    for step in range(STEPS + 1):
        rejected += int(at.get(step, 0))
        # the bound is never below rejected / total
        if not total or rejected / total > alpha or upper_bound(rejected, total, miss) > alpha:
            break
        chosen = step
    return chosen


def thresholds(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
               key: str = "doc_id", label: str = "quality") -> DataFrame:
    """stratum (null: the pool), n_good, path, strictness: the choice of each stratum with labelled good texts."""
    good = (labels.select(F.col(key).alias("id"), F.col(label).alias("y")).where("y is not null")
            .groupBy("id").agg(F.min("y").alias("y")).where("y = 1"))
    paths = F.explode(F.sequence(F.lit(0), F.lit(len(PATHS) - 1))).alias("path")
    counts = (features.where(~base_failed()).join(good, "id").groupBy("stratum", "levels").agg(F.count("*").alias("n"))
              .select("stratum", "levels", "n", paths)
              .groupBy("stratum", "path", level_on(F.col("path")).alias("level")).agg(F.sum("n").alias("n")))
    counts = materialise(counts, "rule-counts")  # at most strata x paths x (STEPS + 2) rows
    share = delta / (counts.select("stratum").distinct().count() + 1)
    pool = counts.groupBy("path", "level").agg(F.sum("n").alias("n")).select(
        F.lit(None).cast("string").alias("stratum"), "path", "level", "n")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for path, rows in pdf.groupby("path"):
            miss = share * (FULL if path == 0 else (1 - FULL) / len(RULES))
            found[int(path)] = strictest(rows.level, rows.n, alpha, miss)
        path = 0 if found[0] >= 0 else max(found, key=lambda p: (found[p], -p))
        return pd.DataFrame({"stratum": [pdf.stratum.iloc[0]], "n_good": [int(pdf.n[pdf.path == 0].sum())],
                             "path": [path], "strictness": [found[path]]})

    return counts.union(pool).groupBy("stratum").applyInPandas(
        choose, "stratum string, n_good long, path int, strictness int")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and what the verdict rests on: level, strictness, the rule left out
    (``without``, empty: none) and ``bound_on`` (stratum, pool or none)."""
    features = materialise(measured(docs), "rule-measures")
    chosen = materialise(thresholds(features, labels, alpha, delta), "rule-cutoffs")  # a row per stratum
    own = chosen.where("stratum is not null and strictness >= 0").select("stratum", "path", "strictness")
    pool = chosen.where("stratum is null and strictness >= 0").select(
        F.lit(True).alias("_one"), F.col("path").alias("pool_path"), F.col("strictness").alias("pool_strictness"))
    rows = features.join(own, "stratum", "left").withColumn("_one", F.lit(True)).join(F.broadcast(pool), "_one", "left")
    rows = rows.select("*", F.when(F.col("strictness").isNotNull(), "stratum")
                       .when(F.col("pool_strictness").isNotNull(), "pool").otherwise("none").alias("bound_on"),
                       F.coalesce("path", "pool_path", F.lit(0)).alias("_path"),
                       F.coalesce("strictness", "pool_strictness", F.lit(-1)).alias("_strictness"))
    rows = rows.withColumn("_level", level_on(F.col("_path")))
    return rows.select(
        F.col("id").alias("doc_id"), *_COUNTS, base_failed().alias("base_failed"),
        (~base_failed() & (F.col("_level") > F.col("_strictness"))).alias("kept"), F.col("_level").alias("level"),
        F.col("_strictness").alias("strictness"),
        F.element_at(F.array(*map(F.lit, PATHS)), F.col("_path") + 1).alias("without"), "bound_on")
