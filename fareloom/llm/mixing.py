"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The tree is domain, language, source.  A node's weight is relative to its siblings.  A node can give
its tokens up to ``max_epochs`` times.  The budget runs down from the root: children of a node share
its budget by weight; one that cannot give its share gives all it has, and what is short falls to
its siblings by weight.  As a node asks no more than its whole subtree can give, only a subtree that
is used up leaves a shortage to the siblings of its parent: siblings come before ancestors.

A leaf with budget T and N tokens gives every row floor(T / N) times, then a prefix of one more epoch
in the order of a hash of (seed, epoch, key, text): as far as its running tokens stay within what is
left, and the text that crosses that end too if this comes nearer to it, so a leaf is at most half a text
off, to either side.  Where that prefix ends is found without sorting the leaf: tokens per hash range first, then
only the rows of the range where it ends, with equal rows counted together.

Defined results: null names are the empty name; null texts have no tokens; a weight not given is 1, null
or negative ones are 0; rows without tokens come along with the prefix; repeated rows are taken one by
one; an empty table or a budget of 0 gives an empty table; columns besides the named ones are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

LEVELS = ("domain", "lang", "source")
BUCKETS_BITS = 12
_OWN = "_mix_"


def word_count(text):
    """Words between white space; null has none."""
    cut = F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+")
    ends = F.when(cut[0] == "", 1).otherwise(0) + F.when(F.element_at(cut, -1) == "", 1).otherwise(0)
    return F.greatest(F.size(cut) - ends, F.lit(0)).cast("long")


def described(docs: DataFrame, domain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, hash, domain, lang, source, tokens of every row; ``domain`` is an expression over docs."""
    return docs.select(
        F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"),
        F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS[1:]],
        word_count(F.col(text)).alias("tokens"))


def _shares(children: DataFrame, parent: list[str]) -> DataFrame:
    """amount of each child from its parent's ``budget``: weights, with shortages to siblings.

    Children in the order of room per weight: those that give all they have come first, so running
    sums tell what is left for the others.  One row per node of the tree.
    """
    w = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = w.orderBy(F.expr("try_divide(room, weight)").asc_nulls_last(), children.columns[len(parent)])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    weight = F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = children.withColumn("level", F.try_divide(left, weight)).withColumn(
        "full", (F.col("weight") > 0) & (F.col("room") <= F.col("weight") * F.col("level") * (1 + 1e-12)))
    given = F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(w), F.lit(0.0))
    open_weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(w), F.lit(0.0))
    rest = F.try_divide(F.col("weight") * (F.col("budget") - given), open_weight)
    return ranked.withColumn("amount", F.when(F.col("full"), F.col("room")).otherwise(
        F.greatest(F.lit(0.0), F.least("room", F.coalesce(rest, F.lit(0.0)))))).drop("level", "full")


def budgets(rows: DataFrame, weights: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """domain, lang, source, n (tokens), amount of every leaf.

    ``weights`` has level (name of a tree level), name, weight; ``share`` of all tokens is the budget.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("n"))
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    known = weights.select("level", F.coalesce("name", F.lit("")).alias("name"), weight.alias("weight"), F.lit(True).alias("given"))
    total = leaves.agg((F.coalesce(F.sum("n"), F.lit(0)) * F.lit(float(share))).alias("budget"))
    down = None
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = leaves.groupBy(*parent, level).agg((F.sum("n") * float(max_epochs)).alias("room"))
        own = known.where(F.col("level") == level).select(F.col("name").alias(level), "weight", "given")
        nodes = nodes.join(own, level, "left").withColumn(
            "weight", F.when(F.col("given"), F.col("weight")).otherwise(1.0)).drop("given")
        nodes = nodes.select(*parent, level, "room", "weight")
        nodes = nodes.join(down, parent) if parent else nodes.join(F.broadcast(total))  # one row
        down = _shares(nodes, parent).select(*parent, level, F.col("amount").alias("budget"))
    return leaves.join(down.withColumnRenamed("budget", "amount"), list(LEVELS))


def _place(seed: int, epoch, key, text_hash):
    return F.xxhash64(F.lit(seed), epoch, key.cast("string"), text_hash)


def cuts(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Per leaf: full epochs, the last hash wholly taken, the hash of the equal rows taken in part and
    how many of them."""
    names = list(LEVELS)
    asked = F.floor("amount")
    leaves = leaves.select(*names, F.coalesce(F.floor(F.try_divide(asked, F.col("n"))), F.lit(0)).alias("full"),
                           F.when(F.col("n") > 0, F.pmod(asked, F.col("n"))).otherwise(0).alias("rest"))
    leaves = materialise(leaves, "mix-leaves")
    placed = (rows.join(leaves, names)
              .withColumn("h", _place(seed, F.col("full"), F.col("id"), F.col("hash")))
              .groupBy(*names, "rest", "h", "id", "hash")  # equal rows count together
              .agg(F.max("tokens").alias("each"), F.count("*").alias("times"))
              .withColumn("range", F.shiftright("h", 64 - BUCKETS_BITS))
              .withColumn("sum", F.col("each") * F.col("times")))
    by_leaf = W.partitionBy(*names)
    ranges = placed.groupBy(*names, "rest", "range").agg(F.sum("sum").alias("sum"))
    upto = F.sum("sum").over(by_leaf.orderBy("range"))
    last = (ranges.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
            .groupBy(*names).agg(F.min_by(F.struct("range", (F.col("upto") - F.col("sum")).alias("before")), "range")
                                 .alias("r")).select(*names, "r.range", "r.before"))
    inner = placed.join(last, [*names, "range"])
    running = F.sum("sum").over(by_leaf.orderBy("h", "id", "hash"))
    inner = inner.withColumn("upto", F.col("before") + running)
    end = (inner.where(F.col("upto") > F.col("rest")).groupBy(*names)
           .agg(F.min_by(F.struct("h", "id", "hash", ((F.col("rest") - F.col("upto") + F.col("sum"))).alias("left"), "each"),
                         F.struct("h", "id", "hash")).alias("e")))
    # every leaf with less than one epoch left has a row that no longer fits whole
    return leaves.join(end, names, "left").select(
        *names, "full", F.col("e.h").alias("end_h"), F.col("e.id").alias("end_id"), F.col("e.hash").alias("end_hash"),
        F.coalesce(F.floor(F.try_divide(2 * F.col("e.left") + F.col("e.each") - 1, 2 * F.col("e.each"))), F.lit(0))
        .cast("int").alias("end_times"))


def take(rows: DataFrame, found: DataFrame, seed: int) -> DataFrame:
    """All columns of ``rows`` (with id, hash and the tree's names), one row per copy, with its epoch."""
    names = list(LEVELS)
    own = rows.columns
    at = F.struct(_place(seed, F.col("full"), F.col("id"), F.col("hash")).alias("h"), F.col("id").alias("id"),
                  F.col("hash").alias("hash"))
    end = F.struct(F.col("end_h").alias("h"), F.col("end_id").alias("id"), F.col("end_hash").alias("hash"))
    joined = rows.join(found, names)
    # a leaf without an end has nothing left over for another epoch
    copies = F.col("full").cast("int") + F.when(F.col("end_h").isNotNull() & (at < end), 1).otherwise(0)
    whole = joined.where(
        copies > 0).select(*own, F.explode(F.sequence(F.lit(0), copies - 1)).alias("epoch"))
    part = (joined.where((F.col("end_times") > 0) & (at == end)).groupBy(*own, "full", "end_times").agg(F.lit(1))
            .select(*own, F.explode(F.array_repeat(F.col("full").cast("int"), F.col("end_times"))).alias("epoch")))
    return whole.unionByName(part)


def mix(docs: DataFrame, domain, weights: DataFrame, share: float = 1.0, max_epochs: float = 4.0,
        seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch: one row per copy taken."""
    rows = materialise(described(docs, domain, key, text), "mix-rows")
    found = materialise(cuts(rows, budgets(rows, weights, share, max_epochs), seed), "mix-cuts")
    return take(rows, found, seed).select(F.col("id").alias(key), *LEVELS, "tokens", "epoch")


def mixed_documents(docs: DataFrame, domain, weights: DataFrame, share: float, max_epochs: float = 1.0,
                    seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs``, one row per copy taken; texts are filtered where they lie."""
    rows = materialise(described(docs, domain, key, text), "mix-rows")
    found = materialise(cuts(rows, budgets(rows, weights, share, max_epochs), seed), "mix-cuts")
    named = docs.select(F.struct(*docs.columns).alias(_OWN), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"),
                        F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS[1:]])
    return take(named, found, seed).select(f"{_OWN}.*")
