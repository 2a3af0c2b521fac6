"""Ranked lexical search with MaxScore over pair bounds.

The index is a table of blocks: one row holds the postings of up to ``BLOCK_DOCS`` documents or
``BLOCK_CHARS`` characters (term, documents, occurrences, as flat arrays), written once and independent
of any query.  Statistics (documents, terms, document frequencies) are sums over blocks.

For a group of queries the lists of their terms are taken out of the index once, with their bounds: for
each block the largest impact of each term and, for the pairs into which a query's terms are put, the largest *joint*
impact over the intersection of the two terms' lists.  A document holds both terms of a pair, one or
none, so the pair adds at most max(joint, first alone, second alone), which is tighter than the sum
of the two maxima, as terms seldom reach theirs in one document.  Terms are paired by their weight
(heaviest with next), so that a pair is dropped or kept as a whole.

A query meets a block as follows.  Its units (pairs, a single term left over) are put in the order of
their bounds; those at the low end whose bounds together stay below the query's threshold cannot carry
a document over it, so only documents in the lists of the other units are candidates.  They are
scored unit by unit, and candidates whose score so far plus the bounds still open stay below the
threshold are dropped.  A block whose bounds all together stay below is skipped.  The threshold
starts at the score of the k-th document of the query's most promising block, found in a first round, and
rises with each block of a task.  Equal scores are kept, so results are exact.

Scores are 64-bit integers.  A group of queries has ``QUERY_TERMS`` terms at most (about, or one query
more), which bounds what is broadcast; more queries are more groups, each over the same index.

Defined results: null and empty texts hold no term and count in no statistic; an item without a term
has no rows; repeated items are ranked one by one, repeated documents too; a null doc_id comes before
others among equal scores; other columns are not read; empty tables give an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise
from .frames import ASCII_LOWER

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 50
BLOCK_DOCS, BLOCK_CHARS = 4096, 8_000_000
QUERY_TERMS = 100_000
#: A block is a large row: Spark reads a row group of arrays as a whole, so each block has one of its own, at any file size.
ROW_GROUPS = {"parquet.block.row.count.limit": 1}
NO_ID = np.iinfo(np.int64).min  #: stands for a null document id inside tasks
_BLOCK = ("block long, ids array<long>, sizes array<long>, docs long, total long, terms array<string>, "
          "starts array<int>, places array<int>, counts array<int>")
_DF = "term string, df long"
_FOUND = "query int, doc_id long, score long"
_LISTS = ("block long, ids array<long>, sizes array<long>, starts array<int>, places array<int>, counts array<int>, "
          "most array<long>, joint array<long>")
_PARTS = [part.split()[0] for part in _LISTS.split(", ")]


def terms_of(text: str | None) -> list[str]:
    text = text or ""
    return TERM.findall(text.lower() if text.isascii() else text.translate(ASCII_LOWER))


# ---------------------------------------------------------------- index

class _Numbers(dict):
    def __missing__(self, term):
        self[term] = n = len(self)
        return n


def _block(number: int, ids: list, texts: list[list[str]]) -> dict:
    """One row of the index."""
    numbers = _Numbers()
    get = numbers.__getitem__
    coded = [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    places = np.repeat(np.arange(len(coded)), sizes)
    codes = np.concatenate(coded) if coded else np.empty(0, np.int64)
    pairs, counts = np.unique(codes * len(coded) + places, return_counts=True)
    of_term = pairs // max(1, len(coded))
    return {"block": number, "ids": [NO_ID if i is None else i for i in ids], "sizes": sizes,
            "docs": int((sizes > 0).sum()), "total": int(sizes.sum()), "terms": list(numbers),
            "starts": np.searchsorted(of_term, np.arange(len(numbers) + 1)).astype(np.int32),
            "places": (pairs % max(1, len(coded))).astype(np.int32), "counts": counts.astype(np.int32)}


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS,
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The blocks of all rows of ``docs``."""
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], _BLOCK).schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        ids, texts, chars = [], [], 0

        def row():
            made = _block(number, ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(terms_of(t))
                chars += len(t or "")
                if len(ids) >= block_docs or chars >= block_chars:
                    yield row()
                    number, ids, texts, chars = number + 1, [], [], 0
        if ids:
            yield row()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _BLOCK)


class Block:
    """The lists of the queries' terms in one block; term numbers are those of ``Queries``."""

    def __init__(self, row: dict, average: tuple[int, int]):
        documents, total = average
        self.ids = row["ids"]
        self.starts, self.places, self.counts = row["starts"], row["places"], row["counts"]
        self.spread = 20 * (50 + 50 * row["sizes"] * documents // max(1, total))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts (without the weight) of a term."""
        lo, hi = self.starts[term], self.starts[term + 1]
        places, tf = self.places[lo:hi], self.counts[lo:hi].astype(np.int64)
        return places, 1_000_000_000 * tf // (1000 * tf + self.spread[places])


# ---------------------------------------------------------------- queries

class Queries:
    """Terms of a group of queries, their weights, and the pairs of each query."""

    def __init__(self, words: list[set[str]], df: dict[str, int], documents: int):
        self.terms = sorted(set().union(*words)) if words else []
        self.number = {t: i for i, t in enumerate(self.terms)}
        ratio = (2 * documents + 2) / (2 * np.array([df.get(t, 0) for t in self.terms], np.float64) + 1)
        self.weights = np.array([int(np.floor(1000 * np.log(r))) for r in ratio], np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        self.units: list[list[tuple[int, ...]]] = []  # of each query: terms of its pairs and of its odd one
        for held in words:
            order = sorted((self.number[t] for t in held), key=lambda i: (-self.weights[i], i))
            units = [tuple(order[k:k + 2]) for k in range(0, len(order), 2)]
            self.units.append(units)
            for unit in units:
                if len(unit) == 2:
                    self.pairs.setdefault(unit, len(self.pairs))

    def places_in(self, terms: pa.Array) -> np.ndarray:
        """Where each query term stands among a block's terms; -1 if nowhere."""
        import pyarrow.compute as pc
        found = pc.index_in(pa.array(self.terms, terms.type), value_set=terms)
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(batch: pa.RecordBatch, columns: list[str]):
    """Each row's lists as numpy arrays, terms as an Arrow array."""
    for i in range(batch.num_rows):
        row = {}
        for name in columns:
            value = batch.column(name)[i]
            row[name] = (value.values if name == "terms" else value.values.to_numpy(zero_copy_only=False)
                         if pa.types.is_list(value.type) else value.as_py())
        yield row


def document_frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """Documents that hold each of ``terms``."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        import pyarrow.compute as pc
        held = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for row in _rows(batch, ["terms", "starts"]):
                at = pc.fill_null(pc.index_in(pa.array(shared.value, row["terms"].type), value_set=row["terms"]), -1)
                at = at.to_numpy(zero_copy_only=False)
                df = np.diff(row["starts"])
                held[at >= 0] += df[at[at >= 0]]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([shared.value[i] for i in some], pa.string()), pa.array(held[some], pa.int64())],
                                         ["term", "df"])

    counted = index.select("terms", "starts").mapInArrow(run, _DF).groupBy("term").agg(F.sum("df").alias("df"))
    return {row.term: row.df for row in counted.collect()}


def _chosen(row: dict, at: np.ndarray) -> dict:
    """The lists of the terms at ``at`` (-1: an empty list), in that order."""
    sizes = np.where(at >= 0, row["starts"][at + 1] - row["starts"][at], 0)
    starts = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    shift = np.where(at >= 0, row["starts"][at], 0) - starts[:-1]
    take = np.arange(starts[-1]) + np.repeat(shift, sizes)
    return {"ids": row["ids"], "sizes": row["sizes"], "starts": starts, "places": row["places"][take],
            "counts": row["counts"][take]}


def pair_bounds(block: Block, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """The largest weighted impact of every term, and the largest joint one of every pair."""
    most, joint = np.zeros(len(queries.terms), np.int64), np.zeros(len(queries.pairs), np.int64)
    lists = {}
    for term in np.flatnonzero(np.diff(block.starts)):
        places, impacts = block.of(term)
        lists[term] = places, queries.weights[term] * impacts
        most[term] = lists[term][1].max()
    dense = np.zeros(len(block.ids), np.int64)
    for (first, second), pair in queries.pairs.items():
        if first in lists and second in lists:
            (places, impacts), (others, more) = lists[first], lists[second]
            dense[places] = impacts
            joint[pair] = np.where(dense[others] > 0, dense[others] + more, 0).max()
            dense[places] = 0
    return most, joint


def query_lists(index: DataFrame, shared, average: tuple[int, int]) -> DataFrame:
    """For each block the lists of the queries' terms with their bounds."""
    arrow = to_arrow_schema(index.sparkSession.createDataFrame([], _LISTS).schema)

    def run(batches):
        queries = shared.value
        for batch in batches:
            for row in _rows(batch, ["block", "ids", "sizes", "terms", "starts", "places", "counts"]):
                lists = _chosen(row, queries.places_in(row["terms"]))
                most, joint = pair_bounds(Block(lists, average), queries)
                lists |= {"block": row["block"], "most": most, "joint": joint}
                yield pa.RecordBatch.from_arrays([pa.array([lists[f.name]], f.type) for f in arrow], schema=arrow)

    return index.mapInArrow(run, _LISTS)


def unit_bounds(queries: Queries, query: int, most: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """What each unit of a query adds at most in a block."""
    return np.array([max(int(most[u[0]]), int(most[u[1]]), int(joint[queries.pairs[u]])) if len(u) == 2 else int(most[u[0]])
                     for u in queries.units[query]], np.int64)


def search_block(block: Block, queries: Queries, query: int, ceiling: np.ndarray,
                 threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of the block that score ``threshold`` or more (and above 0)."""
    units = queries.units[query]
    order = np.argsort(ceiling, kind="stable")
    below = np.cumsum(ceiling[order])
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    need = max(1, threshold)
    if not len(below) or below[-1] < need:
        return none
    optional = int(np.searchsorted(below, need, "left"))  # units order[:optional] together stay below
    scores = np.zeros(len(block.ids), np.int64)
    for u in order[optional:]:
        for term in units[u]:
            if queries.weights[term] > 0:
                places, impacts = block.of(term)
                scores[places] += queries.weights[term] * impacts
    rest = int(below[optional - 1]) if optional else 0
    candidates = np.flatnonzero(scores)
    candidates = candidates[scores[candidates] + rest >= need]
    wanted = np.zeros(len(block.ids), bool)
    for u in order[:optional][::-1]:
        if not len(candidates):
            return none
        wanted[:] = False
        wanted[candidates] = True
        for term in units[u]:
            if queries.weights[term] > 0:
                places, impacts = block.of(term)
                held = wanted[places]
                scores[places[held]] += queries.weights[term] * impacts[held]
        rest -= int(ceiling[u])
        candidates = candidates[scores[candidates] + rest >= need]
    return candidates, scores[candidates]


def best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best, by score, then by id."""
    return np.lexsort((ids, -scores))[:most]


def search(lists: DataFrame, shared, average: tuple[int, int], thresholds, most: int) -> DataFrame:
    """(query, doc_id, score): per task the best documents of each query in its blocks.

    ``lists`` has the column ``wanted``, the queries to answer in a block; ``thresholds`` is a broadcast array.
    """
    names = [*_PARTS[1:], "wanted"]

    def run(batches):
        queries, floor = shared.value, thresholds.value.copy()
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in _rows(batch, names):
                block = Block(row, average)
                for query in row["wanted"]:
                    ceiling = unit_bounds(queries, query, row["most"], row["joint"])
                    places, scores = search_block(block, queries, query, ceiling, int(floor[query]))
                    if not len(places):
                        continue
                    ids = row["ids"][places]
                    if query in kept:
                        ids, scores = np.concatenate([kept[query][0], ids]), np.concatenate([kept[query][1], scores])
                    order = best(ids, scores, most)
                    kept[query] = ids[order], scores[order]
                    if len(order) == most:
                        floor[query] = max(floor[query], scores[order[-1]])
        for query, (ids, scores) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query, np.int32)), pa.array(ids), pa.array(scores)],
                                             ["query", "doc_id", "score"])

    return lists.select(*names).mapInArrow(run, _FOUND)


def _top(found: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= most)


def ranked(index: DataFrame, texts: list[str | None], most: int = TOP) -> DataFrame:
    """(query, rank, doc_id, score) for a group of queries; ``query`` is the place in ``texts``.

    ``index`` is a written table of blocks.
    """
    context = index.sparkSession.sparkContext
    sums = index.agg(F.sum("docs"), F.sum("total")).first()
    average = (sums[0] or 0, sums[1] or 0)
    words = [set(terms_of(t)) for t in texts]
    queries = Queries(words, document_frequencies(index, sorted(set().union(*words))), average[0])
    shared = context.broadcast(queries)
    lists = materialise(query_lists(index, shared, average), "lists", **ROW_GROUPS)

    # first round: each query in the block that promises most gives its threshold
    def totals(batches):
        held = shared.value
        for batch in batches:
            rows = [(row["block"], np.array([int(unit_bounds(held, q, row["most"], row["joint"]).sum()) for q in range(len(held.units))]))
                    for row in _rows(batch, ["block", "most", "joint"])]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()),
                                              pa.array([t for _, t in rows], pa.list_(pa.int64()))], ["block", "totals"])

    promised = lists.select("block", "most", "joint").mapInArrow(totals, "block long, totals array<long>")
    leader = (promised.select("block", F.posexplode("totals").alias("query", "promise"))
              .groupBy("query").agg(F.max(F.struct("promise", "block")).alias("b")).select("query", "b.promise", "b.block"))
    first = leader.where("promise > 0").groupBy("block").agg(F.collect_list("query").alias("wanted"))
    nothing = context.broadcast(np.zeros(len(texts), np.int64))
    opening = search(lists.join(F.broadcast(first), "block"), shared, average, nothing, most)  # a row per query at most
    thresholds = np.zeros(len(texts), np.int64)
    for row in _top(opening, most).where(F.col("rank") == most).select("query", "score").collect():
        thresholds[row.query] = row.score

    # second round: all blocks that may hold a document at the threshold or above
    lows = context.broadcast(thresholds)
    every = lists.withColumn("wanted", F.sequence(F.lit(0), F.lit(len(texts) - 1)))
    return _top(search(every, shared, average, lows, most), most)


def search_items(docs: DataFrame, items: DataFrame, most: int = TOP, item: str = "item_id", text: str = "text",
                 query_terms: int = QUERY_TERMS, **sizes) -> DataFrame:
    """item, rank, doc_id, score: the ``most`` best documents for every row of ``items``."""
    spark = docs.sparkSession
    index = materialise(build_index(docs, **sizes), "index", **ROW_GROUPS)
    kind = items.schema[item].dataType.simpleString()
    asked = items.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    length = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-length // (query_terms * 4)))  # a term takes four characters at least, as a rule
    found = None
    for group in range(groups):
        rows = asked.where(F.pmod(F.xxhash64(F.col("item").cast("string"), "text"), F.lit(groups)) == group).collect()
        if not rows:
            continue
        named = spark.createDataFrame([(q, r.item) for q, r in enumerate(rows)], f"query int, `{item}` {kind}")
        part = (ranked(index, [r.text for r in rows], most).join(F.broadcast(named), "query")
                .select(item, "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score"))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"`{item}` {kind}, rank int, doc_id long, score long")
