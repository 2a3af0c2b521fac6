"""Benchmark decontamination by latent semantic retrieval.

1. Words (lower case, between white space and punctuation) become 32-bit hashes, once and in Spark's own
   functions, and their low ``BITS`` bits are the terms.  One pass over all texts counts in how many
   passages of ``DF_WORDS`` words each term occurs; only the term table (stated size) comes together.
2. A randomised SVD of TF-IDF passages gives the latent space: a seeded random block is multiplied by
   A'A in tasks over passages, orthonormalised, multiplied again and rotated.  It is fitted on all
   passages of all texts and on the block of items; every passage is projected and searched.
3. Texts are covered by windows of 16, 32 and 64 words, half overlapping; an item is searched at the
   scale that fits its length (the largest for longer ones).  A window and an item whose latent cosine
   reaches ``COSINE`` are a candidate.
4. A candidate is checked on the words' hashes, in the same task: the longest common subsequence of
   the item and the words around the window has to cover ``COVER`` of the item, and its answer has to
   be there: the words of the answer column, or else the rarer half of the item's words, again to
   ``COVER``.  Bounds by shared words come first; they never reject what the subsequence would accept.
   ``COVER`` lets few words of an item be absent, so a text with fewer than ``RARE`` of as many and
   ``RARE`` more of its rarest words is passed over after one look at its terms.

Items are searched in blocks of ``ITEM_BLOCK``, which bounds what a task is sent.  No text is shuffled.

Defined results: null and empty texts and items give no rows; a null key or item id is a value like any
other; repeated rows and items are reported one by one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .frames import filter_batches, over_batches

BITS = 15
RANK, OVER = 32, 8
DF_WORDS = 32
FIT_TASKS, TASK_PASSAGES = 8, 200_000  # least tasks of a multiplication, and passages for one more
SCALES = (16, 32, 64)
MULTIPLIED = 32  # passages that are multiplied at once, with the terms that occur in them; they stay in a core's cache
COSINE = 0.3
COVER = 0.8
RARE = 4
ITEM_BLOCK = 20_000
_STEP = 8  # words of a segment; windows are sums of segments
#: ASCII but digits and lower-case letters, Latin-1 signs, general and CJK punctuation
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\xBF\u2000-\u206F\u3000-\u303F]+"
_CODES = "_codes"


def word_codes(text):
    """Column of the hashes of a text's words; no text gives none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")
    return F.transform(words, lambda w: F.hash(w))


def terms(codes: np.ndarray) -> np.ndarray:
    return codes & ((1 << BITS) - 1)


def coded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, codes) of every text; written out, as three passes read it."""
    return materialise(docs.select(F.col(key).alias("id"), word_codes(F.col(text)).alias("codes")), "leak-codes")


def _arrays(batch: pa.RecordBatch, name: str = "codes") -> list[np.ndarray]:
    """The lists of a column, as views."""
    column = batch.column(name)
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def term_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and the number of passages, over all coded texts."""
    size = 1 << BITS

    def count(batches):
        total, passages = np.zeros(size, np.int64), 0
        for batch in batches:
            parts = []
            for codes in _arrays(batch):
                b = terms(codes)
                parts += [b, np.full(-len(b) % DF_WORDS, -1, np.int32)]
            rows = np.sort(np.concatenate(parts).reshape(-1, DF_WORDS), axis=1) if parts else np.empty((0, DF_WORDS), np.int32)
            first = rows >= 0
            first[:, 1:] &= rows[:, 1:] != rows[:, :-1]
            passages += len(rows)
            total += np.bincount(rows[first], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], passages))],
                                         ["term", "n"])

    rows = (texts.select("codes").mapInArrow(count, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())
    df = np.zeros(size, np.int64)
    n = 0
    for r in rows:
        if r.term < 0:
            n = r.n
        else:
            df[r.term] = r.n
    return df, n


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (df + 1)) + 0.05


def _rows_times(term: np.ndarray, row: np.ndarray, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A'(A block) of unit TF-IDF rows; ``row`` ascends."""
    out = np.zeros((len(idf), block.shape[1]))
    if not len(term):
        return out
    value, count = np.unique(row * len(idf) + term, return_counts=True)
    row, term = value // len(idf), value % len(idf)
    x = count * idf[term]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.append(starts, len(row)))
    x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, starts)), sizes)
    y = np.add.reduceat(x[:, None] * block[term], starts)
    back = x[:, None] * np.repeat(y, sizes, axis=0)
    order = np.argsort(term, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(term[order]) > 0]))
    out[term[order][heads]] = np.add.reduceat(back[order], heads)
    return out


def _flat(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    term, row, n = [], [], 0
    for codes in texts:
        b = terms(codes).astype(np.int64)
        term.append(b)
        row.append(n + np.arange(len(b)) // width)
        n += -(-len(b) // width)
    return (np.concatenate(term), np.concatenate(row)) if term else (np.empty(0, np.int64),) * 2


def _add_passages(total: np.ndarray, texts: list[np.ndarray], idf: np.ndarray, block: np.ndarray) -> None:
    """Add :func:`_rows_times` of the passages of texts, which have one width; ``idf`` and ``block`` are single floats."""
    width, parts = SCALES[-1], []
    for codes in texts:
        parts += [terms(codes), np.full(-len(codes) % width, -1, np.int32)]
    passages = np.concatenate(parts).reshape(-1, width) if parts else np.empty((0, width), np.int32)
    place = np.empty(len(idf) + 1, np.int32)  # the last one is for the filling of a text's last passage
    for low in range(0, len(passages), MULTIPLIED):
        some = passages[low:low + MULTIPLIED]
        used = np.zeros(len(idf) + 1, bool)
        used[some] = True
        used[-1] = False
        own = np.flatnonzero(used)
        columns = len(own) + 1
        place[own] = np.arange(len(own))
        place[-1] = len(own)
        cells = place[some] + np.arange(0, len(some) * columns, columns, dtype=np.int32)[:, None]
        count = np.bincount(cells.ravel(), minlength=len(some) * columns).reshape(-1, columns)
        x = count[:, :-1].astype(np.float32)
        x *= idf[own]
        # no passage is empty, as a text is only filled up to its last one
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        total[own] += x.T @ (x @ block[own])


def _multiplied(fit: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A'A block over the passages of ``fit``, added up by Spark per range of terms."""
    shared, width = fit.sparkSession.sparkContext.broadcast((idf.astype(np.float32), block.astype(np.float32))), block.shape[1]
    ranges = 32

    def work(batches):
        idf, block = shared.value
        total = np.zeros((len(idf), width))
        for batch in batches:
            _add_passages(total, _arrays(batch), idf, block)
        for k, part in enumerate(np.split(total.astype(np.float32), ranges)):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()])], ["part", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (np.frombuffer(d, np.float32).astype(np.float64) for d in pdf.data))
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "data": [total.tobytes()]})

    out = np.zeros_like(block)
    for r in (fit.mapInArrow(work, "part long, data binary").groupBy("part")
              .applyInPandas(add, "part long, data binary").collect()):
        out.reshape(ranges, -1)[r.part] = np.frombuffer(r.data)
    return out


def latent_space(texts: DataFrame, items: list[np.ndarray], idf: np.ndarray, passages: int,
                 seed: int = 11) -> np.ndarray:
    """(terms, RANK): right singular vectors, by two multiplications with all passages."""
    # every task hands on one block, so there are as few as the passages need
    fit = texts.select("codes").coalesce(FIT_TASKS + passages // TASK_PASSAGES)
    own = _flat(items, 1 << 30)
    q = np.random.default_rng(seed).standard_normal((len(idf), RANK + OVER))
    q, _ = np.linalg.qr(_multiplied(fit, idf, q) + _rows_times(*own, idf, q))
    z = _multiplied(fit, idf, q) + _rows_times(*own, idf, q)
    small = q.T @ z
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, ::-1][:, :RANK]).astype(np.float32)


def lcs(item: list, words: list) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    place: dict = {}
    for i, w in enumerate(item):
        place[w] = place.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        m = place.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


class Items:
    """A block of items: words, answers, unit latent vectors by scale."""

    def __init__(self, codes: list[np.ndarray], answers: list[np.ndarray], table: np.ndarray, idf: np.ndarray):
        self.codes = [c.tolist() for c in codes]
        self.words = [Counter(c) for c in self.codes]
        self.answers = []
        for code, answer in zip(self.codes, answers):
            given = answer.tolist()
            if not given:  # the rarer half of the item's distinct words
                rare = sorted(set(code), key=lambda c: (-idf[c & (1 << BITS) - 1], c))
                given = rare[:-(-len(rare) // 2)]
            self.answers.append(Counter(given))
        self.scale = np.array([min(SCALES, key=lambda s: (s < len(c), s)) if len(c) <= SCALES[-1] else SCALES[-1]
                               for c in self.codes], np.int64)
        v = np.array([table[terms(c)].sum(axis=0) for c in codes], np.float32).reshape(len(codes), table.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.terms = [terms(c) for c in codes]
        self.holders: dict = {}  # items by each of their rarest words, as often as they hold it
        self.least = []  # of these words that a text needs
        for item, own in enumerate(self.terms):
            present = np.arange(len(own) + 1)
            absent = len(own) - int(np.flatnonzero(present >= COVER * len(own))[0])
            rare = own[np.argsort(-idf[own], kind="stable")][:absent + RARE].tolist()
            self.least.append(len(rare) - absent)
            for t in rare:
                self.holders.setdefault(t, []).append(item)
        self.rare = np.zeros(len(idf), bool)
        self.rare[list(self.holders)] = True

    def possible(self, term: np.ndarray) -> np.ndarray:
        """Items of which enough words occur anywhere in a text of these terms."""
        seen = Counter(chain.from_iterable(self.holders[t] for t in set(term[self.rare[term]].tolist())))
        some = sorted(item for item, n in seen.items() if n >= self.least[item])
        if not some:
            return np.empty(0, np.int64)
        used = np.zeros(len(self.rare), bool)
        used[term] = True
        return np.array([i for i in some if np.count_nonzero(used[self.terms[i]]) >= COVER * len(self.terms[i])], np.int64)

    def within(self, item: int, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which of the regions ``first`` to ``last`` of a text share enough words with the item and with its answer."""
        enough = np.ones(len(first), bool)
        for bag in (self.words[item], self.answers[item]):
            shared = np.zeros(len(first), np.int64)
            for code, n in bag.items():
                at = np.flatnonzero(codes == code)
                if len(at):
                    shared += np.minimum(n, np.searchsorted(at, last) - np.searchsorted(at, first))
            enough &= shared >= COVER * bag.total()
        return np.flatnonzero(enough)


def _windows(sums: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and unit latent vectors of the half-overlapping windows of ``width`` words, from the sums
    of segments."""
    half = width // 2 // _STEP
    halves = np.add.reduceat(sums, np.arange(0, len(sums), half))
    if len(halves) > 1:
        halves = halves[:-1] + halves[1:]
    norm = np.linalg.norm(halves, axis=1, keepdims=True)
    return np.arange(len(halves)) * (width // 2), halves / np.maximum(norm, 1e-9)


def leaks_of(codes: np.ndarray, items: Items, table: np.ndarray, cosine: float = COSINE) -> list[tuple]:
    """(item, matched words, first, last + 1, cosine): the best place of each item that is found."""
    if not len(codes):
        return []
    term = terms(codes)
    possible = items.possible(term)
    if not len(possible):
        return []
    sums = np.add.reduceat(table[term], np.arange(0, len(codes), _STEP))
    best: dict = {}
    for width in SCALES:
        own = possible[items.scale[possible] == width]
        if not len(own):
            continue
        starts, vectors = _windows(sums, width)
        for low in range(0, len(own), 2000):
            some = own[low:low + 2000]
            close = vectors @ items.vectors[some].T
            for item, near in zip(some.tolist(), close.T):
                at = np.flatnonzero(near >= cosine)
                size = len(items.codes[item])
                first, last = np.maximum(0, starts[at] - size), starts[at] + width + size
                for k in items.within(item, codes, first, last).tolist():
                    matched = lcs(items.codes[item], codes[first[k]:last[k]].tolist())
                    if matched >= COVER * size and (item not in best or matched > best[item][0]):
                        best[item] = (matched, int(first[k]), min(int(last[k]), len(codes)), float(near[at[k]]))
    return [(item, *found) for item, found in best.items()]


def _searchers(texts: DataFrame, benchmark: DataFrame, item_key: str, item_text: str, answer: str | None):
    """Broadcasts of (table, items, their ids), one per block of items."""
    spark = texts.sparkSession
    df, n = term_frequencies(texts)
    idf = inverse_frequencies(df, n)
    questions = benchmark.select(
        F.col(item_key).alias("item"), word_codes(F.col(item_text)).alias("codes"),
        word_codes(F.col(answer) if answer else F.lit("")).alias("answer")).where(F.size("codes") > 0)
    blocks = max(1, -(-questions.count() // ITEM_BLOCK))
    for k in range(blocks):
        block = questions.where(F.pmod(F.xxhash64("item", "codes"), F.lit(blocks)) == k).collect()  # a stated number
        codes = [np.array(r.codes, np.int32) for r in block]
        table = latent_space(texts, codes, idf, n) * idf[:, None].astype(np.float32)
        items = Items(codes, [np.array(r.answer, np.int32) for r in block], table, idf)
        yield spark.sparkContext.broadcast((table, items, [r["item"] for r in block]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               item_key: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """doc_id, item_id, n_words (of the item), n_matched, cover, first_word, last_word (of the place searched), cosine
    of every text that holds an item."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = (f"`{key}` {kind}, `{item_key}` {item_kind}, n_words long, n_matched long, cover double, "
              "first_word long, last_word long, cosine double")
    texts, parts = coded(docs, key, text), []
    for shared in _searchers(texts, benchmark, item_key, item_text, answer):

        def work(batch, shared=shared):
            table, items, names = shared.value
            out = {c: [] for c in (key, item_key, "n_words", "n_matched", "cover", "first_word", "last_word", "cosine")}
            for doc, codes in zip(batch.column("id").to_pylist(), _arrays(batch)):
                for item, matched, first, last, cosine in leaks_of(codes, items, table):
                    size = len(items.codes[item])
                    for name, value in zip(out, (doc, names[item], size, matched, matched / size, first, last - 1, cosine)):
                        out[name].append(value)
            return out

        parts.append(over_batches(texts, schema, work))
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    kept = docs
    for shared in _searchers(coded(docs, key, text), benchmark, item_key, item_text, answer):

        def clean(batch, shared=shared):
            table, items, _ = shared.value
            return [not leaks_of(codes, items, table) for codes in _arrays(batch, _CODES)]

        kept = filter_batches(kept.withColumn(_CODES, word_codes(F.col(text))), clean, _CODES)
    return kept
