"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

Features of a text are hashed words, hashed word pairs (each as a share of the text's words), word
shapes (lower, title, upper, symbols, ...), and the shares of repeated words and pairs.  They come
from the text alone.  The model is fitted on a bounded sample of labelled rows (``fit_rows``), kept
by a hash of the key so that the sample does not depend on row order or partitions; one task reads
it in hash order, as the method is sequential.  Scoring is a sparse dot product inside each Arrow
batch over all rows.

Defined results: null and empty texts have no features and get the score of the bias; repeated rows
are scored one by one; a key with several labels counts as good if any is; null labels are left
out; without labels every score is 0.5; other columns are not read; a null key is held out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import filter_batches, over_batches

BITS = 18  #: 2 ** BITS hashed weights
FIT_ROWS = 6000  #: most labelled rows that the fit reads (expected value; kept by hash)
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0  #: the published update's parameters
WORD_SCALE, SHAPE_SCALE = 4.0, 4.0
N_SHAPES = 8
DENSE = N_SHAPES + 3  # shapes, repeated neighbours, repeated pairs, bias
SYMBOLS = frozenset("#*$%&|<>{}[]~^=+@\\/!?")
REMEMBERED = 500_000
_KNOWN: dict[str, int] = {}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _shape(word: str) -> int:
    if any(c in SYMBOLS for c in word[-2:]):
        return 6 if word.isupper() else 5
    if word.isupper():
        return 2 if len(word) > 1 else 7
    if word.isalpha():
        return 1 if word[0].isupper() else 0
    return 4 if any(c.isdigit() for c in word) else 3 if len(word) > 1 else 7


def _code(word: str) -> int:
    """Hash of the word with its shape in the low three bits."""
    code = _KNOWN.get(word)
    if code is None:
        if len(_KNOWN) > REMEMBERED:
            _KNOWN.clear()
        code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~7 | _shape(word)
        if len(word) < 64:
            _KNOWN[word] = code
    return code


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (repeats included) of hashed words and pairs, and the dense values."""
    words = text.split()
    dense = np.zeros(DENSE)
    dense[-1] = 1.0
    if not words:
        return np.empty(0, np.int64), dense
    try:
        codes = np.array([_KNOWN[w] for w in words], np.uint64)
    except KeyError:
        codes = np.array([_code(w) for w in words], np.uint64)
    dense[:N_SHAPES] = np.bincount((codes & np.uint64(7)).astype(np.int64), minlength=8) / len(words)
    pairs = codes[:-1] * _M1 ^ codes[1:] * _M2
    if len(pairs):
        dense[N_SHAPES] = np.mean(codes[1:] == codes[:-1])
        dense[N_SHAPES + 1] = 1 - len(np.unique(pairs)) / len(pairs)
    dense[:-1] *= SHAPE_SCALE
    shift = np.uint64(64 - bits)
    return np.concatenate([codes * _M1 >> shift, pairs * _M1 >> shift]).astype(np.int64), dense


def _values(index: np.ndarray) -> float:
    return WORD_SCALE / len(index) if len(index) else 0.0


def _ftrl(texts: list[str], labels: list[int], epochs: int, bits: int) -> np.ndarray:
    """Weights after ``epochs`` passes in the given order; dense weights stand at the end."""
    size = (1 << bits) + DENSE
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    rows = []
    for text in texts:
        index, dense = features(text, bits)
        unique, count = np.unique(index, return_counts=True)
        rows.append((np.concatenate([unique, np.arange(1 << bits, size)]),
                     np.concatenate([count * _values(index), dense])))
    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            z_at, n_at = z[at], n[at]
            w_at = np.where(np.abs(z_at) <= L1, 0.0, -(z_at - np.sign(z_at) * L1)
                            / ((BETA + np.sqrt(n_at)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w_at @ x, -35, 35)))
            g = (p - y) * x
            z[at] += g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / ALPHA * w_at
            n[at] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = EPOCHS,
        bits: int = BITS, key: str = "doc_id", text: str = "text",
        label: str = "quality") -> np.ndarray:
    """Weights learned from ``fit_rows`` labelled rows at most (expected); 1 MB at 18 bits."""
    order = F.xxhash64(F.col("id").cast("string"), F.lit("fit"))
    marked = (labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"))
              .where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y")))
    share = min(1.0, fit_rows / max(1, marked.count()))
    sample = marked.where((F.shiftrightunsigned(order, 11) / float(1 << 53)) < share)
    # a key may stand in many rows: one text per key keeps the sample bounded
    texts = (docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
             .join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text")))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "id"])
        weights = _ftrl(pdf.text.tolist(), pdf.y.tolist(), epochs, bits)
        return pd.DataFrame({"w": [weights.tobytes()]})

    found = (texts.withColumn("o", order).groupBy(F.lit(0).alias("g"))
             .applyInPandas(lambda pdf: learn(pdf), "w binary").collect())
    return (np.frombuffer(found[0].w, np.float32) if found
            else np.zeros((1 << bits) + DENSE, np.float32))


def probabilities(texts: list[str], weights: np.ndarray) -> list[float]:
    size = len(weights) - DENSE
    bits = size.bit_length() - 1
    out = []
    for text in texts:
        index, dense = features(text, bits)
        margin = float(weights[index].sum(dtype=np.float64) * _values(index) + weights[size:] @ dense)
        out.append(1 / (1 + float(np.exp(-max(-35.0, min(35.0, margin))))))
    return out


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``key`` and score (0 to 1, higher: better) of every row's whole text."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    plain = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return over_batches(plain, f"`{key}` {kind}, score double", lambda b: {
        key: b.column("id"), "score": probabilities(b.column("text").to_pylist(), shared.value)})


def accepted(docs: DataFrame, weights: np.ndarray, cutoff: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text reaches ``cutoff``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return filter_batches(docs, lambda batch: [p >= cutoff for p in probabilities(
        [t or "" for t in batch.column(text).to_pylist()], shared.value)])


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0):
    """Rows that no fit may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned outside the held-out fold."""
    weights = fit(docs, labels.where(~held_out()))
    return score(docs, weights).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= cutoff).cast("int").alias("predicted"))
