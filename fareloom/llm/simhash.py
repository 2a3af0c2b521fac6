"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits.  The binary Golay code (23, 12)
is perfect: every word of 23 bits is within three errors of exactly one codeword.  A segment's keys
are the codeword indices to which the segment and all its one-bit changes decode (one or six), so
two segments with at most two differing bits share a key: a word between them decodes to one index.
Four differing bits over three segments leave two cases.  Either no segment has more than two, and
the triples of keys meet; or one has three or four, the others have at most one together, so one of
them is equal and the pair (equal segment, key of the other) meets.

Equal fingerprints count once.  Key rows are sorted and read in a stream: buckets give links from
their first fingerprint to each one within the limit, or from local components where that does not
cover them, never pairs.  A bucket of more than ``CHUNK`` rows is worked on in chunks, and its rows go
to a second pass, which joins only fingerprints of components that are still different.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows share
a component; a null key gets a component but never names one, and a component of null keys only is
null; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .frames import over_batches

WORDS, LIMIT, SEED = 4, 4, 42
CHUNK = 1024
KEY_BATCH = 20_000  # rows of two longs per Arrow batch

# the generator polynomial of the Golay code
_GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


_HIGH = np.array([_remainder(d << 11) for d in range(4096)], np.int64)
_ERROR = np.zeros(2048, np.int64)
for _a in range(24):
    for _b in range(_a, 24):
        for _c in range(_b, 24):
            _e = (1 << _a | 1 << _b | 1 << _c) & 0x7FFFFF
            if _e.bit_count() == len({_a, _b, _c} - {23}):
                _ERROR[_HIGH[_e >> 11] ^ (_e & 2047)] = _e


def decode(word: np.ndarray) -> np.ndarray:
    """Index of the one codeword within three errors."""
    return (word ^ _ERROR[_HIGH[word >> 11] ^ (word & 2047)]) >> 11


def segment_keys(word: np.ndarray, bits: int) -> np.ndarray:
    """(rows, 6) indices of the words within one change; -1 fills up."""
    near = np.sort(decode(word[:, None] ^ np.array([0, *(1 << k for k in range(bits))])[None, :]), axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    place = np.cumsum(first, axis=1) - 1
    out = np.full((len(word), 6), -1, np.int64)
    row, column = np.nonzero(first)
    out[row, place[row, column]] = near[row, column]
    return out


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of each fingerprint."""
    x = prints.view(np.uint64)
    seg = [(x & np.uint64(0x7FFFFF)).astype(np.int64), (x >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64),
           (x >> np.uint64(46)).astype(np.int64)]
    keys = [segment_keys(s, b) for s, b in zip(seg, (23, 23, 18))]
    ka, kb, kc = keys[0][:, :, None, None], keys[1][:, None, :, None], keys[2][:, None, None, :]
    there = (ka >= 0) & (kb >= 0) & (kc >= 0)
    parts = [(np.nonzero(there)[0], (ka << 24 | kb << 12 | kc)[there])]
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), 1):
        there = keys[j] >= 0
        parts.append((np.nonzero(there)[0], (tag << 40 | seg[i][:, None] << 12 | keys[j])[there]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprint(text: str) -> int:
    """Signed 64 bits; a bit is set if it is in more than half of the shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[WORDS - 1:])]
    h = np.array(hashes, np.uint64)
    counts = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, hash (of the text), fp (long) per row."""
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.coalesce(text, F.lit("")).alias("text"))
    return over_batches(plain, f"id {kind}, hash long, fp long", lambda b: {
        "id": b.column("id"), "hash": b.column("hash"), "fp": [fingerprint(t) for t in b.column("text").to_pylist()]})


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it counts the absolute value


def local_links(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of one chunk, exactly."""
    near = _apart(x[:, None], x[None, :]) <= LIMIT
    label = np.arange(len(x))
    while True:
        lower = np.where(near, label[None, :], len(x)).min(axis=1)
        if np.array_equal(lower, label):
            break
        label = lower
    rest = label != np.arange(len(x))
    return x[label[rest]], x[rest]


def bucket_links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside complete buckets of at most CHUNK rows; keys are sorted."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    many = sizes > 1
    if not many.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    head = np.repeat(prints[starts], sizes)
    close = _apart(prints, head) <= LIMIT
    whole = np.logical_and.reduceat(close, starts)
    take = np.repeat(many & whole, sizes) & (prints != head)
    left, right = [head[take]], [prints[take]]
    for s, n in zip(starts[many & ~whole], sizes[many & ~whole]):
        if n > 2:
            a, b = local_links(prints[s:s + n])
            left.append(a)
            right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _links_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, no key); rows of large buckets (a, no b, key).  At most CHUNK rows wait."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)
    large = None  # key of a bucket already known to be large

    def out(a, b, key=None):
        n = len(a)
        if b is not None and n:
            pair = np.unique(np.stack([a, b], axis=1), axis=0)
            a, b, n = pair[:, 0], pair[:, 1], len(pair)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(a), none if b is None else pa.array(b), none if key is None else pa.array(key)],
            ["a", "b", "key"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        prints = np.concatenate([prints, batch.column("fp").to_numpy()])
        while len(keys):
            last = int(np.searchsorted(keys, keys[-1]))
            if last:  # complete buckets stand before the last one
                if large == keys[0]:  # the end of a large bucket
                    end = int(np.searchsorted(keys, large, side="right"))
                    yield out(*local_links(prints[:end]))
                    yield out(prints[:end], None, keys[:end])
                    large, keys, prints = None, keys[end:], prints[end:]
                    continue
                sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], keys[1:last] != keys[:last - 1]])), last))
                if sizes.max() <= CHUNK:
                    yield out(*bucket_links(keys[:last], prints[:last]))
                    keys, prints = keys[last:], prints[last:]
                    continue
                at = 0
                for n in sizes:
                    for s in range(at, at + n, CHUNK) if n > CHUNK else ():
                        yield out(*local_links(prints[s:min(s + CHUNK, at + n)]))
                    if n > CHUNK:
                        yield out(prints[at:at + n], None, keys[at:at + n])
                    elif n > 1:
                        yield out(*bucket_links(keys[at:at + n], prints[at:at + n]))
                    at += n
                keys, prints = keys[last:], prints[last:]
            elif len(keys) > CHUNK:  # one bucket, perhaps not ended
                large = keys[0]
                yield out(*local_links(prints[:CHUNK]))
                yield out(prints[:CHUNK], None, keys[:CHUNK])
                keys, prints = keys[CHUNK:], prints[CHUNK:]
            else:
                break
    if len(keys):
        if large == keys[0]:
            yield out(*local_links(prints))
            yield out(prints, None, keys)
        else:
            yield out(*bucket_links(keys, prints))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join all components of the distinct fingerprints ``fp``."""
    spark = prints.sparkSession

    def with_keys(batches):
        for batch in batches:
            x = batch.column("fp").to_numpy()
            for at in range(0, len(x), 1000):
                row, key = fuzzy_keys(np.ascontiguousarray(x[at:at + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x[at:at + 1000][row])], ["key", "fp"])

    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", None
    rows = spark.conf.get(name)
    spark.conf.set(name, str(KEY_BATCH))  # small fixed rows, many of them
    try:
        keyed = prints.select("fp").distinct().mapInArrow(with_keys, "key long, fp long")
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        found = (keyed.repartition(n, "key").sortWithinPartitions("key", "fp")
                 .mapInArrow(_links_of_sorted, "a long, b long, key long"))
        found = materialise(found, "simhash-links")
    finally:
        spark.conf.set(name, rows)
    first = found.where("b is not null").select("a", "b").distinct()
    large = found.where("key is not null").select("key", F.col("a").alias("fp")).distinct()
    if large.isEmpty():
        return first
    first = materialise(first, "simhash-first")
    roots = components(first).select(F.col("node").alias("fp"), "root")
    placed = large.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialise(placed, "simhash-large")
    mixed = (placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo < hi").select("key"))
    rest = placed.join(mixed, "key")
    other = rest.select("key", F.col("fp").alias("b"), F.col("root").alias("root_b"))
    more = rest.join(other, "key").where(
        (F.col("root") < F.col("root_b"))
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= LIMIT)).select(F.col("fp").alias("a"), "b")
    return first.union(more.distinct())


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint."""
    least = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(prints)).select(F.col("node").alias("fp"), "root")
    placed = materialise(least.join(roots, "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = materialise(fingerprints(docs, key, text), "simhash-prints")
    return prints.join(_classes(prints), "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs``; of each component only the row with the smallest key stays (null keys
    come last; of rows with one key the smallest text hash; of equal rows any one)."""
    marked = docs.select(F.struct(*docs.columns).alias("_own"), F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"))
    prints = materialise(fingerprints(docs, key, text), "simhash-prints")
    rows = prints.join(_classes(prints).select("fp", "root"), "fp").groupBy("root", "id", "hash").agg(F.count("*").alias("n"))
    stay = rows.groupBy("root").agg(F.min(F.struct(F.isnull("id"), "id", "hash", "n")).alias("s"))
    stay = materialise(stay.select("s.id", "s.hash", "s.n"), "simhash-stay")
    kept = marked.join(stay, marked["_id"].eqNullSafe(stay["id"]) & (marked["_hash"] == stay["hash"]))
    once = kept.where("n = 1").select("_own")
    many = kept.where("n > 1").dropDuplicates(["_id", "_hash"]).select("_own")
    return once.union(many).select("_own.*")
