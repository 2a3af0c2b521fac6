"""Passages that repeat across texts, found through compact windows of min-hashes.

A text's tokens are its five-word shingles.  For each of ``HASHES`` hash functions the Cartesian tree over
the hashed tokens gives compact windows (l, c, r): every run of tokens that starts in [l, c] and ends
in [c, r] has its smallest hash at c.  Only windows of at least ``TOKENS`` tokens matter; they
are found by sliding minima and a stack over the few places that can carry one.

Windows meet if they agree on the hash function, the token at c and one more token ``ANCHOR`` places to
its right or left: two texts that share ``TOKENS`` tokens around c share one of these two.  Rows of one
key are sorted and read in a stream.  The first window of a key, and each that overlaps no earlier
one by ``TOKENS`` tokens, leads (at most ``TOKENS`` do); the others are paired with their leader only.
Overlaps of one pair of texts over all keys and hash functions are joined; a pair that enough of
them name (``enough`` keys) is verified on its words.

Verification marks the tokens that occur in the other text's part and takes the segments of at least
``TOKENS`` tokens of which ``SIMILAR`` or more are marked, on either side.  Windows of one key may share a
passage that their leader lacks, so a key of three windows or more has a second round, whatever its pairs
gave: under the hash of every run of ``TOKENS`` tokens that holds the token at c and lies in the window.
A leader and its text's later windows send all their runs, every other window those that its leader does
not hold in the same place, or all if their leader's text has the key again; so windows that share a run meet there or through their leaders for certain,
and one leader per run is enough (a second text stands in for it where its own text has the run again).

Equal texts are one text all along (hash of the text).  Keys that are common in a sample of the texts
are dealt out by text and their leaders paired in a second pass; that sample only spreads work.

Result: one row per document with a repeated passage.  Defined results: null texts and texts of less
than ``WORDS`` words have none; equal rows (key and text) are one document and share nothing with
themselves; a null key never names a class; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .frames import over_batches

SHINGLE, WORDS = 5, 50
TOKENS = WORDS - SHINGLE + 1
ANCHOR = TOKENS // 2 - 1
HASHES = 3
SIMILAR = 0.8
SAMPLE, COMMON, SPREAD = 4000, 12, 64
NONE, OTHER, ALL = range(3)  #: runs that a window sends: OTHER are those its leader does not hold in the same place
LONGEST = (1 << 18) - 1  #: tokens of a window to either side of c that are kept
ROW_BATCH = 50_000
WORD = np.uint32  #: bits of a word's hash that its verification sees
VERIFIED, TOGETHER = 1_000_000, 50_000  #: words that are looked at together in verification and in windows

_U = np.uint64
_SEEDS = [(_U(0x9E3779B97F4A7C15 + 2 * k * 0x1000193), _U(0xC2B2AE3D27D4EB4F + 2 * k * 0x10001)) for k in range(16)]
_BASE = _U(0x100000001B3)
_RUN_BASE, _RUN_INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_KNOWN: dict[bytes, int] = {}


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    try:
        return np.array([_KNOWN[w] for w in words], _U)
    except KeyError:
        if len(_KNOWN) > 500_000:
            _KNOWN.clear()
        digest = xxhash.xxh64_intdigest
        out = []
        for w in words:
            h = _KNOWN.get(w)
            if h is None:
                h = digest(w)
                if len(w) < 64:
                    _KNOWN[w] = h
            out.append(h)
        return np.array(out, _U)


def shingles(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, _U)
    out = words[:n].copy()
    for k in range(1, SHINGLE):
        out = out * _BASE + words[k:n + k]
    return out


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    a, b = _SEEDS[k]
    x = (x ^ a) * b
    x = (x ^ (x >> _U(31))) * a
    return x ^ (x >> _U(29))


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op (a minimum or maximum) over every run of ``width`` values, by runs of doubled width."""
    n, have = len(a) - width + 1, 1
    while 2 * have <= width:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[:n], a[width - have:width - have + n])


def compact_rows(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                 width: int = TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least ``width`` tokens of several texts; of equal hashes the first
    counts.  Texts lie in ``h`` with at least two free places before, between and behind them; no hash is 0."""
    s = starts[lengths >= width]
    e = s + lengths[lengths >= width]
    if not len(s):
        return (np.empty(0, np.int64),) * 3
    edge = np.zeros(len(h) - width + 1, np.int8)
    edge[s] = 1
    edge[e - width + 1] -= 1
    least = np.where(np.cumsum(edge, dtype=np.int8) > 0, _sliding(h, width, np.minimum), _U(0))
    none = np.zeros(width - 1, h.dtype)
    most = _sliding(np.concatenate([none, least, none]), width, np.maximum)
    # smallest of some run; the tree's other nodes are too narrow.  Ends of texts are smaller than all
    places = np.concatenate([np.flatnonzero(h == most), s - 1, e])
    places.sort()
    h = h.copy()
    h[s - 1] = h[e] = 0
    stack: list[int] = []
    inside = h[places] > 0
    values, at = h[places].tolist(), places.tolist()
    lefts, rights = [0] * len(at), [0] * len(at)
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            rights[stack.pop()] = at[i]
        if v:
            lefts[i] = at[stack[-1]]
        else:
            stack.clear()
        stack.append(i)
    left, right = np.array(lefts), np.array(rights)
    wide = inside & (right - left - 1 >= width)
    return left[wide] + 1, places[wide], right[wide] - 1


def compact(h: np.ndarray, width: int = TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of one text, for hashes of any size."""
    ranks = np.pad(np.unique(h, return_inverse=True)[1].astype(_U) + _U(1), 2, constant_values=1)
    found = compact_rows(ranks, np.array([2]), np.array([len(h)]), width)
    return tuple(x - 2 for x in found)


def _packed(c, a, b):
    return c << 36 | np.minimum(a, LONGEST) << 18 | np.minimum(b, LONGEST)


def _unpacked(p):
    return p >> 36, p >> 18 & LONGEST, p & LONGEST


def window_rows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, place) of all windows of texts given as word hashes, by hash function and side of the anchor."""
    free = np.zeros(SHINGLE, _U)  # tokens across two texts belong to none
    tokens = shingles(np.concatenate([x for words in texts for x in (free, words)] + [free]))
    lengths = np.array([len(words) for words in texts])
    starts = np.cumsum(lengths + SHINGLE) - lengths
    lengths = np.maximum(0, lengths - SHINGLE + 1)
    rows, keys, places = [], [], []
    for k in range(HASHES):
        left, c, right = compact_rows(np.maximum(_mixed(tokens, k), _U(1)), starts, lengths)
        row = np.searchsorted(starts, c, "right") - 1
        place = _packed(c - starts[row], c - left, right - c)
        own = _mixed(tokens[c], k + 4)
        for side, there in ((1, c + ANCHOR <= right), (-1, c - ANCHOR >= left)):
            keys.append(_mixed(own[there] * _BASE + tokens[c[there] + side * ANCHOR], 9 + side))
            places.append(place[there])
            rows.append(row[there])
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(places)


def windows(docs: DataFrame, hot=None) -> DataFrame:
    """(key, th, place, whole): th is the hash of the text; whole: the key of a row that is dealt out."""

    def work(batch):
        hots = hot.value if hot is not None else np.empty(0, np.int64)
        parts, texts, owners, seen, size = [], [], [], set(), 0

        def flush():
            row, key, place = window_rows(texts)
            parts.append((np.array(owners, np.int64)[row], key, place))
            texts.clear()
            owners.clear()

        for th, text in zip(batch.column("th").to_pylist(), batch.column("text").to_pylist()):
            if th not in seen:  # copies side by side
                seen.add(th)
                words = word_hashes(text)
                if len(words) >= WORDS:
                    texts.append(words)
                    owners.append(th)
                    size += len(words)
            if size > TOGETHER:
                flush()
                size = 0
        if texts:
            flush()
        th, key, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3
        is_hot = np.zeros(len(key), bool)
        if len(hots):  # sorted
            is_hot = hots[np.minimum(np.searchsorted(hots, key), len(hots) - 1)] == key
        dealt = np.where(is_hot, _mixed((key ^ th % SPREAD).view(_U), 3).view(np.int64), key)
        return {"key": pa.array(dealt), "th": pa.array(th), "place": pa.array(place), "whole": pa.array(key, mask=~is_hot)}

    return over_batches(docs.select("th", "text"), "key long, th long, place long, whole long", work)


def _paired(batches: Iterator[pa.RecordBatch], own: bool = False) -> Iterator[pa.RecordBatch]:
    """Sorted windows to (m, rep, key, m_place, rep_place) and, for keys dealt out, their leaders
    (no m).  Only the leaders of the key at hand are kept: at most TOKENS windows.

    own: with ``send`` (NONE, OTHER or ALL runs); keys of two windows send none, and a batch's last key counts
    as larger.  Then leaders and their texts' later windows are pairs of a text with itself."""
    current, leaders, before, told, last = None, [], 0, 0, None
    again: set[int] = set()  # leaders' texts that have further windows; those follow each other

    def overlap(p, q):
        _, a, b = _unpacked(p)
        _, a2, b2 = _unpacked(q)
        return np.minimum(a, a2) + np.minimum(b, b2) + 1

    for batch in batches:
        if own and batch.num_rows:  # windows of copies of a text are one
            row = np.stack([batch.column(c).to_numpy() for c in ("key", "th", "place")])
            new = np.concatenate([[last is None or bool((row[:, 0] != last).any())], (row[:, 1:] != row[:, :-1]).any(axis=0)])
            row = row[:, new]
            further = (row[:2] == np.column_stack([row[:2, 0] ^ 1 if last is None else last[:2], row[:2, :-1]])).all(axis=0) if row.size else None
            batch, last = batch.filter(pa.array(new)), row[:, -1] if row.size else last
        key, th, place = (batch.column(c).to_numpy() for c in ("key", "th", "place"))
        whole = batch.column("whole")
        dealt = np.asarray(whole.is_valid())
        origin = whole.fill_null(0).to_numpy()
        out = {c: [] for c in ("m", "rep", "key", "m_place", "rep_place", "send")}
        leads: list[tuple] = []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        ends = np.append(starts[1:], len(key)) if len(key) else []
        busy = [(s, e) for s, e in zip(starts, ends) if e - s > 1 or dealt[s] or key[s] == current or e == len(key)]
        for s, e in busy:
            if key[s] != current:
                current, leaders, before, told, again = key[s], [], 0, 0, set()
            rest = np.arange(s, e)
            before += e - s
            third = own and (before > 2 or bool(dealt[s]) or e == len(key))
            if third:
                again |= set(th[s:e][further[s:e]].tolist())
            for q_th, q in leaders:
                rest = _with(q_th, q, rest, key, th, place, overlap, out, third, again)
                if not len(rest):
                    break
            while len(rest):
                q_th, q = int(th[rest[0]]), int(place[rest[0]])
                leaders.append((q_th, q))
                if dealt[s]:
                    leads.append((int(origin[s]), q_th, q))
                rest = _with(q_th, q, rest[1:], key, th, place, overlap, out, third, again)
            again &= {x[0] for x in leaders}
            if third and told < len(leaders):
                q_th, q = (np.array(x, np.int64) for x in zip(*leaders[told:]))
                told = len(leaders)
                for name, value in zip(out, (q_th, q_th, np.full(len(q), key[s]), q, q, np.full(len(q), ALL))):
                    out[name].append(value)
        columns = [np.concatenate(v) if v else np.empty(0, np.int64) for v in out.values()]
        arrays = [pa.array(np.concatenate([x, y])) for x, y in zip(columns, (
            np.zeros(len(leads), np.int64), *(np.array([r[i] for r in leads], np.int64) for i in (1, 0)),
            np.zeros(len(leads), np.int64), np.array([r[2] for r in leads], np.int64), np.zeros(len(leads), np.int64)))]
        is_lead = np.concatenate([np.zeros(len(columns[0]), bool), np.ones(len(leads), bool)])
        arrays[0] = pa.array(np.concatenate([columns[0], np.zeros(len(leads), np.int64)]), mask=is_lead)
        used = len(out) if own else len(out) - 1
        yield pa.RecordBatch.from_arrays(arrays[:used], list(out)[:used])


def _with(q_th, q, rest, key, th, place, overlap, out, third, again):
    """Rows that overlap the leader enough are paired with it; the others are left."""
    met = overlap(place[rest], q) >= TOKENS
    pair = rest[met if third else met & (th[rest] != q_th)]
    if len(pair):
        send = NONE if not third else ALL if q_th in again else OTHER
        for name, value in zip(out, (th[pair], np.full(len(pair), q_th), key[pair], place[pair], np.full(len(pair), q),
                                     np.full(len(pair), send))):
            out[name].append(value)
    return rest[~met]


PAIR = "m long, rep long, key long, m_place long, rep_place long"


def pairs_of(rows: DataFrame) -> DataFrame:
    """Pairs of windows (PAIR, send); keys that were dealt out are joined through their leaders, which have
    sent all their runs."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def level(frame, own):
        return materialise(frame.repartition(n, "key").sortWithinPartitions("key", "th", "place").mapInArrow(
            partial(_paired, own=own), f"{PAIR}, send long" if own else PAIR), "window-pairs")

    found = level(rows, True)
    leaders = found.where("m is null").select("key", F.col("rep").alias("th"), F.col("rep_place").alias("place"),
                                              F.lit(None).cast("long").alias("whole"))
    found = found.where("m is not null")
    return found if leaders.isEmpty() else found.union(level(leaders, False).withColumn("send", F.lit(NONE).cast("long")))


def run_pairs(runs: DataFrame) -> DataFrame:
    """Pairs (PAIR, send) of equal runs: each with the first of its key, further ones of the first's own
    text with the last.  First and last are counted map-side, so a common run is a skewed join at most."""
    run = F.struct("th", "place")
    ends = runs.groupBy("key").agg(F.min(run).alias("a"), F.max(run).alias("z")).where("a.th <> z.th")
    mate = F.when(F.col("th") != F.col("a.th"), F.col("a")).when(F.col("place") != F.col("a.place"), F.col("z"))
    return (runs.join(ends, "key").select(F.col("th").alias("m"), mate.alias("mate"), "key", F.col("place").alias("m_place"))
            .where("mate is not null").select("m", F.col("mate.th").alias("rep"), "key", "m_place",
                                              F.col("mate.place").alias("rep_place"), F.lit(NONE).cast("long").alias("send")))


def _segments(there: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint best segments of at least TOKENS tokens with SIMILAR or more of them marked."""
    if there.all():
        return [(0, len(there))] if len(there) >= TOKENS else []
    found = []
    todo = [(0, len(there))]
    gain = np.where(there, 1 - SIMILAR, -SIMILAR)
    slack = 1e-9 * (len(there) + 1)  # sums of tenths are not exact
    while todo:
        lo, hi = todo.pop()
        if hi - lo < TOKENS:
            continue
        total = np.concatenate([[0.0], np.cumsum(gain[lo:hi])])
        low = np.minimum.accumulate(total[:len(total) - TOKENS])  # of starts at least TOKENS before an end
        best = total[TOKENS:] - low
        at = int(np.argmax(best))
        if best[at] < -slack:
            continue
        start, end = int(np.argmin(total[:at + 1])), at + TOKENS
        found.append((lo + start, lo + end))
        todo += [(lo, lo + start), (lo + end, hi)]
    return found


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of the ranges ``starts`` .. ``starts + lengths``, one after the other."""
    owner = np.repeat(np.arange(len(starts)), lengths)
    return owner, np.arange(len(owner)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _side(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows in one array, each row's first place in it and its number of tokens.  Tokens across
    two rows belong to none."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    words = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].view(WORD).astype(_U)
    at = (ends - ends[0]).astype(np.int64) // np.dtype(WORD).itemsize
    tokens = np.zeros(len(words), _U)
    cut = shingles(words)
    tokens[:len(cut)] = cut
    return tokens, at[:-1], np.maximum(0, np.diff(at) - SHINGLE + 1)


def _runs(tokens: np.ndarray) -> np.ndarray:
    """Hash of the TOKENS tokens from each place on: the sum of token k times BASE ** (k + 1)."""
    n = len(tokens)
    if n < TOKENS:
        return np.zeros(n, _U)
    up = np.cumprod(np.full(n, _RUN_BASE, _U))
    down = np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, _RUN_INVERSE, _U))])
    total = np.concatenate([[_U(0)], np.cumsum(tokens * up)])
    out = np.zeros(n, _U)
    out[:n - TOKENS + 1] = (total[TOKENS:] - total[:-TOKENS]) * down[:n - TOKENS + 1]
    return out


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about VERIFIED words and places each; a row is never cut."""
    size = sum(pc.binary_length(batch.column(c)).to_numpy() for c in ("m_words", "r_words")) // np.dtype(WORD).itemsize
    size = size + TOKENS * pc.list_value_length(batch.column("places")).to_numpy()
    part = np.cumsum(size, dtype=np.int64) // VERIFIED
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for lo, hi in zip(starts, [*starts[1:], len(part)]):
        yield batch.slice(lo, hi - lo)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (th, other, first, last) of both sides; runs (key, th, place) of windows whose key has more
    of them, but for those that the leader holds in the same place (see above)."""
    for batch in batches:
        for rows in _bounded(batch):
            th, other, first, last = _pair_segments(rows)
            key, sender, place = _sent_runs(rows)
            no_key, no_span = pa.nulls(len(th), pa.int64()), pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([th, sender])), *(pa.concat_arrays([pa.array(x), no_span]) for x in (other, first, last)),
                *(pa.concat_arrays([no_key, pa.array(x)]) for x in (key, place))],
                ["th", "other", "first", "last", "key", "place"])


def _pair_segments(rows: pa.RecordBatch) -> list[np.ndarray]:
    """(th, other, first, last) of the segments of all pairs of different texts."""
    col = {c: rows.column(c).to_numpy() for c in ("m", "rep", "m_lo", "m_hi", "r_lo", "r_hi", "m_from", "r_from")}
    sides = []
    for s in "mr":
        tokens, at, n = _side(rows.column(f"{s}_words"))
        lo = col[f"{s}_lo"] - col[f"{s}_from"]
        sides.append((tokens, at + lo, np.maximum(0, np.minimum(col[f"{s}_hi"] - col[f"{s}_from"] + 1, n) - lo)))
    (m, m_at, m_n), (r, r_at, r_n) = sides
    other = col["m"] != col["rep"]
    found: list[tuple] = []  # (row, is it the member's side, first and last token of the part)
    level = np.flatnonzero(other & (m_n == r_n) & (m_n >= TOKENS))
    owner, at = _spread(m_at[level], m_n[level])
    differs = m[at] != r[at + np.repeat(r_at[level] - m_at[level], m_n[level])]
    equal = level[np.bincount(owner[differs], minlength=len(level)) == 0]
    rest = np.setdiff1d(np.flatnonzero(other & (m_n >= TOKENS) & (r_n >= TOKENS)), equal)
    m_row, at = _spread(m_at[rest], m_n[rest])
    a = m[at] + m_row.astype(_U) * _RUN_BASE  # tokens of one row meet those of the same row only
    r_row, at = _spread(r_at[rest], r_n[rest])
    b = r[at] + r_row.astype(_U) * _RUN_BASE
    marks = [(np.isin(x, y), np.concatenate([[0], np.cumsum(n[rest])]), row)
             for x, y, n, row in ((a, b, m_n, m_row), (b, a, r_n, r_row))]
    least = int(SIMILAR * TOKENS)
    enough = np.all([np.bincount(row[there], minlength=len(rest)) >= least for there, _, row in marks], axis=0)
    for i in np.flatnonzero(enough):
        parts = [_segments(there[ends[i]:ends[i + 1]]) for there, ends, _ in marks]
        if all(parts):
            found += [(rest[i], own, s, e) for own, part in zip((True, False), parts) for s, e in part]
    row, own, start, end = (np.array(x, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
    row = np.concatenate([row, equal, equal])
    own = np.concatenate([own, np.ones(len(equal), np.int64), np.zeros(len(equal), np.int64)]).astype(bool)
    start = np.concatenate([start, np.zeros(2 * len(equal), np.int64)])
    end = np.concatenate([end, m_n[equal], m_n[equal]])
    base = np.where(own, col["m_lo"][row], col["r_lo"][row])
    return [np.where(own, col["m"][row], col["rep"][row]), np.where(own, col["rep"][row], col["m"][row]),
            base + start, base + end + SHINGLE - 1]


def _sent_runs(rows: pa.RecordBatch) -> list[np.ndarray]:
    """(key, th, place) of the runs that the windows of all pairs send."""
    lists = rows.column("places")
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
    flat = lists.flatten()
    own, mate, send = (flat.field(c).to_numpy() for c in ("m_place", "rep_place", "send"))
    sends = send != NONE
    if not sends.any():
        return [np.empty(0, np.int64)] * 3
    row, own, mate, send = row[sends], own[sends], mate[sends], send[sends]
    m_from, r_from, m_th = (rows.column(c).to_numpy() for c in ("m_from", "r_from", "m"))
    m, m_at, m_n = _side(rows.column("m_words"))
    r, r_at, r_n = _side(rows.column("r_words"))
    m_run, r_run = _runs(m), _runs(r)
    c, left, right = _unpacked(own)
    c = c - m_from[row]
    first = np.maximum(0, np.maximum(c - left, c - TOKENS + 1))
    last = np.minimum(m_n[row] - 1, np.minimum(c + right, c + TOKENS - 1))
    window, start = _spread(first, np.maximum(0, last - TOKENS + 2 - first))
    at = row[window]
    there = start + ((mate >> 36) - r_from[row] - c)[window]  # the same place in the leader's text
    inside = (send[window] == OTHER) & (m_th != rows.column("rep").to_numpy())[at] & (there >= 0) & (there + TOKENS <= r_n[at])
    held = np.zeros(len(start), bool)
    held[inside] = m_run[m_at[at[inside]] + start[inside]] == r_run[r_at[at[inside]] + there[inside]]
    wanted = np.zeros(len(m), bool)
    wanted[(m_at[at] + start)[~held]] = True
    places = np.flatnonzero(wanted)
    at = np.searchsorted(m_at, places, "right") - 1
    return [m_run[places].view(np.int64), m_th[at], _packed(m_from[at] + places - m_at[at], 0, TOKENS - 1)]


def _grouped(pairs: DataFrame, enough: int) -> DataFrame:
    """One row per pair of texts: the token ranges that its windows have in common, and the places."""
    def part(name, shift, mask=LONGEST):
        return F.shiftright(name, shift).bitwiseAND(mask)
    a = F.least(part("m_place", 18), part("rep_place", 18))
    b = F.least(part("m_place", 0), part("rep_place", 0))
    c, q, near = F.shiftright("m_place", 36), F.shiftright("rep_place", 36), F.lit(TOKENS - 1)
    return (pairs.groupBy("m", "rep").agg(
        F.min(c - a).alias("m_lo"), F.max(c + b).alias("m_hi"), F.min(q - a).alias("r_lo"), F.max(q + b).alias("r_hi"),
        F.min(c - F.least(part("m_place", 18), near)).alias("own_lo"), F.max(c + F.least(part("m_place", 0), near)).alias("own_hi"),
        F.collect_set(F.struct("key", "m_place", "rep_place", "send")).alias("places"))
        .where((F.size("places") >= enough) | (F.col("m") == F.col("rep"))))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", enough: int = 1) -> DataFrame:
    """doc_id, class_id (smallest key reachable through shared passages), n_links (texts it was found
    with), n_copies (other documents with the same text), spans (first, last + 1 word), n_words in them."""
    spark = docs.sparkSession
    plain = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where(
        F.length("text") >= 2 * WORDS - 1)  # shorter texts cannot hold WORDS words
    ids = materialise(plain.select("id", "th").distinct(), "passage-ids")
    contents = materialise(ids.groupBy("th").agg(F.min("id").alias("first"), F.count("*").alias("n")), "passage-texts")
    share = min(1.0, SAMPLE / max(1, contents.count()))
    sample = plain.where(F.shiftrightunsigned(F.xxhash64("th", F.lit(5)), 11) / float(1 << 53) < share)
    common = (windows(sample).select("key", "th").distinct().groupBy("key").count()
              .where(F.col("count") >= COMMON).select("key").collect())  # at most SAMPLE * windows / COMMON
    hot = spark.sparkContext.broadcast(np.array(sorted(r.key for r in common), np.int64))
    batch_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch_rows)
    first = materialise(_grouped(pairs_of(windows(plain, hot)), enough), "passage-pairs")
    extract = materialise(_extracts(plain, first, contents), "passage-words")
    checked = _checked(first, extract)
    spark.conf.set(batch_rows, str(ROW_BATCH))  # small fixed rows
    try:
        runs = checked.where("key is not null").select("key", "th", "place").distinct()
        second = materialise(_grouped(run_pairs(runs), 1), "passage-pairs")
    finally:
        spark.conf.set(batch_rows, usual)
    segments = checked.union(_checked(second, extract)).where("key is null").select("th", "other", "first", "last")
    return _by_document(plain, ids, contents, segments, key)


def _checked(pairs: DataFrame, extract: DataFrame) -> DataFrame:
    side = {s: extract.select(F.col("th").alias(s), F.col("start").alias(f"{s[0]}_from"), F.col("words").alias(f"{s[0]}_words"))
            for s in ("m", "rep")}
    return materialise(pairs.join(side["m"], "m").join(side["rep"], "rep").mapInArrow(
        _verify, "th long, other long, first long, last long, key long, place long"), "passage-checked")


def _extracts(plain: DataFrame, pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """(th, start, words): 32-bit word hashes of the part of each text that its pairs name."""
    need = (pairs.select(F.col("m").alias("th"), F.least("m_lo", "own_lo").alias("lo"), F.greatest("m_hi", "own_hi").alias("hi"))
            .union(pairs.select("rep", "r_lo", "r_hi")).groupBy("th").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .join(contents.select("th", F.col("first").alias("of")), "th"))
    # one document stands for all copies, so a text with many copies is no hot key here
    texts = plain.select(F.col("th").alias("t"), "id", "text").join(
        need, (F.col("t") == F.col("th")) & F.col("id").eqNullSafe(F.col("of")))

    def work(batch):
        cut = [word_hashes(t)[lo:hi + SHINGLE].astype(WORD).tobytes() for t, lo, hi in zip(
            *(batch.column(c).to_pylist() for c in ("text", "lo", "hi")))]
        return {"th": batch.column("th"), "start": batch.column("lo"), "words": cut}

    parts = over_batches(texts.select("th", "lo", "hi", "text"), "th long, start long, words binary", work)
    return parts.groupBy("th").agg(F.min("start").alias("start"), F.min("words").alias("words"))  # equal rows


def _by_document(plain, ids, contents, segments, key):
    segments = materialise(segments, "passage-segments")
    spans = (segments.groupBy("th", "first").agg(F.max("last").alias("last"))  # at most one per word of the text
             .groupBy("th").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("parts")))
    merge = """aggregate(parts, cast(array() as array<struct<first: bigint, last: bigint>>), (done, x) -> if(
        size(done) > 0 and x.first <= element_at(done, -1).last,
        concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).first as first,
               greatest(element_at(done, -1).last, x.last) as last))),
        concat(done, array(x))))"""
    spans = spans.select("th", F.expr(merge).alias("spans"))
    links = (
        segments.select("th", "other").distinct().groupBy("th").agg(F.count("*").alias("n_links")))
    # texts that several documents hold repeat as a whole
    copies = contents.where("n > 1").select("th", "first").join(
        plain.select("th", "id", "text"), "th").where(F.col("id").eqNullSafe(F.col("first")))
    copied = over_batches(copies.select("th", "text"), "th long, words long", lambda b: {
        "th": b.column("th"), "words": [len(t.encode("utf-8", "surrogatepass").split()) for t in b.column("text").to_pylist()]})
    copied = copied.where(F.col("words") >= WORDS).groupBy("th").agg(F.max("words").alias("words"))
    roots = components(segments.select(F.col("th").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("th"), "root")
    known = (contents.join(spans, "th", "left").join(links, "th", "left").join(copied, "th", "left").join(roots, "th", "left")
             .where("spans is not null or words is not null").withColumn("root", F.coalesce("root", "th")))
    known = materialise(known, "passage-known")
    named = known.groupBy("root").agg(F.min("first").alias("class_id"))
    known = known.join(named, "root").select(
        "th", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"),
        F.when(F.col("words").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("words").alias("last"))))
        .otherwise(F.col("spans")).alias("spans"))
    return ids.join(known, "th").select(
        F.col("id").alias(key), "class_id", "n_links", "n_copies", "spans",
        F.expr("aggregate(spans, 0L, (n, x) -> n + x.last - x.first)").alias("n_words"))
