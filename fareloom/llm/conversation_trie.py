"""Prefix trie of conversations in double arrays, one pair of arrays per prefix shard.

Once turns are numbered they are two 64-bit hashes of (role, text) and a number of words; from there on
no text moves.
Equal sequences are counted once (their number, their smallest key).  The distinct sequences are put
in order and cut into ranges of about equal size, so a shard holds neighbouring prefixes, however
common a prefix is; only nodes on the path of a shard's first or last sequence can lie in two shards.

A shard packs its sequences into BASE and CHECK over turn numbers that are dense inside the shard
(the child of node s by turn t is slot BASE[s] + t, if CHECK there names s), walks all sequences
through the arrays, and sums per slot: members, smallest key, children, leaves and saved words of the
subtree.  Nodes off the two border paths are finished there.  Border nodes, few per shard, are
merged over all shards by their path hashes, and their subtrees are summed along their ancestors.

A conversation of more than ``SEGMENT`` turns is cut into segments: each is a sequence of its own
below the hash of all turns before it, so no row holds more than that many turns.  Segments are
worked on from the deepest level up, the totals of a level entering the sequences above it.

The ids of the conversations that end at a node are joined to text per block of ``ID_BLOCK`` ids and
then hashed as a stream in order, so a node with very many ends needs no more memory than others.

Defined results: rows without a key are no conversation; null turns come first; null role or text is
empty; rows of one key with equal turns are ordered by role, then text, and equal rows are turns of
their own; a conversation without rows left belongs to the root; an empty table has no nodes; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise

SEGMENT = 512
SHARD_TURNS = 400_000  #: turns a shard holds, about; also the rows of distinct sequences it may hold
ID_BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64
_NODE = ("ra long, rb long, ka long, kb long, pa long, pb long, depth int, border boolean, parent_border boolean, "
         "conv long, parent long, n long, words long, children long, leaves long, saved long, above array<struct<ka:long,kb:long>>, "
         "ea long, eb long")


# ---------------------------------------------------------------- double array of one shard

def _first_fit(free: np.ndarray, codes: np.ndarray, start: int) -> int:
    """Smallest base from ``start`` - codes[0] on at which the slots of all (sorted) codes are free."""
    reach = len(free) - int(codes[-1] - codes[0]) - 1
    block = 4096
    at = start
    while at <= reach:
        slots = at + np.flatnonzero(free[at:min(at + block, reach + 1)])
        for code in codes[1:]:
            if not len(slots):
                break
            slots = slots[free[slots + (code - codes[0])]]
        if len(slots):
            return int(slots[0] - codes[0])
        at += block
        block *= 2
    return max(start, len(free)) - int(codes[0])


class DoubleArray:
    """BASE and CHECK over sequences of dense turn numbers; slot 0 is the root."""

    def __init__(self):
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.free = np.ones(1024, bool)
        self.free[0] = False
        self.hint = 1  # no free slot lies below

    def _reach(self, slot: int) -> None:
        if slot >= len(self.base):
            more = max(slot + 1, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.free = np.concatenate([self.free, np.ones(more, bool)])

    def add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Slots of new children, given as distinct (parent, code) in order; parents have no other children."""
        slots = np.empty(len(parents), np.int64)
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        ends = np.r_[starts[1:], len(parents)]
        several = ends - starts > 1
        for lo, hi in zip(starts[several], ends[several]):
            wanted = codes[lo:hi]
            base = _first_fit(self.free, wanted, self.hint)
            self._reach(base + int(wanted[-1]))
            slots[lo:hi] = base + wanted
            self.free[slots[lo:hi]] = False
            self.base[parents[lo]] = base
        alone = starts[~several]  # an only child fits any free slot
        if len(alone):
            open_slots = self.hint + np.flatnonzero(self.free[self.hint:])
            if len(open_slots) < len(alone):
                self._reach(len(self.base) + len(alone))
                open_slots = self.hint + np.flatnonzero(self.free[self.hint:])
            slots[alone] = open_slots[:len(alone)]
            self.free[slots[alone]] = False
            self.base[parents[alone]] = slots[alone] - codes[alone]
        self.check[slots] = parents
        rest = np.flatnonzero(self.free[self.hint:])
        self.hint += int(rest[0]) if len(rest) else len(self.free) - self.hint
        return slots

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of ``states`` by ``codes``; -1 where there is none."""
        slots = self.base[states] + codes
        inside = (slots >= 0) & (slots < len(self.check))
        found = inside.copy()
        found[inside] = self.check[slots[inside]] == states[inside]
        return np.where(found, slots, -1)


def build(codes: np.ndarray, offsets: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The trie over the sequences codes[offsets[i]:offsets[i + 1]], and the turn numbers as stored.

    Turn numbers are dealt level by level in the order in which they are met, so that children that
    occur here only stand side by side and the arrays stay dense.
    """
    trie = DoubleArray()
    lengths = np.diff(offsets)
    number = np.full(int(codes.max()) + 1 if len(codes) else 0, -1, np.int64)
    states, dealt = np.zeros(len(lengths), np.int64), 0
    for depth in range(int(lengths.max()) if len(lengths) else 0):
        active = np.flatnonzero(lengths > depth)
        here = codes[offsets[active] + depth]
        order = np.lexsort((here, states[active]))
        new = here[order][number[here[order]] < 0]
        met = new[np.sort(np.unique(new, return_index=True)[1])]
        number[met] = dealt + np.arange(len(met))
        dealt += len(met)
        pairs = np.stack([states[active], number[here]], 1)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        ranked = pairs[order]
        first = np.r_[True, (ranked[1:] != ranked[:-1]).any(1)]
        slots = trie.add(ranked[first, 0], ranked[first, 1])
        states[active[order]] = slots[np.cumsum(first) - 1]
    return trie, number[codes] if len(codes) else codes


def walk(trie: DoubleArray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The slot after every turn of every sequence, read from BASE and CHECK only."""
    lengths = np.diff(offsets)
    out = np.empty(len(codes), np.int64)
    states = np.zeros(len(lengths), np.int64)
    for depth in range(int(lengths.max()) if len(lengths) else 0):
        active = np.flatnonzero(lengths > depth)
        states[active] = trie.step(states[active], codes[offsets[active] + depth])
        out[offsets[active] + depth] = states[active]
    return out


def _mixed(h: np.ndarray, value: np.ndarray, odd: int) -> np.ndarray:
    h = (h * _U(odd)) ^ value
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _numbers(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers of distinct rows."""
    order = np.lexsort(columns)
    change = np.zeros(len(order), bool)
    for c in columns:
        ranked = c[order]
        change[1:] |= ranked[1:] != ranked[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(change)
    return out


def shard_nodes(rows: pa.Table) -> dict | None:
    """All nodes of the ordered sequences in ``rows``, see ``_NODE``."""
    if not rows.num_rows:
        return None

    def column(name):
        return rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)

    turns = rows.column("turns").combine_chunks()
    size = np.diff(turns.offsets.to_numpy())
    flat = turns.flatten()
    a, b = (flat.field(i).to_numpy(zero_copy_only=False).view(_U) for i in (0, 1))
    w = flat.field(2).to_numpy(zero_copy_only=False).astype(np.int64)
    ra, rb = column("ra").view(_U), column("rb").view(_U)
    # the root of a segment stands before its turns, as a symbol of its own
    offsets = np.r_[0, np.cumsum(size + 1)]
    roots = offsets[:-1]
    is_turn = np.ones(offsets[-1], bool)
    is_turn[roots] = False
    full = [np.empty(offsets[-1], _U) for _ in range(2)]
    for whole, at_root, at_turn in zip(full, (ra, rb), (a, b)):
        whole[roots], whole[is_turn] = at_root, at_turn
    words = np.zeros(offsets[-1], np.int64)
    words[is_turn] = w
    trie, codes = build(_numbers(full[0], full[1], is_turn.astype(_U)), offsets)
    slots = walk(trie, codes, offsets)

    node_of, first_at = np.unique(slots, return_index=True)
    at = np.searchsorted(node_of, slots)  # node number of every place
    row_of = np.repeat(np.arange(len(size)), size + 1)
    depth = (np.arange(len(slots)) - offsets[row_of])[first_at]
    parent = np.searchsorted(node_of, trie.check[node_of])
    parent[depth == 0] = -1
    last = at[offsets[1:] - 1]
    n, conv = np.zeros(len(node_of), np.int64), np.full(len(node_of), np.iinfo(np.int64).max)
    np.add.at(n, at, column("n")[row_of])
    np.minimum.at(conv, at, column("conv")[row_of])
    children, leaves, saved = (np.zeros(len(node_of), np.int64) for _ in range(3))
    below = rows.column("below_children").combine_chunks()
    known = np.asarray(below.is_valid())
    for total, name in ((children, "below_children"), (leaves, "below_leaves"), (saved, "below_saved")):
        np.add.at(total, last[known], column(name)[known].astype(np.int64))
    border = np.zeros(len(node_of), bool)
    for row in (0, len(size) - 1):
        border[at[offsets[row]:offsets[row + 1]]] = True
    key = [np.zeros(len(node_of), _U) for _ in range(2)]
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    for level in levels:
        up = parent[level]
        for k, (own, odd) in enumerate(((full[0], 0x9E3779B97F4A7C15), (full[1], 0xC2B2AE3D27D4EB4F))):
            before = np.where(up >= 0, key[k][up], _U(k + 1))
            key[k][level] = _mixed(before, own[first_at[level]], odd)
    np.add.at(children, parent[(depth > 0) & ~border], 1)  # border children are counted after the merge
    word_of = words[first_at]
    inner = ~border
    for level in levels[::-1]:
        level = level[inner[level]]
        leaves[level] += children[level] == 0
        saved[level] += (n[level] - 1) * word_of[level]
        level = level[depth[level] > 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    has_parent = parent >= 0
    up = np.where(has_parent, parent, 0)
    above: list = [None] * len(node_of)
    ka, kb = key[0].view(np.int64), key[1].view(np.int64)
    for level in levels:
        for i in level[border[level]]:
            mine = {"ka": int(ka[i]), "kb": int(kb[i])}
            above[i] = [*(above[parent[i]] if parent[i] >= 0 else []), mine]
    end = [np.zeros(len(node_of), np.int64) for _ in range(2)]
    ends = np.zeros(len(node_of), bool)
    ends[last] = True
    for e, name in zip(end, ("ea", "eb")):
        e[last] = column(name)
    return {
        "ra": ra[row_of[first_at]].view(np.int64), "rb": rb[row_of[first_at]].view(np.int64), "ka": ka, "kb": kb,
        "pa": pa.array(ka[up], mask=~has_parent), "pb": pa.array(kb[up], mask=~has_parent), "depth": depth.astype(np.int32),
        "border": border, "parent_border": has_parent & border[up], "conv": conv,
        "parent": pa.array(conv[up], mask=~has_parent), "n": n, "words": word_of, "children": children, "leaves": leaves,
        "saved": saved, "above": above, "ea": pa.array(end[0], mask=~ends), "eb": pa.array(end[1], mask=~ends)}


def shards(rows: DataFrame, number: int) -> DataFrame:
    """The nodes of every shard of ``rows`` (ra, rb, turns and their sums)."""
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], _NODE).schema)

    def run(batches):
        held = list(batches)
        nodes = shard_nodes(pa.Table.from_batches(held)) if held else None
        if nodes:
            table = pa.table([c if isinstance(c := nodes[f.name], pa.Array) else pa.array(c, f.type) for f in arrow],
                             schema=arrow)
            yield from table.to_batches(max_chunksize=10_000)

    order = ["ra", "rb", "turns"]
    return rows.repartitionByRange(number, *order).sortWithinPartitions(*order).mapInArrow(run, _NODE)


# ---------------------------------------------------------------- conversations to sequences

def numbered(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(c, p, a, b, w): every turn's place in its conversation, from 1, its two hashes and its words."""
    plain = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("c"), F.col(turn).alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.asc_nulls_first("t"), "r", "x"))
    return plain.select("c", place.alias("p"), F.xxhash64("r", "x").alias("a"), F.xxhash64("x", F.lit("|"), "r").alias("b"),
                        F.regexp_count("x", F.lit(WORD)).alias("w"))


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(c, p, a, b, w, size): the first h turns of conversation c - c % ``group``, then c's own after its
    first h, h being crc32(c) % ``most``; a conversation without turns is one row without place."""
    h = F.crc32(F.col("c").cast("string")) % most
    host = F.col("c") - F.col("c") % group
    heads = (turns.where((F.col("p") < most) & (host == F.col("c"))).groupBy(F.col("c").alias("host"))
             .agg(F.array_sort(F.collect_list(F.struct("p", "a", "b", "w"))).alias("head")))
    convs = (turns.groupBy("c").agg(F.count("*").alias("n")).withColumns({"host": host, "h": h.cast("int")})
             .join(heads, "host", "left")
             .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<p:int,a:bigint,b:bigint,w:int>>")),
                                         F.lit(1), F.col("h")))
             .select("c", "h", "head", F.size("head").alias("m"),
                     (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("size")))
    own = (turns.where(F.col("p") > h).join(convs.select("c", "h", "m", "size"), "c")
           .select("c", (F.col("p") - F.col("h") + F.col("m")).alias("p"), "a", "b", "w", "size"))
    hosted = convs.select("c", "size", F.explode_outer("head").alias("t")).where("t is not null or size = 0")
    return own.unionByName(hosted.select("c", "t.p", "t.a", "t.b", "t.w", "size"))


def sequences(turns: DataFrame, segment: int) -> DataFrame:
    """(c, level, turns, ra, rb, na, nb, last): the segments of every conversation in ``turns`` (as from
    ``rebuilt``), the hash of all turns before (ra, rb) and up to them (na, nb)."""
    level = F.coalesce(F.floor((F.col("p") - 1) / segment), F.lit(0)).cast("long").alias("level")
    lists = turns.groupBy("c", "size", level).agg(
        F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "a", "b", "w")))).alias("placed"))
    cut = lists.select("c", "level", F.transform("placed", lambda x: F.struct(x.a.alias("a"), x.b.alias("b"), x.w.alias("w")))
                       .alias("turns"), (F.col("level") == F.greatest(F.lit(0), F.floor((F.col("size") - 1) / segment))).alias("last"))
    longest = turns.agg(F.max("size")).first()[0]
    if not longest or longest <= segment:
        zero = F.lit(0).cast("long")
        return cut.withColumns({"ra": zero, "rb": zero, "na": zero, "nb": zero})
    window = Window.partitionBy("c").orderBy("level")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    up_to = window.rowsBetween(Window.unboundedPreceding, 0)
    one, two = (F.xxhash64(F.lit(k), "level", "turns").cast("decimal(38,0)") for k in (1, 2))

    def root(frame, at, k):  # the level goes in too, so a root has one level
        return F.when(at == 0, 0).otherwise(F.xxhash64(at, F.sum(one).over(frame), F.sum(two).over(frame), F.lit(k)))

    return cut.withColumns({"ra": root(before, F.col("level"), 1), "rb": root(before, F.col("level"), 2),
                            "na": root(up_to, F.col("level") + 1, 1), "nb": root(up_to, F.col("level") + 1, 2)})


def end_digests(ends: DataFrame, block: int = ID_BLOCK) -> DataFrame:
    """(ea, eb, digest): SHA-256 of the ascending, comma-joined ids ``c`` of each (ea, eb)."""
    texts = (ends.groupBy("ea", "eb", F.floor(F.col("c") / block).alias("block"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids")))

    def digest(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch.column("ea").to_pylist(), batch.column("eb").to_pylist(), batch.column("ids").to_pylist()):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(out)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    return (texts.repartition("ea", "eb").sortWithinPartitions("ea", "eb", "block").select("ea", "eb", "ids")
            .mapInArrow(digest, "ea long, eb long, digest string"))


def _digests(rows: list) -> pa.RecordBatch:
    a, b, text = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())],
                                      ["ea", "eb", "digest"])


# ---------------------------------------------------------------- one level

_OUT = ["ra", "rb", "depth", "conv", "parent", "n", "children", "leaves", "saved", "ea", "eb"]


def finished(nodes: DataFrame) -> DataFrame:
    """``_OUT`` of all nodes of a level: those inside a shard as they are, border nodes merged over shards."""
    merged = (nodes.where("border").groupBy("ka", "kb").agg(
        *(F.min(c).alias(c) for c in ("ra", "rb", "pa", "pb", "depth", "conv", "words", "ea", "eb")),
        *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.first("above").alias("above")))
    merged = materialise(merged, "border")
    kids = merged.where("pa is not null").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("kids"))
    counted = (merged.join(kids, ["ka", "kb"], "left")
               .withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
               .withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("long"))
               .withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words")))
    sums = (counted.select(F.explode("above").alias("up"), "leaves", "saved")
            .groupBy(F.col("up.ka").alias("ka"), F.col("up.kb").alias("kb"))
            .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    named = merged.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("parent"))
    border = counted.drop("leaves", "saved").join(sums, ["ka", "kb"]).join(named, ["pa", "pb"], "left").select(*_OUT)
    below_border = nodes.where("not border and parent_border").drop("parent").join(named, ["pa", "pb"]).select(*_OUT)
    return nodes.where("not border and not parent_border").select(*_OUT).unionByName(below_border).unionByName(border)


def trie(turns: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the prefix trie of ``turns`` (as from ``rebuilt``), see the query's columns."""
    spark = turns.sparkSession
    pieces = materialise(sequences(turns, segment).withColumns({
        "ea": F.xxhash64("level", "ra", "rb", "turns"), "eb": F.xxhash64("turns", "rb", "level", "ra", F.lit(1))}), "pieces")
    distinct = materialise(
        pieces.groupBy("level", "ra", "rb", "turns").agg(
            F.count("*").alias("n"), F.min("c").alias("conv"), *(F.first(c).alias(c) for c in ("na", "nb", "ea", "eb"))), "sequences")
    size = distinct.groupBy("level").agg(F.sum(F.size("turns") + 1).alias("turns")).collect()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = {row.level: max(least, -(-row.turns // shard_turns)) for row in size}
    below, parts = None, []
    for level in sorted(number, reverse=True):
        rows = distinct.where(F.col("level") == level)
        if below is None:
            rows = rows.withColumns({f"below_{c}": F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
        else:
            rows = rows.join(below, ["na", "nb"], "left")
        nodes = finished(materialise(shards(rows.drop("level", "na", "nb"), number[level]), "nodes"))
        below = nodes.where("depth = 0").select(F.col("ra").alias("na"), F.col("rb").alias("nb"),
                                                *(F.col(c).alias(f"below_{c}") for c in ("children", "leaves", "saved")))
        if level:  # the root of a segment is a node of the level above, where its smallest key is known
            above = distinct.where(F.col("level") == level - 1).select(
                F.col("na").alias("ra"), F.col("nb").alias("rb"), F.col("conv").alias("root"))
            first = nodes.where("depth = 1").drop("parent").join(above.withColumnRenamed("root", "parent"), ["ra", "rb"])
            nodes = nodes.where("depth > 1").unionByName(first)
        parts.append(nodes.withColumn("depth", F.col("depth") + F.lit(level * segment).cast("long")))
    found = parts[0] if parts else spark.createDataFrame([], "ra long, " + ", ".join(f"{c} long" for c in _OUT[1:]))
    for part in parts[1:]:
        found = found.unionByName(part)
    digests = end_digests(pieces.where("last"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    ended = found.where("ea is not null").join(digests, ["ea", "eb"], "left").withColumn("digest", F.coalesce("digest", none))
    return (found.where("ea is null").withColumn("digest", none).unionByName(ended)
            .select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
                    F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                    F.col("saved").alias("saved_tokens"), F.col("digest").alias("ends_sha256")))


def as_they_are(turns: DataFrame) -> DataFrame:
    """Conversations without rebuilding, for ``trie``."""
    return turns.join(turns.groupBy("c").agg(F.count("*").alias("size")), "c")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations."""
    return trie(materialise(rebuilt(materialise(numbered(conversations), "turns")), "rebuilt"))
