import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fareloom.llm import conversation_trie as C

SCHEMA = "conv_id long, turn int, role string, text string, conv int, depth string, n int"


def brute(rows):
    """One tuple per node, from plain lists and sets."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    return trie_of(built)


def trie_of(built):
    members, ends = {}, {}
    for c, seq in built.items():
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = set()
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids)
        text = ",".join(map(str, sorted(ends.get(node, []))))
        out.add((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids),
                 leaves[node], saved[node], hashlib.sha256(text.encode()).hexdigest()))
    return out


def made(seed, convs=150):
    rnd = random.Random(seed)
    texts = ["", None, "a b", "a", "hello  there\nyou", "  x", "tail of it"]
    rows = []
    for c in rnd.sample(range(400), convs):
        for t in range(rnd.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, rnd.choice([None, t, t, t, 1]), rnd.choice(["user", "user", None, "bot"]),
                         rnd.choice(texts[:4] if t < 2 else texts), 1, "x", 2))
    hot = [(1000 + i, t, "user", f"same {t}", 1, "x", 2) for i in range(40) for t in range(4)]
    return rows + hot + rows[:3] + [(None, 0, "user", "no conversation", 1, "x", 2)]


@pytest.mark.parametrize("segment, shard_turns", [(512, 400_000), (512, 20), (2, 15), (3, 400_000)])
def test_nodes_equal_brute_force(spark, segment, shard_turns):
    rows = made(segment)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in C.trie(C.rebuilt(C.numbered(frame)), segment, shard_turns).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want


def test_ends_are_hashed_as_a_stream_of_blocks(spark):
    ids = random.Random(1).sample(range(-500, 20_000), 9000)
    frame = spark.createDataFrame([(7, 8, i) for i in ids] + [(7, 9, 5)], "ea long, eb long, c long")
    got = {r.eb: r.digest for r in C.end_digests(frame, 1000).collect()}
    assert got == {8: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 9: hashlib.sha256(b"5").hexdigest()}


def test_without_rebuilding_and_empty(spark):
    rows = [(1, 0, "u", "x"), (1, 1, "u", "y z"), (2, 0, "u", "x"), (2, 1, "u", "y z"), (3, 0, "v", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {tuple(r) for r in C.trie(C.as_they_are(C.numbered(frame))).collect()}
    assert got == trie_of({1: (("u", "x"), ("u", "y z")), 2: (("u", "x"), ("u", "y z")), 3: (("v", "x"),)})
    assert C.rebuilt_trie(frame.limit(0)).count() == 0


def test_double_array_is_exact_and_dense():
    rnd = np.random.default_rng(5)
    sequences = [rnd.integers(0, 30, rnd.integers(0, 6)) for _ in range(800)]
    offsets = np.r_[0, np.cumsum([len(s) for s in sequences])]
    trie, codes = C.build(np.concatenate(sequences), offsets)
    slots = C.walk(trie, codes, offsets)
    seen = {}
    for i, s in enumerate(sequences):
        for d in range(len(s)):
            at = seen.setdefault(tuple(s[:d + 1]), slots[offsets[i] + d])
            assert at == slots[offsets[i] + d] > 0
    assert len(set(seen.values())) == len(seen)
    assert (~trie.free).sum() == len(seen) + 1 and max(seen.values()) < 2 * len(seen)
    assert (trie.step(np.zeros(1, np.int64), np.array([10 ** 6])) == -1).all()
