import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from fareloom.llm import simhash as S
from fareloom.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_golay_code_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    index = S.decode(words)
    code = index << 11 | S._HIGH[index]
    assert np.bitwise_count(code ^ words).max() <= 3
    assert len(set(S._ERROR.tolist())) == 2048


def test_any_four_changes_share_a_key():
    rng = random.Random(5)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        two = np.array([x, y], np.uint64).view(np.int64)
        row, key = S.fuzzy_keys(two)
        assert set(key[row == 0]) & set(key[row == 1])


def test_rows_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \t", "one", "A b C", "É b c d e", "long text here now " * 9000]
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 300))]
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "X"
            texts.append(" ".join(copy).upper() if rng.random() < .3 else "\n".join(copy))
    texts += texts[5:12]
    docs = spark.createDataFrame([(i + 3, t, 1, 2) for i, t in enumerate(texts)],
                                 "doc_id long, text string, fp long, component_id int")
    got = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i + 3].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i + 3].component_id for i in range(len(texts))] == [r + 3 for r in brute_components(prints)]
    assert S.near_duplicates(docs.limit(0)).count() == 0
    null = docs.withColumn("doc_id", F.when(F.col("doc_id") > 6, F.col("doc_id")))
    assert S.near_duplicates(null).where("component_id is null").count() == 3 + 1


def test_large_buckets_are_exact(spark, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    ball = {base}
    while len(ball) < 150:  # clusters a few changes apart, and strangers
        y = rng.choice(list(ball))
        for b in rng.sample(range(64), rng.randint(1, 5)):
            y ^= 1 << b
        ball.add(y)
    prints = sorted(ball | {rng.getrandbits(64) for _ in range(30)})
    signed = np.array(prints, np.uint64).view(np.int64)
    row, key = S.fuzzy_keys(signed)
    order = np.lexsort((signed[row], key))
    keys, values = key[order], signed[row][order]
    for chunk in (2, 3, 7, 1024):
        monkeypatch.setattr(S, "CHUNK", chunk)
        for step in (1, 5, 100_000):
            batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + step]), pa.array(values[i:i + step])], ["key", "fp"])
                       for i in range(0, min(len(keys), 4000 if step == 1 else len(keys)), step)]
            seen = [b for b in S._links_of_sorted(iter(batches))]
            large = sum(b.num_rows - b.column("key").null_count for b in seen)
            n = sum(b.num_rows for b in batches)
            size = np.unique(keys[:n], return_counts=True)[1]
            assert large == size[size > chunk].sum(), (chunk, step)
    root = brute_components(prints)
    monkeypatch.setattr(S, "CHUNK", 1024)
    frame = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    got = {r.node: r.root for r in components(S.links(frame)).collect()}
    same = {}
    for i, v in enumerate(signed.tolist()):
        assert same.setdefault(root[i], got.get(v, v)) == got.get(v, v)
    assert len(same) == len(set(same.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
                                  + [(None, 4), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}}
