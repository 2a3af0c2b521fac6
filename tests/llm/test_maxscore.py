import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fareloom.llm import maxscore as M

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, query int, terms string"


def words_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most=50):
    counted = [(i, Counter(words_of(t))) for i, t, *_ in docs]
    sizes = [sum(c.values()) for _, c in counted]
    documents, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        held = set(words_of(text))
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in held}
        scored = []
        for (i, c), n in zip(counted, sizes):
            m = 100 - 50 + (50 * n * documents) // max(1, total)
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in held if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:most])]
    return out


def made(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.8))}" for _ in range(500)] + ["Über", "naïve", "X9", "İi"]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 5, 40, 200]))), 1, "x") for i in range(700)]
    docs += [(900, None, 1, "x"), (901, "", 1, "x"), (902, "-- !", 1, "x"), (None, "w1 w2 w3 w1", 1, "x"), (5, docs[5][1], 1, "x"),
             (903, "w1 " * 30_000 + "w7", 1, "x")] + [(1000 + i, "w1 w2 w9 w4 w8", 1, "x") for i in range(120)]
    items = [(f"q{i}", " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 40)))) for i in range(30)]
    items += [("none", None), ("odd", "??"), ("unknown", "zzz"), ("q0", items[0][1]), (None, "w2 W3")]
    return docs, items


@pytest.mark.parametrize("block_docs, query_terms", [(4096, 100_000), (37, 20)])
def test_ranks_equal_brute_force(spark, block_docs, query_terms):
    docs, items = made(block_docs)
    got = M.search_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id string, text string"),
                         query_terms=query_terms, block_docs=block_docs).collect()
    want = brute(docs, items)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pair_bounds_skip_and_hold():
    docs, items = made(3)
    made_block = M._block(0, [d[0] for d in docs], [M.terms_of(d[1]) for d in docs])
    average = made_block["docs"], made_block["total"]
    row = {k: np.asarray(v) for k, v in made_block.items() if k != "terms"}
    df = Counter(t for d in docs for t in set(words_of(d[1])))
    queries = M.Queries([set(M.terms_of(t)) for _, t in items], df, average[0])
    import pyarrow as pa
    block = M.Block(M._chosen(row, queries.places_in(pa.array(made_block["terms"]))), average)
    most, joint = M.pair_bounds(block, queries)
    tighter = 0
    for q in range(len(items)):
        ceiling = M.unit_bounds(queries, q, most, joint)
        places, scores = M.search_block(block, queries, q, ceiling, 0)
        if not len(places):
            continue
        assert scores.max() <= ceiling.sum() <= sum(most[t] for u in queries.units[q] for t in u)
        tighter += ceiling.sum() < sum(most[t] for u in queries.units[q] for t in u)
        need = int(np.sort(scores)[-min(50, len(scores))])
        some, their = M.search_block(block, queries, q, ceiling, need)
        assert dict(zip(some, their)) == {p: s for p, s in zip(places, scores) if s >= need}
        assert not len(M.search_block(block, queries, q, ceiling, int(ceiling.sum()) + 1)[0])
    assert tighter > 10


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert M.search_items(docs, items).count() == 0
    assert M.search_items(spark.createDataFrame([(1, "w1", 1, "x")], DOCS), items.limit(0)).count() == 0


def test_every_block_has_a_row_group_of_its_own(spark, monkeypatch):
    """Else a reader holds all blocks of a file in memory at once, which grows with the input."""
    import pyarrow.parquet as pq
    docs, items = made(5)
    files, write = [], M.materialise

    def kept(*args, **options):
        written = write(*args, **options)
        files.extend(written.inputFiles())
        return written
    monkeypatch.setattr(M, "materialise", kept)
    M.search_items(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, "item_id string, text string"),
                   block_docs=100).count()
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert max(m.num_rows for m in found) > 1
    assert all(m.num_row_groups == m.num_rows for m in found)
