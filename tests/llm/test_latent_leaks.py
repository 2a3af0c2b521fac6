import random
import re

import numpy as np
from pyspark.sql import functions as F

from fareloom.llm import latent_leaks as L


def words_of(text):
    return [w for w in re.split(L._SEPARATORS, (text or "").lower()) if w]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 30))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        assert L.lcs(a, b) == plain_lcs(a, b)


def corpus(spark):
    rng = random.Random(7)
    stop = ["the", "of", "and", "to", "in"]

    def prose(n):
        return [rng.choice(stop) if rng.random() < .4 else f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [prose(rng.choice([9, 14, 25, 40, 60, 90])) for _ in range(24)]
    rows, planted = [], set()
    for i in range(160):
        words = prose(rng.randint(0, 700))
        if i % 3 == 0:
            k = rng.randrange(len(items))
            copy = list(items[k])
            for _ in range(len(copy) // 12):  # a paraphrase: some words replaced
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if i % 2 else w for w in copy]
            planted.add((i, k))
        rows.append((i, " ".join(words) if i != 1 else None, "a", 2))
    return items, planted, spark.createDataFrame(rows, "doc_id long, text string, item_id string, n_words int")


def brute(rows, items):
    """Every place of every text, without retrieval."""
    found = set()
    coded = [words_of(" ".join(i)) for i in items]
    for r in rows:
        codes = words_of(r.text)
        for k, c in enumerate(coded):
            if any(L.lcs(c, codes[s:s + len(c) + len(c) // 4]) >= L.COVER * len(c)
                   for s in range(0, len(codes), 4)):
                found.add((r.doc_id, k))
    return found


def test_finds_what_brute_force_finds(spark):
    items, planted, docs = corpus(spark)
    bench = spark.createDataFrame([(k, " ".join(i), 0) for k, i in enumerate(items)] + [(90, None, 0), (91, "", 0)],
                                  "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(docs, bench).collect()}
    want = brute(docs.collect(), items)
    assert len(got & want) >= 0.95 * len(want) and len(got & planted) >= 0.9 * len(planted)
    assert not [d for d, _ in got - want if d % 3]  # clean texts stay clean


def test_answers_have_to_be_there(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j", "z"), (2, "k l m n o p q r s t", "t")],
                                  "item_id long, text string, answer string")
    docs = spark.createDataFrame([(5, "a b c d e f g h i j and then"), (6, "k l m n o p q r s t"), (None, "K, L m n! o p q r s t")],
                                 "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(docs, bench, answer="answer").collect()}
    assert got == {(6, 2), (None, 2)}
    assert L.find_leaks(docs.limit(0), bench).count() == 0 and L.find_leaks(docs, bench.limit(0)).count() == 0
    long = spark.createDataFrame([(7, "x " * 60_000 + "k l m n o p q r s t")] * 2, "doc_id long, text string")
    assert L.find_leaks(long, bench, answer="answer").count() == 2


def test_space_spans_the_leading_singular_vectors(spark):
    rng = np.random.default_rng(2)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(4)]
    texts = [" ".join(rng.choice(topics[i % 4], 64)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = L.coded(docs, "doc_id", "text")
    df, n = L.term_frequencies(coded)
    idf = L.inverse_frequencies(df, n)
    v = L.latent_space(coded, [], idf, n)
    term, row = L._flat([np.array(r.codes, np.int32) for r in coded.collect()], 64)
    a = np.zeros((200, len(idf)))
    np.add.at(a, (row, term), idf[term])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    used = np.flatnonzero(a.any(axis=0))
    exact = np.linalg.svd(a[:, used], full_matrices=False)[2][:4]
    assert np.allclose(np.linalg.norm(exact @ v[used], axis=1), 1, atol=0.02)


def test_the_space_is_fitted_on_every_passage(spark):
    """However many passages a corpus has, none is left out: the multiplication equals the one over all texts."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.4, 150) % 400) for _ in range(60)]
    coded = L.coded(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text")
    df, n = L.term_frequencies(coded)
    idf = L.inverse_frequencies(df, n)
    space = L.latent_space(coded, [], idf, 3_000_000)
    codes = [np.array(r.codes, np.int32) for r in coded.collect()]
    want = L._rows_times(*L._flat(codes, L.SCALES[-1]), idf, space.astype(float))
    block = np.random.default_rng(1).standard_normal((len(idf), 3))
    assert np.allclose(L._multiplied(coded, idf, block), L._rows_times(*L._flat(codes, L.SCALES[-1]), idf, block), atol=1e-3)
    held = np.linalg.norm(space.T @ want, axis=0)
    assert (np.linalg.norm(want, axis=0) > 0.01).all() and (held > 0.5 * np.linalg.norm(want, axis=0)).all()


def _items(rng, n, words):
    codes = [rng.integers(0, words, size).astype(np.int32) for size in rng.integers(1, 70, n)]
    idf = L.inverse_frequencies(np.arange(1 << L.BITS)[::-1], 1 << L.BITS)
    table = rng.standard_normal((1 << L.BITS, L.RANK)).astype(np.float32)
    return codes, L.Items(codes, [np.empty(0, np.int32)] * n, table, idf)


def test_a_look_at_the_rarest_words_passes_over_no_item_that_may_be_there():
    rng = np.random.default_rng(8)
    codes, items = _items(rng, 60, 90)
    found = passed = 0
    for _ in range(300):
        text = rng.integers(0, 90, int(rng.integers(1, 150))).astype(np.int32)
        there = set(text.tolist())
        want = [k for k, c in enumerate(codes) if sum(w in there for w in c.tolist()) >= L.COVER * len(c)]
        assert items.possible(L.terms(text)).tolist() == want
        found, passed = found + len(want), passed + len(codes) - len(want)
    assert found > 1000 and passed > 1000
    # only a few words of an item are looked up, so a text of its other words costs one look
    longest = max(range(len(codes)), key=lambda k: len(codes[k]))
    looked = sum(k == longest for held in items.holders.values() for k in held)
    assert len(codes[longest]) > 60 and looked <= 0.2 * len(codes[longest]) + L.RARE


def test_regions_with_too_few_shared_words_are_told_apart_at_once():
    rng = np.random.default_rng(9)
    codes, items = _items(rng, 20, 40)
    for k, c in enumerate(codes):
        text = rng.integers(0, 40, 400).astype(np.int32)
        first = rng.integers(0, 300, 50)
        last = first + rng.integers(1, 200, 50)
        bags = [(items.words[k], len(c)), (items.answers[k], sum(items.answers[k].values()))]
        want = [i for i, (a, b) in enumerate(zip(first, last))
                if all(sum(min(n, text[a:b].tolist().count(w)) for w, n in bag.items()) >= L.COVER * size for bag, size in bags)]
        assert items.within(k, text, first, last).tolist() == want


def test_passages_are_multiplied_in_bounded_blocks():
    """Texts of one word up to several blocks of passages give the product of the plain form."""
    rng = np.random.default_rng(10)
    texts = [rng.integers(-2**31, 2**31, int(n)).astype(np.int32) % 3000 for n in (1, 0, 63, 64, 65, 64 * L.MULTIPLIED, 200 * L.SCALES[-1] + 7)]
    idf = rng.random(1 << L.BITS) + 0.1
    block, total = rng.standard_normal((1 << L.BITS, 5)), np.zeros((1 << L.BITS, 5))
    L._add_passages(total, texts, idf.astype(np.float32), block.astype(np.float32))
    assert np.allclose(total, L._rows_times(*L._flat(texts, L.SCALES[-1]), idf, block), atol=1e-3)
    L._add_passages(total, [], idf, block)
