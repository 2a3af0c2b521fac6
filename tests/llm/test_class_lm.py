import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from fareloom.llm import class_lm as L


def toks(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def corpus(spark, n=260):
    rng = random.Random(4)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(12)]
    texts = [None, "", " \n", "É\x85X Zz zz", "only-once-here", "a b " * 20_000]
    texts += [" ".join(rng.choice(verbs if k % 2 else nouns) if rng.random() < .9 else f"u{rng.randrange(900)}"
                       for k in range(rng.randint(1, 60))) for _ in range(n)]
    texts += texts[3:5]
    rows = [(None if i == 9 else i, t, 1, "x") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_known int, word string")


def test_base_score_matches_brute_force(spark):
    rows, docs = corpus(spark)
    for frequent in (10**6, 5):
        got = {r.doc_id: r for r in L.score(docs, frequent=frequent).collect()}
        out = {d: d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
        c = Counter(w for d, t, *_ in rows if not out[d] for w in toks(t))
        n, v = sum(c.values()), len(c)
        assert len(got) == len(rows)
        for d, t, *_ in rows:
            words, r = toks(t), got[d]
            assert (r.held_out, r.n_tokens, r.train_tokens) == (out[d], len(words), n)
            assert r.n_known == sum(c[w] > 0 for w in words)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
            assert r.score < 0 and r.perplexity > 1
    held = [r for r in got.values() if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_probabilities_add_up(spark):
    """All words after a class, and one unseen word in each class, share a probability of one."""
    pairs = np.array([[0, 5, 1], [4, 0, 2], [2, 3, 0.]])
    cls = L.exchange(pairs, 2)
    big = np.zeros((2, 2))
    np.add.at(big, (cls[:, None].repeat(3, 1), cls[None, :].repeat(3, 0)), pairs)
    step = (big + 1) / (big.sum(1, keepdims=True) + 2)
    assert np.allclose(step.sum(1), 1)


def test_exchange_finds_the_planted_classes():
    rng = np.random.default_rng(0)
    pairs = np.zeros((40, 40))
    for u in range(40):
        for v in range(40):
            pairs[u, v] = rng.poisson(40 if v % 4 == (u + 1) % 4 else 1)
    cls = L.exchange(pairs, 4)
    assert all(len({cls[u] for u in range(k, 40, 4)}) == 1 for k in range(4)) and len(set(cls)) == 4

    def likelihood(c):
        one = np.eye(4)[c]
        big = one.T @ pairs @ one
        return L._xlogx(big).sum() - L._xlogx(big.sum(0)).sum() - L._xlogx(big.sum(1)).sum()
    assert likelihood(cls) > likelihood(np.arange(40) // 10)


def test_no_rows_and_no_training_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = L.score(docs).collect()
    assert [r.n_known for r in got] == [0, 0] and {r.train_tokens for r in got} == {0}
    assert L.score(docs.limit(0)).count() == 0


def test_every_training_word_gets_a_class_from_its_neighbours(spark):
    """Two kinds of words take turns; all rare words share one ending, and they are more than have units of their own."""
    rng = random.Random(7)
    known, rare = [[[f"{k}{i}{end}" for i in range(n)] for k in "ab"] for n, end in ((12, ""), (700, "xx"))]
    texts = [" ".join(rng.choice(known[k % 2] if rng.random() < .6 else rare[k % 2]) for k in range(40)) for _ in range(1000)]
    pick = [[rng.choice(rare[k % 2]) for k in range(40)] for _ in range(20)]
    for words in pick:  # the same words, in turns and kind by kind
        texts += [" ".join(words), " ".join(words[::2] + words[1::2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frequent in (10**6, 20):
        got = {r.doc_id: r for r in L.score(docs, frequent=frequent).collect()}
        gains = []
        for i in range(1000, 1040, 2):
            assert math.isclose(got[i].base_score, got[i + 1].base_score)
            gains.append(got[i].score - got[i + 1].score)
        assert sum(gains) / len(gains) > 3 and sum(g > 0 for g in gains) >= 18


def test_score_matches_brute_force(spark, monkeypatch):
    """A class bigram from the classes that each word got, with one added."""
    rows, docs = corpus(spark)
    seen, whole = {}, L.classed_rows

    def keep(coded, learned, model, kind):
        seen["rare"], seen["common"] = {r.word: r.cls for r in learned.collect()}, model.value
        return whole(coded, learned, model, kind)
    monkeypatch.setattr(L, "classed_rows", keep)
    for frequent in (10**6, 100):
        got = L.score(docs, frequent=frequent).collect()
        out = {d: d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
        c = Counter(w or "\n" for d, t, *_ in rows if not out[d] for w in toks(t))
        common, _, unseen = seen["common"]
        top = sorted(c, key=lambda w: (-c[w], w))[:len(common)]
        assert set(seen["rare"]) == set(c) - set(top)
        cls = {**dict(zip(top, common.tolist())), **seen["rare"]}
        n = L.class_number(len(c))
        big, amount = np.ones((n, n)), np.ones(n)
        for w, times in c.items():
            amount[cls[w]] += times + 1
        for d, t, *_ in rows:
            words = ["\n", *(w or "\n" for w in toks(t))]
            if not out[d]:
                for a, b in zip(words, words[1:]):
                    big[cls[a], cls[b]] += 1

        def kind(w):
            return cls[w] if w in cls else unseen[L.rare_unit(w[-2:])]

        want = []
        for d, t, *_ in rows:
            words = ["\n", *(w or "\n" for w in toks(t))]
            want.append(sum(math.log10(big[kind(a), kind(b)] / big[kind(a)].sum()) + math.log10((c[b] + 1) / amount[kind(b)])
                            for a, b in zip(words, words[1:])))
        assert np.allclose(sorted(r.score for r in got), sorted(want))


def test_words_move_to_the_class_that_their_neighbours_fit():
    rng = np.random.default_rng(3)
    text = [int(rng.integers(0, 12)) * 5 + (k + int(rng.random() < .2)) % 5 for k in range(6000)]
    cls = np.arange(60) % 5
    cls[::4] = rng.integers(0, 5, 15)  # a fourth of the words begin anywhere; class 5 is empty
    of_text, before = cls[text], np.roll(text, 1)
    big = np.zeros((6, 6))
    np.add.at(big, (cls[before], of_text), 1)

    def fit(u, b):
        others = [(cls[v], cls[w]) for v, w in zip(before, text) if not (cls[u] == b and u in (v, w))]
        left, right = Counter(v for v, w in others if w == b), Counter(w for v, w in others if v == b)
        if cls[u] == b:  # pairs with u on the other side stay
            left.update(cls[v] for v, w in zip(before, text) if v == u != w and cls[w] == b)
            right.update(cls[w] for v, w in zip(before, text) if w == u != v and cls[v] == b)
        near = [(left, cls[v]) for v, w in zip(before, text) if w == u] + [(right, cls[w]) for v, w in zip(before, text) if v == u]
        return sum(math.log((side[c] + 1) / (sum(side.values()) + 6)) for side, c in near)

    rows = np.zeros((60, 12), int)
    np.add.at(rows, (text, cls[before]), 1)
    np.add.at(rows, (before, 6 + of_text), 1)
    words, at = np.nonzero(rows)
    new = L.Fit(big).best(words, at, rows[words, at], cls, np.bincount(text, minlength=60))
    assert new.tolist() == [int(np.argmax([fit(u, b) for b in range(6)])) for u in range(60)]
    assert new.tolist() == (np.arange(60) % 5).tolist()


def test_classes_grow_with_the_vocabulary():
    assert [L.class_number(v) for v in (0, 1000, 10**6, 10**9)] == [40, 40, 100, 1000]
