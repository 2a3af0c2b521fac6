import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fareloom.llm import compact_windows as C


def test_windows_are_those_of_the_definition():
    rng = np.random.default_rng(3)
    for n, top in ((5, 9), (40, 12), (90, 1 << 60), (200, 40)):
        h = rng.integers(0, top, n).astype(np.uint64)
        for width in (1, 4, 9):
            got = set(zip(*(x.tolist() for x in C.compact(h, width))))
            seen = {}
            for i in range(n):
                for j in range(i + width - 1, n):
                    c = i + int(np.argmin(h[i:j + 1]))
                    left, right = seen.get(c, (i, j))
                    seen[c] = (min(left, i), max(right, j))
            assert got == {(left, c, right) for c, (left, right) in seen.items() if right - left + 1 >= width}


def tokens(text):
    words = (text or "").lower().split()
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)]


def repeated(texts):
    """Documents that share a run of 46 five-word shingles with another document."""
    seen = {}
    for i, t in texts:
        s = tokens(t)
        for k in range(len(s) - 45):
            seen.setdefault(tuple(s[k:k + 46]), set()).add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}, [ids for ids in seen.values() if len(ids) > 1]


def near_copies(rows, ids):
    """Those of ``ids`` with a window of 46 shingles of which another document has four in five on one diagonal."""
    found = set()
    for i in ids:
        own = tokens(next(t for j, t in rows if j == i))
        places = {}
        for k, s in enumerate(own):
            places.setdefault(s, []).append(k)
        for j, t in rows:
            marks = {}
            for k, s in enumerate(tokens(t) if j != i else ()):
                for at in places.get(s, ()):
                    marks.setdefault(at - k, set()).add(at)
            for held in marks.values():
                if any(sum(x in held for x in range(a, a + 46)) >= 0.8 * 46 for a in held):
                    found.add(i)
    return found


def corpus(n=150):
    rng = random.Random(6)

    def prose(k):
        return [f"w{rng.randrange(5000)}" for _ in range(k)]
    passages = [prose(k) for k in (50, 51, 60, 120, 300)]
    line = prose(35)  # common, but too short to count
    rows = []
    for i in range(n):
        words = prose(rng.randint(0, 300))
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passages[i // 3 % 5] if i % 2 else [w.upper() for w in passages[i // 3 % 5]]
        if i % 2 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = line
        rows.append((i, " ".join(words)))
    core = prose(30)
    for g in range(6):  # the leader of these shares 30 words with all, others share 60 in pairs
        side = prose(30)
        rows += [(1000 + 2 * g + k, " ".join(prose(20) + core + side + prose(20))) for k in range(2)]
    rows += [(2000, " ".join(prose(49))), (2001, None), (2002, ""), (2004, rows[4][1]), (2005, " ".join(line)), (2006, " ".join(line))]
    rows += [(2000, rows[-6][1]), (7, rows[7][1])]  # equal rows
    return rows


def test_every_repeated_passage_is_found_and_clean_texts_stay(spark):
    rows = corpus()
    want, groups = repeated(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, th int, place string")
    got = C.repeats(docs).collect()
    by = {r.doc_id: r for r in got}
    # exact repeats all the way; beyond them only documents with a near copy, as told by brute force
    assert want <= set(by) and len(by) == len(got)
    assert set(by) - want <= near_copies(rows, set(by) - want)
    for ids in groups:
        assert len({by[i].class_id for i in ids}) == 1
    words = {i: (t or "").lower().split() for i, t in rows}
    for i, r in by.items():
        others = set().union(*(tokens(t) for j, t in rows if j != i))
        for s in r.spans:
            inside = tokens(" ".join(words[i][s.first:s.last]))
            assert len(inside) >= 46 and sum(x in others for x in inside) >= 0.8 * len(inside)
        assert r.n_words == sum(s.last - s.first for s in r.spans)
    assert C.repeats(docs.limit(0)).count() == 0
    null = docs.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    assert sum(r.doc_id is None for r in C.repeats(null).collect()) == 1


def test_near_copies_are_found(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for i in range(40):
        words = [f"v{rng.randrange(9000)}" for _ in range(120)]
        copy = list(words)
        copy[rng.randrange(60, 120)] = "new"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(f"u{rng.randrange(9000)}" for _ in range(80)) + " " + " ".join(copy))]
        want |= {2 * i, 2 * i + 1}
    got = {r.doc_id for r in C.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_stream_pairs_each_row_with_a_leader():
    rng = random.Random(5)
    rows = sorted((rng.randrange(40), rng.randrange(30), int(C._packed(np.int64(rng.randrange(1000)), rng.randrange(80), rng.randrange(80))))
                  for _ in range(600))
    results = []
    for step in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i:i + step]], pa.int64()) for k in range(3)]
                                              + [pa.nulls(len(rows[i:i + step]), pa.int64())], ["key", "th", "place", "whole"])
                   for i in range(0, len(rows), step)]
        results.append(sorted(tuple(r.values()) for b in C._paired(iter(batches)) for r in b.to_pylist()))
    assert results[0] == results[1] == results[2]
    for key in {r[0] for r in rows}:  # plain restatement
        leaders, want = [], []
        for k, th, p in (r for r in rows if r[0] == key):
            for lt, lp in leaders:
                if min(p >> 18 & C.LONGEST, lp >> 18 & C.LONGEST) + min(p & C.LONGEST, lp & C.LONGEST) + 1 >= C.TOKENS:
                    want += [(th, lt, k, p, lp)] if th != lt else []
                    break
            else:
                leaders.append((th, p))
        assert sorted(want) == [r for r in results[0] if r[2] == key]


def test_common_keys_are_dealt_out_and_joined_again(spark, monkeypatch):
    rows = corpus(90)
    want, groups = repeated(rows)
    monkeypatch.setattr(C, "COMMON", 3)  # read by the driver only
    got = {r.doc_id: r.class_id for r in C.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == want and all(len({got[i] for i in ids}) == 1 for ids in groups)


def linked(spark, texts):
    """Every document that shares an exact run is found, in one class with the others of the run, and its
    spans hold the run."""
    want, groups = repeated(texts)
    got = {r.doc_id: r for r in C.repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert want <= set(got)  # others are near copies
    assert all(len({got[i].class_id for i in ids}) == 1 for ids in groups)
    shared = {}
    for i, t in texts:
        s = tokens(t)
        for k in range(len(s) - 45):
            shared.setdefault(tuple(s[k:k + 46]), []).append((i, k))
    for places in shared.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                assert any(s.first <= k and k + 50 <= s.last for s in got[i].spans), (i, k)


def around(rng, *parts):
    """The parts with text of their own before, between and after them."""
    words = []
    for part in parts:
        words += [f"p{rng.randrange(10**9)}" for _ in range(rng.randint(15, 60))] + part
    return " ".join(words + [f"p{rng.randrange(10**9)}" for _ in range(30)])


def test_members_of_a_key_that_share_more_than_their_leader_are_linked(spark):
    rng = random.Random(21)
    texts = []

    def prose(k):
        return [f"t{rng.randrange(10**9)}" for _ in range(k)]
    for g in range(12):  # any of the texts may lead
        base, line, more, passage = 100 * g, prose(45), prose(20), prose(50)
        family = [around(rng, line, passage), around(rng, passage, line + more), around(rng, line + more)]
        exact = prose(80)  # one has an edited word where the two others agree
        edited = [*exact[:30], "edited", *exact[31:]]
        family += [around(rng, edited), around(rng, exact), around(rng, exact[5:])]
        first, second = prose(20), prose(20)  # one text holds the line twice, each time as another text goes on
        core = prose(40)
        family += [around(rng, core + first, core + second), around(rng, core + first), around(rng, core + second)]
        twice = prose(55)  # a run that one text repeats
        family += [around(rng, twice, twice), around(rng, twice), around(rng, twice[:48])]
        texts += [(base + i, t) for i, t in enumerate(family)]
    linked(spark, texts)


def test_random_overlaps_of_one_passage_are_linked(spark, monkeypatch):
    rng = random.Random(22)
    texts = []
    for g in range(8):
        long = [f"q{g}x{i}" for i in range(160)]
        for i in range(12):
            at = rng.randrange(100)
            part = long[at:at + rng.randint(40, 90)]
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "edited"
            texts.append((100 * g + i, around(rng, part)))
    got = {r.doc_id for r in C.repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want, groups = repeated(texts)
    assert want <= got  # others are near copies
    monkeypatch.setattr(C, "COMMON", 3)
    by = {r.doc_id: r.class_id for r in C.repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert want <= set(by) and all(len({by[i] for i in ids}) == 1 for ids in groups)


def similar_places(marks):
    """Places in any segment of 46 or more of which 0.8 or more are marked."""
    total, inside = np.concatenate([[0], np.cumsum(marks)]), np.zeros(len(marks), bool)
    for i in range(len(marks)):
        for j in range(i + 46, len(marks) + 1):
            if 10 * (total[j] - total[i]) >= 8 * (j - i):
                inside[i:j] = True
    return inside


def test_segments_are_found_wherever_one_of_that_length_is_similar():
    rng = np.random.default_rng(4)
    cases = [[1] * 42 + [0] * 4, [1] * 16 + [0] * 5 + [1] * 35, [0] * 9 + [1] * 37, [1] * 36 + [0] * 10, [0] * 60, []]
    for n in range(46, 67):  # one or two changed words in passages of 50 to 70 words
        for words in (1, 2):
            marks = np.ones(n, int)
            for at in rng.integers(0, n + 4, words):
                marks[max(0, at - 4):at + 1] = 0
            cases.append(np.concatenate([np.zeros(rng.integers(0, 20), int), marks, np.zeros(rng.integers(0, 20), int)]))
    cases += [(rng.random(rng.integers(46, 200)) < rng.choice([0.7, 0.8, 0.9])).astype(int) for _ in range(60)]
    for marks in cases:
        marks = np.array(marks, bool)
        want, got = similar_places(marks), C._segments(marks)
        assert bool(got) == bool(want.any())
        for s, e in got:
            assert e - s >= 46 and 10 * marks[s:e].sum() >= 8 * (e - s) and want[s:e].all()
        assert all(b[0] >= a[1] for a, b in zip(sorted(got), sorted(got)[1:]))
        left = want.copy()  # what is left over holds no further segment
        for s, e in got:
            left[s:e] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[0], left.astype(int), [0]])))
        assert not any(similar_places(marks[i:j]).any() for i, j in zip(edges[::2], edges[1::2]))


def test_short_passages_with_a_changed_word_are_linked(spark):
    rng, rows, n = random.Random(23), [], 60
    for i in range(n):
        words = [f"c{rng.randrange(10**9)}" for _ in range(rng.randint(58, 70))]
        copy = list(words)
        at = rng.choice([rng.randint(14, 20), len(copy) - rng.randint(15, 21)])  # in an outer third
        copy[at] = "new"
        rows += [(2 * i, around(rng, words)), (2 * i + 1, around(rng, copy))]
    got = {r.doc_id for r in C.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 0.9 * 2 * n  # windows can miss some near copies
