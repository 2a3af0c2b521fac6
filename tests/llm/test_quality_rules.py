import re
from collections import Counter
from math import comb

import numpy as np
import pandas as pd

from fareloom.llm import quality_rules as R

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = SPACE.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))


def test_counts_match_brute_force(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x\ny\nx\n x\n\n\n", "é\x85b ü c\x1cd #|# <b>",
             "l1 w\nl1 w\nl1 w", "a b", "a b c d a b c e b c d " * 4000, "z" * 90_000]
    docs = spark.createDataFrame([(i, t, None if i % 3 else "en", 3) for i, t in enumerate(texts + texts[3:5])],
                                 "doc_id long, text string, lang string, level int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in R.judge(docs, labels).collect()}
    assert len(got) == len(texts) + 2
    for i, t in enumerate(texts + texts[3:5]):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)  # nothing is certified
    assert R.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_bound_is_exact():
    for x, n in ((0, 100), (3, 250), (7, 40)):
        p = R.upper_bound(x, n, 0.05)
        assert abs(sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(x + 1)) - 0.05) < 1e-9
    assert R.upper_bound(0, 100, 0.05) == 1 - 0.05 ** (1 / 100) or abs(R.upper_bound(0, 100, 0.05) - 0.029513) < 1e-6


def test_strictness_stops_at_the_first_failure():
    level = pd.Series([0, 5, 6, 21])
    assert R.strictest(level, pd.Series([0, 2, 60, 5000]), 0.01, 0.05) == 5
    assert R.strictest(level, pd.Series([0, 0, 0, 5000]), 0.01, 0.05) == R.STEPS
    assert R.strictest(level, pd.Series([100, 0, 0, 500]), 0.01, 0.05) == -1
    assert R.strictest(level, pd.Series([0, 0, 0, 50]), 0.01, 0.05) == -1


def test_level_is_the_first_step_that_rejects():
    for value in (0.0, 0.02, 0.021, 0.1, 0.15, 0.2999, 0.3, 0.31, 1.0):
        loose, strict = R.RULES["symbol_share"]
        want = next((k for k in range(R.STEPS + 1)
                     if value > loose + k / R.STEPS * (strict - loose) + 1e-12), R.STEPS + 1)
        assert R.levels_of((value, 0, 0, 0, 0, 0, 0)) == [want] + [R.STEPS + 1] * 6, value


def test_junk_goes_and_good_stays_where_labels_suffice(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en") for i in range(600)]
    junk = [(1000 + i, " ".join(f"w{i}x{k}###" for k in range(60)), "en") for i in range(20)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(600)], "doc_id long, quality int")
    kept = {r.doc_id for r in R.judge(docs, labels).where("kept").collect()}
    assert kept == set(range(600))


def words(i, tail="", n=60):
    return " ".join(f"w{i}x{k}{tail}" for k in range(n))


def test_one_unfit_rule_leaves_the_others_on_and_a_small_stratum_uses_the_pool(spark):
    good = [(i, " ".join(f"w{i}x{k}" + "y" * 60 for k in range(60)), "long") for i in range(700)]
    good += [(2000 + i, words(i), "en") for i in range(600)] + [(4000 + i, words(i), "small") for i in range(20)]
    junk = [(9000 + i, words(i, "###"), lang) for i, lang in enumerate(["long", "en", "small"] * 3)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good], "doc_id long, quality int")
    rows = R.judge(docs, labels).collect()
    assert {r.doc_id for r in rows if r.kept} == {i for i, *_ in good}  # long words stay in their language
    by = {r.doc_id: r for r in rows}
    assert (by[0].without, by[0].bound_on) == ("mean_word_chars", "stratum")
    assert (by[2000].without, by[2000].bound_on) == ("", "stratum")
    assert by[4000].bound_on == "pool"


def test_the_risk_holds_over_many_draws():
    """Good texts with levels of a known law: an accepted strictness rejects more than alpha in few draws."""
    rng = np.random.default_rng(5)
    law = np.array([.001] * 21 + [.979])
    wrong = 0
    for _ in range(400):
        n = np.bincount(rng.choice(22, 900, p=law), minlength=22)
        step = R.strictest(pd.Series(range(22)), pd.Series(n), 0.02 - 1e-9, 0.05)
        wrong += law[:step + 1].sum() > 0.02 - 1e-9
    assert wrong <= 400 * 0.05 + 3 * (400 * 0.05) ** .5
