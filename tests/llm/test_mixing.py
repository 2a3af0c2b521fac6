import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fareloom.llm import mixing as M


def domain():
    return F.when(F.col("source").isin("s1", "s2"), "web").when(F.col("source") == "s3", "books")


def fill(budget, rooms, weights):
    """Water filling by repetition."""
    amount, open_ = {k: 0.0 for k in rooms}, {k for k in rooms if weights[k] > 0}
    while open_:
        left, w = budget - sum(amount.values()), sum(weights[k] for k in open_)
        full = {k for k in open_ if rooms[k] <= weights[k] * left / w * (1 + 1e-12)}
        if not full:
            for k in open_:
                amount[k] = weights[k] * left / w
            break
        for k in full:
            amount[k] = rooms[k]
        open_ -= full
    return amount


def brute(rows, weights, share, epochs, h):
    leaves = defaultdict(list)
    for r in rows:
        leaves[r[:3]].append(r)
    n = {k: sum(r[5] for r in v) for k, v in leaves.items()}
    amount = {(): share * sum(n.values())}
    for depth in range(3):
        new = {}
        for parent, budget in amount.items():
            room = defaultdict(float)
            for k, v in n.items():
                if k[:depth] == parent:
                    room[k[depth]] += v * epochs
            w = {c: weights.get((M.LEVELS[depth], c), 1.0) for c in room}
            new.update({(*parent, c): a for c, a in fill(budget, room, w).items()})
        amount = new
    out = Counter()
    for leaf, members in leaves.items():
        t = math.floor(amount[leaf] + 1e-9)
        full, rest = divmod(t, n[leaf]) if n[leaf] else (0, 0)
        for r in members:
            out[r[3]] += full
        left = rest
        for r in sorted(members, key=lambda r: (h[(r[3], r[4], full)], r[3])):
            if rest == 0 and not n[leaf]:
                break
            if r[5] > left:  # the text that crosses the end
                if 2 * left > r[5]:
                    out[r[3]] += 1
                break
            left -= r[5]
            out[r[3]] += 1
    return {k: v for k, v in out.items() if v}, amount


def corpus(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        text = None if i % 41 == 0 else " ".join(["w"] * rng.randint(1, 30))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", "s4", None]), 9, "z"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int, h string")


def test_matches_brute_force(spark):
    docs = corpus(spark)
    weights = {("domain", "web"): 3.0, ("domain", "books"): 1.0, ("domain", ""): 0.5, ("lang", "en"): 1.0,
               ("lang", "de"): 4.0, ("lang", ""): 0.0, ("source", "s1"): 1.0, ("source", "s2"): 2.0}
    table = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "level string, name string, weight double")
    rows = [(r.domain, r.lang, r.source, r.id, r.hash, r.tokens) for r in M.described(docs, domain()).collect()]
    frame = spark.createDataFrame([(r[3], r[4], e) for r in rows for e in range(6)], "id long, hash long, e long")
    h = {(r.id, r.hash, r.e): r.h for r in frame.withColumn("h", M._place(17, F.col("e"), F.col("id"), F.col("hash"))).collect()}
    for share, epochs in ((0.3, 1.0), (1.0, 4.0), (0.9, 1.0), (2.5, 3.0), (5.0, 2.0), (0.0, 4.0)):
        got = Counter(r.doc_id for r in M.mix(docs, domain(), table, share, epochs).collect())
        want, amount = brute(rows, weights, share, epochs, h)
        assert dict(got) == want, (share, epochs)
        tokens, taken = {r[3]: r[5] for r in rows}, defaultdict(int)
        for r in rows:
            taken[r[:3]] += tokens[r[3]] * got[r[3]]
        longest = max(tokens.values())
        assert all(abs(taken[k] - min(a, epochs * sum(r[5] for r in rows if r[:3] == k))) <= longest / 2 + 1
                   for k, a in amount.items())
        leaves = M.budgets(M.described(docs, domain()), table, share, epochs).collect()
        assert all(math.isclose(r.amount, amount[(r.domain, r.lang, r.source)], rel_tol=1e-9, abs_tol=1e-9) for r in leaves)


def test_equal_rows_are_taken_one_by_one_and_columns_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s1", 1)] * 50 + [(None, None, None, None, 2)], "doc_id long, text string, lang string, source string, h int")
    table = spark.createDataFrame([], "level string, name string, weight double")
    got = M.mixed_documents(docs, domain(), table, 0.51)
    assert got.columns == docs.columns and got.where("doc_id = 1").count() == 25  # 102 of 200 tokens
    assert M.mixed_documents(docs, domain(), table, 0.516).where("doc_id = 1").count() == 26  # 103
    assert M.mixed_documents(docs.limit(0), domain(), table, 0.5).count() == 0
    assert M.mixed_documents(docs, domain(), table, 1.0).where("doc_id = 1").count() == 50


def test_words(spark):
    texts = ["", " ", "a", " a", "a b ", "\ta\n\x0bb \x0c", None, "é \x85 x", "w " * 50_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_main_path_has_no_python(spark):
    table = spark.createDataFrame([("lang", "en", 2.0)], "level string, name string, weight double")
    plan = M.mix(corpus(spark), domain(), table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
