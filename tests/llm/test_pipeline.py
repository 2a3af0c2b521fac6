import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from fareloom.llm import latent_leaks, mixing, quality_classifier, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))

    def prose(n):
        return " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(k, prose(30)) for k in range(5)]
    rows, labels = [], []
    for i in range(240):
        text = prose(rng.randint(60, 160))
        if i % 4 == 0:
            text = " ".join(w + "###" for w in text.split())
        elif i % 10 == 1:
            text += " " + items[i % 5][1]
        elif i % 10 == 2:
            text = rows[i - 1][1].upper()
        rows.append((i, text, rng.choice(["en", "de"]), f"src{rng.randrange(4)}", len(text)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(i % 4 != 0), 0))
    rows += [(None, None, None, None, None), (500, rows[3][1], "en", "src1", 5), (501, "", "en", "src0", 0), rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_follow_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    # 1: rejected texts go, all others stay
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    weights = quality_classifier.fit(docs, labels.where(~quality_classifier.held_out()))
    rows = docs.collect()
    good = quality_classifier.probabilities([r.text or "" for r in rows], weights)
    want = [r for r, p in zip(rows, good) if p >= P.CUTOFF]
    first = P.good_quality(spark, docs, folder)
    assert first.columns == columns and sorted(map(str, first.collect())) == sorted(map(str, want))
    assert not [r for r in want if r.text and "###" in r.text] and len(want) > 150
    # 2: one document of each group
    prints = [simhash.fingerprint(r.text or "") for r in want]
    left, groups = set(range(len(want))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            k = todo.pop()
            group.append(k)
            near = {j for j in left if ((prints[j] ^ prints[k]) & (1 << 64) - 1).bit_count() <= 4}
            left -= near
            todo += near
        groups.append(min((want[k].doc_id is None, want[k].doc_id or 0) for k in group))
    second = P.near_dedup(spark, first, folder)
    got = [(r.doc_id is None, r.doc_id or 0) for r in second.collect()]
    assert second.columns == columns and sorted(got) == sorted(groups)
    # 3: texts with an item go
    def words(text):
        return [w for w in re.split(latent_leaks._SEPARATORS, (text or "").lower()) if w]
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stay = []
    for r in second.collect():
        codes = words(r.text)
        hit = any(latent_leaks.lcs(c, codes[s:s + len(c) + 4]) >= 0.8 * len(c) for c in items for s in range(0, len(codes), 2))
        if not hit:
            stay.append(r)
    third = P.decontaminated(spark, second, folder)
    assert third.columns == columns and sorted(map(str, third.collect())) == sorted(map(str, stay))
    assert len(stay) < len(groups)
    # 4: what the mixing operator takes, without repeats
    fourth = P.mixed(spark, third, folder)
    taken = mixing.mix(third, P.domain(), P.tree_weights(spark), P.MIX_SHARE, 1.0)
    ids = [r.doc_id for r in fourth.collect()]
    assert fourth.columns == columns and sorted(map(str, ids)) == sorted(str(r.doc_id) for r in taken.collect())
    assert len(ids) == len(set(ids)) and 0.7 * len(stay) < len(ids) < len(stay)
    # 5: every document has a place
    last = P.sharded(spark, fourth, folder)
    assert last.count() == len(ids) and last.select("shard", "slot").distinct().count() == len(ids)


def test_run_is_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert P.run(spark, folder).exceptAll(docs).count() == 0
    assert [name.split()[0] for name, _ in P.STAGES] == ["quality", "simhash", "benchmark", "mixing", "sharding"]


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
