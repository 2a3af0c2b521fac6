import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from fareloom.llm import slots as S


def test_shards_follow_the_key_and_numbers_have_no_gap(spark):
    texts = [None, "", "é" * 30, "same", "same", "long " * 20_000] * 60
    docs = spark.createDataFrame([(None if i % 50 == 7 else i // 2, t, 5, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, slot int, shard string")
    got = S.shard(docs).collect()
    assert len(got) == len(texts)
    seen, places = defaultdict(set), defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
        seen[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert all(len(v) == 1 for v in seen.values())
    want = sorted((i // 2 if i % 50 != 7 else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                  for i, t in enumerate(texts))
    assert want == sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got)
    assert S.shard(docs.limit(0)).count() == 0
    alone = S.shard(docs.where("doc_id = 3")).first()
    assert (alone.shard, alone.grown_shard) in seen[3]


def test_grown_and_rebalanced_maps(spark, tmp_path):
    first = S.first_map(spark, 8)
    grown = S.grown_map(first, 8)
    counts = [r["count"] for r in grown.groupBy("shard").count().collect()]
    assert len(counts) == 9 and max(counts) - min(counts) <= 1
    loads = first.select("vslot", F.when(F.col("shard") == 2, 900).otherwise(10 + F.col("vslot") % 7).alias("bytes"))
    even = S.rebalanced_map(first, loads, 8)
    assert even.count() == 4096 and even.select("vslot").distinct().count() == 4096
    sums = [r.b for r in even.join(loads, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(sums) < 1.05 * min(sums)
    stay = first.join(even.select("vslot", F.col("shard").alias("to")), "vslot")
    assert stay.where("shard <> to and shard <> 2").count() == 0
    S.save_map(first, str(tmp_path / "map"))
    S.save_map(even, str(tmp_path / "map"))
    assert S.load_map(spark, str(tmp_path / "map"), 2).exceptAll(even).count() == 0
