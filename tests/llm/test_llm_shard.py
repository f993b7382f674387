import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from retailcast.llm.shard import shard, write_shards

D = "doc_id long, text string, shard int, begin long"


def test_every_row_has_one_slot_and_counts_are_even(spark):
    docs = [(i, f"text {i % 7}" * (i % 5), -1, i) for i in range(500)] + [(None, None, 0, 0)] * 3 + [(7, "same", 0, 0)] * 200 + [(8, "long " * 50_000, 0, 0), (9, "", 0, 0)]
    out = shard(spark.createDataFrame(docs, D).repartition(6), bucket_bytes=1000)
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.begin) for r in got) == Counter((a, b, d) for a, b, _, d in docs)
    slots = defaultdict(list)
    for r in got:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_order_is_random_and_copies_are_spread(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"))
    got = shard(docs, bucket_bytes=2000).collect()
    assert max(Counter(r.shard for r in got if r.doc_id < 2000).values()) < 2000 / 24 * 1.6
    place = sorted((r.slot * 24 + r.shard, r.doc_id) for r in got)
    rising = sum(a[1] < b[1] for a, b in zip(place, place[1:]))
    assert 1800 < rising < 2200


def test_few_and_no_rows(spark):
    assert shard(spark.createDataFrame([], D)).count() == 0
    assert [(r.slot) for r in shard(spark.createDataFrame([(1, "a", 0, 0)], D)).collect()] == [0]


def test_no_python_in_the_plan(spark):
    plan = shard(spark.createDataFrame([(1, "a", 0, 0)], D))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    write_shards(shard(docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 24
