import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from retailcast.llm.common import staged

D = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, items, labels):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], D).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def fixture():
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice(["ta", "re", "lo", "mi", "su"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    clean = [(i, text(r.randint(40, 120)), r.choice(["a", "b", None])) for i in range(200)]
    toxic = [(300 + i, text(30) + " zorgh grukx " + text(20) + " zorgh", "a") for i in range(80)]
    items = [(i, text(30)) for i in range(5)]
    leaks = [(400 + i, text(40) + " " + items[i][1] + " " + text(10), "b") for i in range(5)]
    copies = [(500 + i, clean[i][1] + (" end" if i % 2 else ""), "a") for i in range(20)]
    odd = [(600, None, "a"), (601, "", None), (None, text(50), "b"), (0, clean[0][1], "a"), (602, text(3000), "a")]
    labels = [(i, 1, 0) for i, _, _ in clean] + [(i, 1, 1) for i, _, _ in toxic] + [(None, None, None)]
    return clean, toxic, items, leaks, copies, odd, labels


def test_stages_take_effect(spark, tmp_path):
    clean, toxic, items, leaks, copies, odd, labels = fixture()
    docs = clean + toxic + leaks + copies + odd
    write(spark, tmp_path, docs, items, labels)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = now.columns, {}
    for name, stage in P.STAGES:
        now = staged(stage(spark, now, str(tmp_path)), name)
        ids[name] = Counter(r.doc_id for r in now.select("doc_id").collect())
        if name != "sharding":
            assert now.columns == columns
    gone = set(i for i, _, _ in docs) - set(ids["toxicity"])
    assert {i for i, _, _ in toxic} <= gone and len(gone - {i for i, _, _ in toxic}) <= 3
    dedup = ids["near_dedup"]
    assert not {i for i, _, _ in copies} & set(dedup) and max(dedup.values()) == 1 and dedup[None] == 1 and dedup[600] == dedup[601] == 1
    left = ids["decontamination"]
    assert set(dedup) - set(left) == {i for i, _, _ in leaks} & set(dedup)
    assert max(ids["mixing"].values()) <= 2 and ids["sharding"] == ids["mixing"]
    rows = now.collect()
    count = Counter(r.shard for r in rows)
    assert max(count.values()) - min(count.values()) <= 1
    assert P.run(spark, str(tmp_path)).count() == len(rows)


def test_near_dedup_keeps_unrelated_texts_of_an_id_and_finds_copies_without_id(spark):
    text = lambda name, end="": " ".join(f"{name}{i}" for i in range(60)) + end
    docs = [(1, text("a")), (1, text("b", " more")), (2, text("a", " x")), (3, text("b", " less")), (None, text("c")), (None, text("c", " z")), (7, text("d")), (None, text("d", " y"))]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs], D)
    left = [(r.doc_id, r.text.split()[0][0]) for r in P.near_dedup(spark, df, "").collect()]
    assert sorted(left, key=str) == [(1, "a"), (1, "b"), (7, "d"), (None, "c")]


CLASHING = ["score", "key_id", "key_hash", "_copies", "_copy", "_hash", "size", "shard", "_others", "row", "group", "text_hash", "component"]


def test_stages_leave_other_columns_alone(spark, tmp_path):
    """Columns with names that the stages use themselves."""
    clean, toxic, items, leaks, copies, odd, labels = fixture()
    rows = clean[:60] + toxic[:30] + leaks[:2] + copies[:4] + odd
    write(spark, tmp_path, rows, items, labels)
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = plain.select("doc_id", *(F.concat(F.lit(f"{c} "), F.coalesce("text", F.lit("-"))).alias(c) for c in CLASHING), *plain.columns[1:])
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"] if name == "sharding" else []
        assert out.columns == [c for c in docs.columns if c not in new] + new
        left = [c for c in CLASHING if c not in new]
        got = out.select("doc_id", "text", *left).collect()
        assert got and all(r[c] == f"{c} {'-' if r.text is None else r.text}" for r in got for c in left)
        if name in ("near_dedup", "decontamination", "mixing"):
            wanted = Counter(r.doc_id for r in stage(spark, plain, str(tmp_path)).collect())
            assert Counter(r.doc_id for r in got) == wanted


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stage_on_no_rows(spark, tmp_path, name, stage):
    clean, _, items, _, _, _, labels = fixture()
    write(spark, tmp_path, clean[:5], items, labels)
    assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path)).count() == 0
