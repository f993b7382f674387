"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the rows by a seeded hash into buckets of about ``bucket_bytes`` and writes the
tagged rows once, so that bucket sizes and buckets agree. Pass two gathers each bucket and permutes
it (``shuffle``, a Fisher-Yates shuffle). The buckets one after the other are a random order of all
rows; it is dealt out in turn to the shards, whose row counts differ by at most one (law ``rows``).

Copies of a row are scattered too: the hash takes the number of the scan partition, so one bucket
gets at most one partition's copies. Defined results: a null text has 8 bytes and crc 0; null or
repeated ids, equal texts and repeated rows are each dealt a slot of their own; no rows, no shards.
All columns are kept; columns named like an output are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.llm.common import staged

SHARDS = 24
BUCKET_BYTES = 16 << 20
ROW_BYTES = 8
_OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shard(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = 20240601) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    docs = docs.drop(*_OWN)
    kept = docs.columns
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    total = docs.select(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    tagged = docs.select(
        F.pmod(F.xxhash64(F.lit(seed), F.spark_partition_id(), "doc_id", F.xxhash64("text")), F.lit(buckets)).alias("_bucket"),
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
    tagged = staged(tagged, "scattered")

    # Where each bucket begins: first within runs of 1,024 buckets, then over the runs.
    counts = tagged.groupBy("_bucket").agg(F.count("*").alias("n")).withColumn("_run", F.expr("_bucket div 1024"))
    runs = counts.groupBy("_run").agg(F.sum("n").alias("n")).select(
        "_run", (F.sum("n").over(Window.orderBy("_run")) - F.col("n")).alias("before"))
    begins = counts.join(runs, "_run").select(
        "_bucket", (F.col("before") + F.sum("n").over(Window.partitionBy("_run").orderBy("_bucket")) - F.col("n")).alias("begin"))

    gathered = tagged.groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    dealt = (gathered.join(begins, "_bucket")
             .select("begin", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_at", "_row"))
             .select("_row.*", (F.col("begin") + F.col("_at")).alias("_place")))
    text = F.coalesce(F.col("text"), F.lit(""))
    return dealt.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within each file; a shard's files are cut by slot range."""
    rows = sharded.withColumn("_cut", F.expr("slot div 1000000"))
    (rows.repartition("shard", "_cut").sortWithinPartitions("shard", "slot").drop("_cut")
     .write.partitionBy("shard").parquet(path))
