"""The corpus pipeline: five stages over ``documents``, each one of the operators of retailcast.llm.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its rows are written as Parquet and read
again as the next one's ``docs``; all but the last return the columns that they get. Decisions name
rows by doc_id and a hash of the text, so null and repeated ids are handled as any other row. Columns that
``documents`` doesn't have travel in one struct, so none of them can meet a stage's own names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.llm.common import small_enough, staged, table, text_key
from retailcast.llm.decontaminate import decontaminate
from retailcast.llm.mix import mix
from retailcast.llm.near_dup import near_duplicates
from retailcast.llm.shard import shard
from retailcast.llm.toxicity import fit, with_scores

#: Bytes of keys of rows up to which a join with them is a broadcast.
BROADCAST_BYTES = 32 << 20


#: The columns of documents; the stages see no others.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keeping(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` over the columns of documents, with the other columns of its rows unchanged."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in docs.columns if c in COLUMNS]
        others = [F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS]
        packed = docs.select(*own, F.struct(*others).alias("_others")) if others else docs
        out = stage(spark, packed, sf_dir)
        if not others:
            return out
        back = [F.col(c) if c in own else F.col("_others").getField(c).alias(c) for c in docs.columns]
        added = [c for c in out.columns if c not in packed.columns]
        return out.select(*(c for c, name in zip(back, docs.columns) if name not in added), *added)
    return run


def _hint(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if small_enough(keys, BROADCAST_BYTES, 24) else keys


def _same_row():
    """A row of docs is the one of ``key_id`` and ``key_hash``."""
    return F.col("doc_id").eqNullSafe(F.col("key_id")) & (text_key(F.col("text")) == F.col("key_hash"))


@_keeping
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The network learns from the labelled rows of its input. Null,
    empty and wordless texts score as texts without words do and stay unless that is 0.5 or more."""
    net = fit(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, net).where("score < 0.5").select(*docs.columns)


@_keeping
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8) one row stays, of the smallest
    id if any has one. Rows without words all stay."""
    found = near_duplicates(docs, words=5, percent=80)
    own = F.concat_ws(" ", F.lit("row"), F.col("doc_id"), F.col("text_hash"))
    group = F.when(F.col("digest").isNull(), own).otherwise(F.concat(F.lit("set "), F.col("component")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
    # Rows without words stay as often as they come; of others that repeat an id and a text, one stays.
    kept = staged(found.groupBy(group.alias("group")).agg(F.min(first).alias("x"), F.count("*").alias("n"), F.first("digest").isNull().alias("wordless"))
                  .select("x.key_id", "x.key_hash", ((F.col("n") > 1) & ~F.col("wordless")).alias("many")), "kept")
    alone = docs.join(_hint(kept.where("not many")), _same_row(), "left_semi")
    # only groups of several rows can hold a row twice
    others = docs.join(_hint(kept.where("many")), _same_row(), "left_semi").withColumn("_hash", text_key(F.col("text")))
    return alone.unionByName(others.dropDuplicates(["doc_id", "_hash"]).drop("_hash")).select(*docs.columns)


@_keeping
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a 10-word window with a benchmark item go. Null, empty and wordless texts share
    none and stay."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    hits = staged(found.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")), "contaminated")
    return docs.join(_hint(hits), _same_row(), "left_anti").select(*docs.columns)


@_keeping
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its words taken over its words, rounded (0, 1 or
    2); rows that repeat an id and a text share one decision. Null, empty and wordless texts have nothing
    to take and go."""
    taken = mix(docs)
    copies = (taken.groupBy(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
              .agg(F.round(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0))).cast("int").alias("_copies")).where("_copies > 0"))
    return (docs.join(_hint(staged(copies, "copies")), _same_row())
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns))


@_keeping
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order over 24 shards: their columns, and size, text_crc32, law, shard, slot and
    grown_shard, which take the place of columns of these names. Null, empty and wordless texts are rows like others."""
    return shard(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the network, nor the seeded random order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
