"""Joins to dimension-like tables with an explicit size check before broadcasting."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when the measured bytes of its rows stay under this bound; above
# it the join is left to a shuffle join (AQE may still split skewed keys).
BROADCAST_MAX_BYTES = 256 << 20
#: Rows of a written file at most: later scans deal files out to the cores.
FILE_ROWS = 1 << 18


def small_table(df: DataFrame) -> DataFrame:
    """Cache a table expected to be small, narrowed (no shuffle) to at most the cluster's
    default parallelism: AQE does not coalesce cached plans, so a 200-partition session
    would otherwise run 200 near-empty tasks for every read of it."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(width).persist(StorageLevel.MEMORY_AND_DISK)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 16 for each column, and the text or elements it holds."""
    width = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width = width + 16 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return width


def bounded_broadcast(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``small`` with a broadcast hint if its rows measure no more than ``max_bytes``."""
    return bounded_broadcasts(small, max_bytes=max_bytes)[0]


def bounded_broadcasts(*smalls: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> list[DataFrame]:
    """Measure several small tables in one job; hint broadcast on those within the bound.

    The tables are persisted before they are measured so the measure and the join read the
    same rows once; a lost cached block is recomputed from lineage.
    """
    if not smalls:
        return []
    kept = [small_table(t) for t in smalls]
    sums = [t.agg(F.coalesce(F.sum(row_bytes(t)), F.lit(0)).alias("b")).withColumn("_i", F.lit(i))
            for i, t in enumerate(kept)]
    n = {r["_i"]: r["b"] for r in reduce(DataFrame.unionByName, sums).collect()}
    return [F.broadcast(t) if n[i] <= max_bytes else t for i, t in enumerate(kept)]


def materialize(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """Cut the lineage: write ``df`` once as parquet into the shared ``spark.checkpoint.dir``
    and read it back.

    The plan runs once (a plain ``checkpoint()`` without a cache would run it
    twice), the files survive executor loss, and later reads keep column
    pruning and filter pushdown. ``options``: those of the writer.
    """
    import uuid

    from retailcast.session import checkpoint_dir
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/retailcast-tables/{name}-{uuid.uuid4().hex}"
    # no shuffle of its own: AQE has sized the partitions behind a shuffle already, and scans keep their splits
    df.write.mode("overwrite").options(**{"maxRecordsPerFile": FILE_ROWS, **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left",
                   max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Equi-join ``fact`` to ``dim``: broadcast hash join when ``dim`` is proven small."""
    return fact.join(bounded_broadcast(dim, max_bytes), on, how)
