"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs no recomputation, and several readers share one
    evaluation (also of expressions that depend on how the rows were partitioned)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no result still to be computed reads."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, max_bytes: int, row_bytes: Column | int) -> bool:
    """Whether the summed size of all rows of ``df`` stays within ``max_bytes`` (one aggregation)."""
    width = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return (df.select(F.sum(width.cast("long"))).first()[0] or 0) <= max_bytes


def text_key(text: Column) -> Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(text)
