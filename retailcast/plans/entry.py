"""The file entry point: five CSV inputs in; X, X_test and y out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.operators.joins import materialize
from retailcast.operators.panel import union_panel
from retailcast.plans.features import FEATURE_START, features_of_panel
from retailcast.sources import io
from retailcast.sources import schemas as sc

SCHEMAS = {"train": sc.TRAIN, "test": sc.TEST, "stores": sc.STORES, "oil": sc.OIL, "holidays_events": sc.HOLIDAYS}


def read_inputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The five inputs by name, in their schemas; a bad date or a missing column raises."""
    return {name: sc.conform(io.read_csv(spark, paths[name], schema), schema) for name, schema in SCHEMAS.items()}


def prepare_from_files(spark: SparkSession, paths: dict[str, str], out: str,
                       start: str = FEATURE_START) -> dict[str, DataFrame]:
    """Read and check the CSV inputs, and write ``X``, ``X_test`` and ``y`` as Parquet under ``out``.

    ``paths`` names the files train, test, stores, oil and holidays_events. A key that occurs
    twice raises. Returns the written tables.
    """
    inputs = read_inputs(spark, paths)
    panel = materialize(union_panel(inputs["train"], inputs["test"]), "panel")
    x = features_of_panel(panel, inputs["stores"], inputs["oil"], inputs["holidays_events"], start, with_target=True)
    x = materialize(x, "features")
    tables = {"X": x.filter(~F.col("is_test")).drop("is_test", "sales"),
              "X_test": x.filter("is_test").drop("is_test", "sales"),
              "y": x.filter(~F.col("is_test")).select("date", "store_nbr", "family", "sales")}
    for name, df in tables.items():
        io.write_parquet(df, f"{out}/{name}")
    return {name: io.read_parquet(spark, f"{out}/{name}", df.schema) for name, df in tables.items()}
