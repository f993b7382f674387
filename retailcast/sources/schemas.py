"""Explicit schemas of the logical input and output tables.

Inputs are validated against these at scan time instead of being inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEYS = ("date", "store_nbr", "family")
SERIES = ("store_nbr", "family")

# The feature columns that are categories, whatever their type.
CATEGORY_COLUMNS = ("city", "event", "family", "holiday", "holiday_description", "payday", "state", "store_nbr", "type", "workday")

TRAIN = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("store_nbr", T.LongType(), False),
    T.StructField("family", T.StringType(), False),
    T.StructField("sales", T.DoubleType(), True),
    T.StructField("onpromotion", T.LongType(), False),
])

TEST = T.StructType([f for f in TRAIN.fields if f.name != "sales"])

STORES = T.StructType([
    T.StructField("store_nbr", T.LongType(), False),
    T.StructField("city", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("cluster", T.LongType(), True),
])

OIL = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("dcoilwtico", T.DoubleType(), True),
])

HOLIDAYS = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("locale", T.StringType(), True),
    T.StructField("locale_name", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("transferred", T.BooleanType(), True),
])

# JSON-lines trial log: {target, params{...}, datetime{datetime, elapsed, delta}}
BOOSTED_PARAMS = T.StructType([
    T.StructField(n, T.DoubleType(), True)
    for n in ("gamma", "learning_rate", "max_depth", "n_estimators", "subsample")
])
TRIAL_LOG = T.StructType([
    T.StructField("target", T.DoubleType(), True),
    T.StructField("params", BOOSTED_PARAMS, True),
    T.StructField("datetime", T.StructType([
        T.StructField("datetime", T.StringType(), True),
        T.StructField("elapsed", T.DoubleType(), True),
        T.StructField("delta", T.DoubleType(), True),
    ]), True),
])

SCORES = T.StructType([
    T.StructField("Model", T.StringType(), False),
    T.StructField("cv", T.DoubleType(), True),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast ``df`` to ``schema``; fail loudly on a missing column."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
