"""Inverse-error weighted blend of model predictions, and permutation importance."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.functions.metrics import msle_term, reciprocal_weight
from retailcast.operators.joins import join_dimension, materialize


def blend(predictions: DataFrame, scores: DataFrame, key: str = "id",
          pred: str = "pred", out: str = "sales") -> DataFrame:
    """sum(pred_i * e_i) / sum(e_i) per key, e_i = 1 / RMSLE_i.

    ``predictions``: long (key, model, pred); ``scores``: (model, cv).  The
    score table has one row per model and is broadcast after a size check.
    """
    w = scores.select("model", reciprocal_weight(F.col("cv")).alias("_w"))
    p = join_dimension(predictions, w, "model", "inner")
    return p.groupBy(key).agg((F.sum(F.col(pred) * F.col("_w")) / F.sum("_w")).alias(out))


def long_predictions(df: DataFrame, keys: list[str], model_cols: list[str]) -> DataFrame:
    """Wide prediction columns -> (keys..., model, pred)."""
    return df.unpivot(list(keys), model_cols, "model", "pred")


RANK_BUCKETS = 1024
_ORDER_BITS = 60


def hashed_order(key: Column, seed: int) -> Column:
    """A seeded order of rows: the first 60 bits of the md5 of "key-seed", as a number from 0."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")).cast("binary")), 1, _ORDER_BITS // 4), 16, 10).cast("long")


def _ranked(df: DataFrame, order: Column) -> DataFrame:
    """``df`` with ``_rk``, its row number from 0 in the order of ``order``, a 60-bit number, then ``_key``.

    Ranges of the number are counted first, then each is numbered by itself, so the numbering
    is one over all rows and no task sorts more than a range.
    """
    d = df.withColumn("_h", order).withColumn("_b", F.shiftright("_h", _ORDER_BITS - 10))
    sums = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_key")) - 1
    return (d.withColumn("_at", at).join(F.broadcast(sums), "_b")  # RANK_BUCKETS rows at most
            .withColumn("_rk", F.col("_before") + F.col("_at")).drop("_h", "_b", "_at", "_before"))


def permute_column(df: DataFrame, col: str, key: str = "id", seed: int = 1) -> DataFrame:
    """Seeded shuffle of one column's values over all rows.

    Rows are numbered in one hashed order of their keys and values in another; equal numbers
    meet. One rule at every size: any value can come to any row.
    """
    recv = _ranked(df.withColumn("_key", F.col(key)), hashed_order(F.col("_key"), seed)).drop("_key")
    give = _ranked(df.select(F.col(col).alias("_v"), F.col(key).alias("_key")),
                   hashed_order(F.col("_key"), seed + 1)).drop("_key")
    return recv.join(give, "_rk").drop(col, "_rk").withColumnRenamed("_v", col)


def permutation_importance(scored: DataFrame, features: list[str], predict, y: str = "sales",
                           key: str = "id", seed: int = 1) -> DataFrame:
    """RMSLE rise when one feature column is shuffled, sorted by rise;
    ``predict(df) -> df(key, pred)``.

    One scoring job per feature (a driver loop over the feature list only).
    """
    truth = scored.select(key, y)

    def score(df):
        p = predict(df).join(truth, key)
        return p.agg(F.sqrt(F.avg(msle_term(F.col(y), F.col("pred")))).alias("s")).first()["s"]

    base = score(scored)
    rows = [(f, float(score(permute_column(scored, f, key, seed)) - base)) for f in features]
    return scored.sparkSession.createDataFrame(rows, "feature string, rise double") \
        .orderBy("rise")


def feature_shift(feature: str, seed: int, n: int) -> int:
    """How far a feature's values move along the hashed order of n rows: 1 to n - 1."""
    return 1 + int(hashlib.md5(f"{feature}-{seed}".encode()).hexdigest()[:15], 16) % max(n - 1, 1)


def permutation_importances(scored: DataFrame, features: list[str], predict, y: str = "sales",
                            key: str = "id", seed: int = 1) -> DataFrame:
    """(feature, rise): RMSLE rise with each feature's values moved between the rows, all in one pass.

    Rows are numbered once in a hashed order; a feature's values move along it, around its end, by a seeded
    shift of its own. The rows stand once for each feature, joined by (feature, number) to the row that
    gives the value, and one grouped aggregation scores them. ``predict(df)`` adds ``pred`` to the rows.
    """
    names = [f for f in features]
    ranked = materialize(_ranked(scored.withColumn("_key", F.col(key)), hashed_order(F.col(key), seed)).drop("_key"), "ranked")
    n = ranked.count()
    moves = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(feature_shift(f, seed, n)).cast("long").alias("shift")) for f in names)))
    taking = ranked.select("*", moves.alias("_move")).select("*", F.col("_move.feature").alias("feature"), ((F.col("_rk") + F.col("_move.shift")) % n).alias("_from"))
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("value")) for f in names)))
    giving = ranked.select(F.col("_rk").alias("_from"), values.alias("_v")).select("_from", F.col("_v.feature").alias("feature"), F.col("_v.value").alias("_value"))
    moved = taking.join(giving, ["feature", "_from"])
    moved = moved.withColumns({f: F.when(F.col("feature") == f, F.col("_value").cast(scored.schema[f].dataType)).otherwise(F.col(f"`{f}`")) for f in names})
    error = F.sqrt(F.avg(msle_term(F.col(y), F.col("pred"))))
    base = predict(scored).agg(error.alias("e")).first()["e"]  # one number
    return predict(moved.drop("_move", "_from", "_rk", "_value")).groupBy("feature").agg((error - F.lit(base)).alias("rise"))
