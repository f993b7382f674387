"""Ordered-series operators: linear gap interpolation and rolling mean.

Both take ``partition_cols``.  Per-series use partitions by the series key;
with no partition columns they are meant for one-row-per-date tables (oil
prices), whose size is bounded by the number of calendar days, not by the
data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _window(order: str, partition_cols):
    w = Window.orderBy(order)
    return Window.partitionBy(*partition_cols).orderBy(order) if partition_cols else w


def interpolate_linear(df: DataFrame, value: str, order: str = "date",
                       partition_cols=(), out: str | None = None) -> DataFrame:
    """Fill NULLs of ``value`` linearly by row position, in both directions.

    Inner gaps: prev + (next - prev) * (pos - prev_pos) / (next_pos - prev_pos).
    Leading gap takes the first observed value, trailing gap the last one.
    Observed values are left unchanged; an all-NULL series stays NULL.
    """
    out = out or value
    w = _window(order, partition_cols)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v = F.col(value)
    df = df.withColumn("_pos", F.row_number().over(w))
    seen_pos = F.when(v.isNotNull(), F.col("_pos"))
    df = df.withColumns({
        "_pv": F.last(v, ignorenulls=True).over(back),
        "_pp": F.last(seen_pos, ignorenulls=True).over(back),
        "_nv": F.first(v, ignorenulls=True).over(ahead),
        "_np": F.first(seen_pos, ignorenulls=True).over(ahead),
    })
    inner = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_pos") - F.col("_pp")) / (
        F.col("_np") - F.col("_pp"))
    filled = F.coalesce(v, F.when(F.col("_pv").isNotNull() & F.col("_nv").isNotNull(), inner),
                        F.col("_pv"), F.col("_nv"))
    return df.withColumn(out, filled).drop("_pos", "_pv", "_pp", "_nv", "_np")


def rolling_mean(df: DataFrame, value: str, window: int, min_periods: int = 1,
                 order: str = "date", partition_cols=(), out: str | None = None) -> DataFrame:
    """Mean of the last ``window`` rows (current included); NULL below ``min_periods`` values."""
    out = out or value
    frame = _window(order, partition_cols).rowsBetween(-(window - 1), Window.currentRow)
    mean = F.avg(value).over(frame)
    return df.withColumn(out, F.when(F.count(value).over(frame) >= min_periods, mean))
