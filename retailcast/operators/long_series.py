"""Gap interpolation and rolling mean of one ordered series of any length.

The operators of ``series`` put a series into one task, which is right for a table of dates. Here the rows
are dealt into ranges of their order and numbered over all ranges; from then on blocks of consecutive
numbers are the unit of work. What a block needs from the others is carried: the last known value before
it and the first one after it from a table of one row a block, the rows before it that a rolling window
reaches back to as copies. Results equal those of ``series``. Equal values of ``order`` are not defined
to come in one order; a null order comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.operators.joins import bounded_broadcast, materialize

BLOCK_ROWS = 1 << 17


def number_rows(df: DataFrame, order: str, ranges: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``_pos``, its row number from 0 by ``order``; a written table."""
    n = ranges or max(1, -(-df.count() // block_rows))
    dealt = materialize(df.repartitionByRange(n, F.col(order).asc_nulls_first()).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first())) - 1
    return materialize(dealt.withColumn("_at", inside).join(F.broadcast(before), "_range").withColumn("_pos", F.col("_before") + F.col("_at"))
                       .drop("_range", "_at", "_before"), "numbered")


def interpolate_linear(df: DataFrame, value: str, order: str = "date", out: str | None = None,
                       ranges: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``series.interpolate_linear`` of one series, over blocks."""
    rows = number_rows(df, order, ranges, block_rows).withColumn("_block", F.floor(F.col("_pos") / block_rows))
    known = F.when(F.col(value).isNotNull(), F.struct("_pos", F.col(value).alias("v")))
    ends = rows.groupBy("_block").agg(F.min(known).alias("first"), F.max(known).alias("last"))  # a row for each block
    by = Window.orderBy("_block")
    carried = ends.select("_block", F.last("last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                          F.first("first", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = Window.partitionBy("_block").orderBy("_pos")
    both = rows.join(bounded_broadcast(carried), "_block").withColumns({
        "_prev": F.coalesce(F.last(known, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before")),
        "_next": F.coalesce(F.first(known, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("_after"))})
    a, b = F.col("_prev"), F.col("_next")
    inner = a["v"] + (b["v"] - a["v"]) * (F.col("_pos") - a["_pos"]) / (b["_pos"] - a["_pos"])
    filled = F.coalesce(F.col(value), F.when(a.isNotNull() & b.isNotNull(), inner), a["v"], b["v"])
    return both.withColumn(out or value, filled).select(*df.columns, *([out] if out and out not in df.columns else []))


def rolling_mean(df: DataFrame, value: str, window: int, min_periods: int = 1, order: str = "date", out: str | None = None,
                 ranges: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``series.rolling_mean`` of one series, over blocks of at least ``window`` rows."""
    size = max(window, block_rows)
    rows = number_rows(df, order, ranges, block_rows)
    own = F.floor(F.col("_pos") / size)
    reached = F.floor((F.col("_pos") + window - 1) / size)  # the block of the last row whose window holds this one
    copies = rows.withColumn("_block", F.explode(F.sequence(own, reached)))
    frame = Window.partitionBy("_block").orderBy("_pos").rowsBetween(-(window - 1), Window.currentRow)
    mean = F.when(F.count(value).over(frame) >= min_periods, F.avg(value).over(frame))
    done = copies.withColumn("_mean", mean).where(F.col("_block") == own)
    kept = [c for c in df.columns if c != (out or value)]
    named = done.select(*kept, F.col("_mean").alias(out or value))
    return named.select(*(df.columns if (out or value) in df.columns else [*df.columns, out]))
