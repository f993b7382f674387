"""Panel operators on the daily (date, store_nbr, family) table.

Per-series windows partition by (store_nbr, family): one series holds at most
one row per date, so a window group is bounded by the calendar length, never
by data volume.  Totals over wider groups (a city can hold a large share of
all stores) are partial aggregates joined back, which AQE can split when a
key is hot, instead of unbounded window groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.operators.joins import join_dimension
from retailcast.sources.schemas import KEYS, SERIES


def series_window(order: str = "date", by=SERIES):
    return Window.partitionBy(*by).orderBy(order)


def store_join(fact: DataFrame, stores: DataFrame, keep_cluster: bool = False) -> DataFrame:
    """Left join of the store dimension (city, state, type) on store_nbr."""
    dim = stores if keep_cluster else stores.drop("cluster")
    return join_dimension(fact, dim, "store_nbr", "left")


def city_promo_totals(df: DataFrame) -> DataFrame:
    """(date, city, family) -> total_other_city_promo; bounded by calendar x cities x families."""
    return df.groupBy("date", "city", "family").agg(
        F.sum("onpromotion").alias("total_other_city_promo"))


def store_promo_totals(df: DataFrame) -> DataFrame:
    """(date, store_nbr) -> total_other_promo_store; bounded by calendar x stores."""
    return df.groupBy("date", "store_nbr").agg(
        F.sum("onpromotion").alias("total_other_promo_store"))


def promo_totals(df: DataFrame, exclude_self: bool = False,
                 city_totals: DataFrame | None = None,
                 store_totals: DataFrame | None = None) -> DataFrame:
    """total_other_promo_store by (date, store_nbr); total_other_city_promo by (date, city, family).

    Both totals are partial aggregates joined back, so a store or city with a large share of
    the rows is summed map-side; pass them size-checked to have them broadcast.  Rows with a
    NULL city get NULL (join semantics).
    """
    city = city_totals if city_totals is not None else city_promo_totals(df)
    store = store_totals if store_totals is not None else store_promo_totals(df)
    df = (df.join(city, ["date", "city", "family"], "left")
          .join(store, ["date", "store_nbr"], "left"))
    if exclude_self:
        own = F.coalesce(F.col("onpromotion"), F.lit(0))
        df = df.withColumns({"total_other_promo_store": F.col("total_other_promo_store") - own,
                             "total_other_city_promo": F.col("total_other_city_promo") - own})
    return df


def partition_by_series(df: DataFrame) -> DataFrame:
    """Hash-partition by (store_nbr, family): satisfies every later window of a series, also
    those by its day of the year, with this single shuffle; a group is one series."""
    return df.repartition(*SERIES)


def partition_by_store(df: DataFrame) -> DataFrame:
    """Hash-partition by store_nbr: satisfies the windows of its series and of its dates with this
    single shuffle; a store of a panel holds at most dates x families rows."""
    return df.repartition("store_nbr")


def store_promo_window(df: DataFrame) -> DataFrame:
    """``df`` with total_other_promo_store, by a window over (store_nbr, date): the rows of
    ``store_promo_totals`` without a join. NULL where a key is NULL (join semantics)."""
    w = Window.partitionBy("store_nbr", "date")
    known = F.col("store_nbr").isNotNull() & F.col("date").isNotNull()
    return df.withColumn("total_other_promo_store", F.when(known, F.sum("onpromotion").over(w)))


def add_lags(df: DataFrame, column: str, lags: int, by=SERIES, order: str = "date") -> DataFrame:
    """``{column}_lag_k`` for k = 1..lags: the value k rows earlier in the series (by row)."""
    w = series_window(order, by)
    return df.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(w)
                           for k in range(1, lags + 1)})


def year_lag(df: DataFrame, column: str, by=SERIES, order: str = "date") -> DataFrame:
    """``{column}_one_year_lag``: previous row with the same series and dayofyear; NULL -> 0."""
    w = Window.partitionBy(*by, F.dayofyear(order).alias("_doy")).orderBy(order)
    return df.withColumn(f"{column}_one_year_lag",
                         F.coalesce(F.lag(column, 1).over(w), F.lit(0.0)).cast("double"))


def attach_lag_table(df: DataFrame, lags: DataFrame, keys=KEYS) -> DataFrame:
    """Left-join externally computed lag columns back on (date, store_nbr, family)."""
    return df.join(lags, list(keys), "left")


def rows_on_dates(df: DataFrame, dates: DataFrame, date_col: str = "date") -> DataFrame:
    """Keep the rows whose date is in ``dates`` (a semi-join; the date list is size-checked
    and broadcast, so the rows are not shuffled)."""
    from retailcast.operators.joins import bounded_broadcasts
    (d,) = bounded_broadcasts(dates.select(date_col).distinct())
    return df.join(d, date_col, "left_semi")


def row_sum(cols: list[str]) -> Column:
    """Horizontal sum skipping NULLs; all NULL gives 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def pivot_series(df: DataFrame, keys=("date", "store_nbr"), column: str = "family",
                 value: str = "sales", levels: list[str] | None = None) -> DataFrame:
    """One column per level of ``column`` (its sum of ``value``); one row per ``keys``.

    A column per level needs the levels: they are read from ``df`` unless given.
    """
    if levels is None:
        levels = sorted(r[0] for r in df.select(column).distinct().collect())
    return df.groupBy(*keys).pivot(column, levels).agg(F.sum(value))


def unpivot_series(wide: DataFrame, keys=("date", "store_nbr"), column: str = "family",
                   value: str = "sales") -> DataFrame:
    """Back to one row per (keys, level); cells without a value are left out."""
    levels = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), levels, column, value).filter(F.col(value).isNotNull())


def promo_last_days(df: DataFrame, prefix: str = "onpromotion_lag",
                    name: str = "promo_last_7_days") -> DataFrame:
    return df.withColumn(name, row_sum(columns_with_prefix(df, prefix)).cast("double"))


def union_panel(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows and test rows in one frame; test has ``sales`` NULL and is_test true."""
    return (train.withColumn("is_test", F.lit(False))
            .unionByName(test.withColumn("is_test", F.lit(True)), allowMissingColumns=True))


def dedup_last(df: DataFrame, key: str = "date", order=("store_nbr", "family")) -> DataFrame:
    """Keep one row per ``key``: the one that sorts last by ``order`` (keep='last').

    Written as a max over a struct -- a partial aggregate, so a hot key is
    combined map-side instead of being sorted in one window task.
    """
    payload = [c for c in df.columns if c != key]
    best = F.max(F.struct(*[F.col(c) for c in order],
                          *[F.col(c) for c in payload if c not in order])).alias("_m")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_m.{c}").alias(c) for c in payload])


def densify(df: DataFrame, by=SERIES, order: str = "date") -> DataFrame:
    """Insert the missing calendar days of every series between its first and last day."""
    span = df.groupBy(*by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    days = span.select(*by, F.explode(F.sequence("_lo", "_hi")).alias(order))
    return days.join(df, [*by, order], "left")


def assert_unique_keys(df: DataFrame, keys=KEYS) -> None:
    """Raise if a key occurs twice (lag order would be undefined)."""
    dup = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key rows, e.g. {dup[0]}")
