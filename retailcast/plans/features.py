"""The feature-table plan: stores, promotion totals, calendar, oil, date parts, lags.

The daily panel (train and test rows together) is aggregated once and written to the shared
folder; dates, city totals and the main plan read it from there. Its narrow rows are shuffled once, by
store_nbr, for the store's promotion totals and all per-series windows; what is joined by broadcast after
a check of its bytes (store, calendar and city tables) comes behind the windows, so that no sort holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.functions.dates import date_parts
from retailcast.operators.calendar import calendar_dims, join_calendar_dims
from retailcast.operators.joins import bounded_broadcasts, materialize
from retailcast.operators.panel import (add_lags, assert_unique_keys, city_promo_totals,
                                        partition_by_store, promo_last_days, promo_totals,
                                        store_promo_totals, store_promo_window, union_panel, year_lag)
from retailcast.operators.series import interpolate_linear, rolling_mean

# First date kept in X (after one year of history for the lags),
# number of lags, oil smoothing window.
FEATURE_START = "1996-01-01"
N_LAGS = 7
OIL_WINDOW = 30
KEY_COLUMNS = ["id", "store_nbr", "family"]

FEATURES = sorted(
    ["Change_in_oil_prices", "city", "day", "dayofyear", "dcoilwtico", "event", "holiday",
     "holiday_description", "month", "onpromotion", "payday", "promo_last_7_days",
     "sales_one_year_lag", "state", "time_since_quake", "time_since_quake_sq",
     "total_other_city_promo", "total_other_promo_store", "type", "workday", "year"]
    + [f"dcoilwtico_lag_{k}" for k in range(1, N_LAGS + 1)]
    + [f"onpromotion_lag_{k}" for k in range(1, N_LAGS + 1)])


def oil_series(dates: DataFrame, oil: DataFrame, window: int = OIL_WINDOW) -> DataFrame:
    """Oil price on every panel date: linear gap fill, then a ``window``-day mean.

    Runs on the one-row-per-date table (bounded by calendar days) before the
    join to the panel, as one continuous series.
    """
    days = dates.select("date").distinct()
    s = days.join(oil.select("date", "dcoilwtico"), "date", "left")
    s = interpolate_linear(s, "dcoilwtico", "date")
    return rolling_mean(s, "dcoilwtico", window, 1, "date")


def promo_panel(panel: DataFrame, stores: DataFrame) -> DataFrame:
    """The (written) union panel + store attributes + promotion totals."""
    (stores_b,) = bounded_broadcasts(stores.drop("cluster"))
    with_stores = panel.join(stores_b, "store_nbr", "left")
    city, store = bounded_broadcasts(city_promo_totals(with_stores), store_promo_totals(panel))
    return promo_totals(with_stores, city_totals=city, store_totals=store)


def feature_table(train: DataFrame, test: DataFrame, stores: DataFrame, oil: DataFrame,
                  holidays: DataFrame, start: str = FEATURE_START,
                  with_target: bool = False) -> DataFrame:
    """X and X_test in one frame (``is_test``), keys + the 35 features, from ``start``."""
    panel = materialize(union_panel(train, test), "panel")
    return features_of_panel(panel, stores, oil, holidays, start, with_target)


def features_of_panel(panel: DataFrame, stores: DataFrame, oil: DataFrame, holidays: DataFrame,
                      start: str = FEATURE_START, with_target: bool = False) -> DataFrame:
    """The feature table of a written union panel; raises where a key occurs twice.

    ``with_target`` keeps ``sales`` (NULL on test rows): X and y in one table.
    """
    assert_unique_keys(panel)
    (stores_b,) = bounded_broadcasts(stores.drop("cluster"))
    with_stores = panel.join(stores_b, "store_nbr", "left")
    oil_b, city_b, by_date, loc, reg = bounded_broadcasts(
        oil_series(panel, oil), city_promo_totals(with_stores), *calendar_dims(holidays))
    promo = F.col("onpromotion").cast("double")
    x = store_promo_window(partition_by_store(panel)).join(oil_b, "date", "left")
    x = year_lag(x.withColumn("onpromotion", promo), "sales")
    x = add_lags(x, "onpromotion", N_LAGS)
    x = add_lags(x, "dcoilwtico", N_LAGS)
    x = x.filter(F.col("date") >= F.lit(start).cast("date"))
    x = x.join(stores_b, "store_nbr", "left").join(city_b, ["date", "city", "family"], "left")
    x = date_parts(join_calendar_dims(x, by_date, loc, reg))
    x = x.withColumns({c: F.col(c).cast("double") for c in ("total_other_promo_store", "total_other_city_promo")})
    x = x.withColumn("Change_in_oil_prices", F.col("dcoilwtico") - F.col("dcoilwtico_lag_1"))
    x = promo_last_days(x)
    return x.select("date", *KEY_COLUMNS, *FEATURES, "is_test",
                    *(["sales"] if with_target else []))
