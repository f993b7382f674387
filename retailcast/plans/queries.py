"""Registered queries: each is (spark, sf_dir) -> DataFrame plus its DuckDB oracle SQL.

Every query reads the driver tables through the stand-in builders and runs
the library operator it is named after over the whole tables.  Float outputs
are rounded so the oracle comparison hashes equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.functions.dates import date_parts
from retailcast.operators import calendar as cal
from retailcast.operators import long_series
from retailcast.operators import panel as pn
from retailcast.operators.joins import join_dimension, materialize
from retailcast.operators.series import interpolate_linear
from retailcast.plans import features as ft
from retailcast.plans.oracle import with_ctes
from retailcast.sources import standins as si

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r(c: str, digits: int) -> F.Column:
    """round(x * 10^d) / 10^d: resolves .5 ties the same way as the oracle SQL."""
    scale = 10.0 ** digits
    return (F.round(F.col(c) * scale) / scale).alias(c)


def rnd(c: str, digits: int) -> str:
    return f"round({c} * {10 ** digits}.0) / {10 ** digits}.0"


def _upanel(spark, sf_dir):
    """Train and test rows together, from one scan of the sales lines."""
    return si.daily_panel(spark, sf_dir)


def _written_panel(spark, sf_dir):
    """The daily panel aggregated once, for plans that read it several times."""
    return materialize(_upanel(spark, sf_dir), "panel")


# ------------------------------------------------------------------ panel basics
@query("q_union_panel", with_ctes(
    "SELECT id, date, store_nbr, family, is_test, " + rnd("sales", 4) + " AS sales, onpromotion "
    "FROM upanel", "upanel"))
def q_union_panel(spark, sf_dir):
    p = pn.union_panel(si.train_frame(spark, sf_dir), si.test_frame(spark, sf_dir))
    return p.select("id", "date", "store_nbr", "family", "is_test", _r("sales", 4), "onpromotion")


@query("q_store_join", with_ctes(
    "SELECT date, store_nbr, family, city, state, type FROM upanel "
    "LEFT JOIN stores USING (store_nbr)", "upanel", "stores"))
def q_store_join(spark, sf_dir):
    p = pn.store_join(_upanel(spark, sf_dir), si.stores(spark, sf_dir))
    return p.select("date", "store_nbr", "family", "city", "state", "type")


@query("q_promo_totals", with_ctes(
    "SELECT date, store_nbr, family, CAST(total_other_promo_store AS BIGINT) "
    "AS total_other_promo_store, CAST(total_other_city_promo AS BIGINT) AS total_other_city_promo "
    "FROM ppanel", "ppanel"))
def q_promo_totals(spark, sf_dir):
    p = ft.promo_panel(_written_panel(spark, sf_dir), si.stores(spark, sf_dir))
    return p.select("date", "store_nbr", "family", "total_other_promo_store",
                    "total_other_city_promo")


@query("q_date_parts", with_ctes(
    "SELECT date, store_nbr, family, isodow(date) - 1 AS day, dayofyear(date) AS dayofyear, "
    "month(date) AS month, year(date) AS year, "
    "(day(date) = 15 OR date = last_day(date)) AS payday FROM upanel", "upanel"))
def q_date_parts(spark, sf_dir):
    p = date_parts(_upanel(spark, sf_dir))
    return p.select("date", "store_nbr", "family", "day", "dayofyear", "month", "year", "payday")


# ------------------------------------------------------------------ calendar
@query("q_calendar_split", with_ctes("""
SELECT 'bridge' AS kind, date, CAST(NULL AS VARCHAR) AS locale_name,
       CAST(NULL AS VARCHAR) AS description FROM c_bridge
UNION ALL SELECT 'event', date, NULL, description FROM c_event
UNION ALL SELECT 'quake', date, NULL, CAST(time_since_quake AS VARCHAR) FROM c_quake
UNION ALL SELECT 'national', date, NULL, description FROM c_national
UNION ALL SELECT 'local', date, locale_name, description FROM c_local
UNION ALL SELECT 'regional', date, locale_name, description FROM c_regional""",
    "c_bridge", "c_event", "c_quake", "c_national", "c_local", "c_regional"))
def q_calendar_split(spark, sf_dir):
    return cal.calendar_rows(cal.split_calendar(si.holidays_events(spark, sf_dir)))


@query("q_calendar_flags", with_ctes(
    "SELECT date, store_nbr, family, holiday, holiday_description, event, time_since_quake, "
    "time_since_quake_sq, workday FROM calpanel", "calpanel"))
def q_calendar_flags(spark, sf_dir):
    p = pn.store_join(_upanel(spark, sf_dir), si.stores(spark, sf_dir))
    p = cal.attach_calendar(p, si.holidays_events(spark, sf_dir))
    return p.select("date", "store_nbr", "family", "holiday", "holiday_description", "event",
                    "time_since_quake", "time_since_quake_sq", "workday")


@query("q_calendar_fanout", with_ctes("""
SELECT p.date, COUNT(*) AS n_rows
FROM spanel p
LEFT JOIN c_national n ON p.date = n.date
LEFT JOIN c_bridge b ON p.date = b.date
LEFT JOIN c_local l ON p.date = l.date AND p.city = l.locale_name
LEFT JOIN c_regional r ON p.date = r.date AND p.state = r.locale_name
LEFT JOIN c_event e ON p.date = e.date
LEFT JOIN c_quake q ON p.date = q.date
GROUP BY p.date""", "spanel", "c_national", "c_bridge", "c_local", "c_regional", "c_event",
    "c_quake"))
def q_calendar_fanout(spark, sf_dir):
    p = pn.store_join(_upanel(spark, sf_dir), si.stores(spark, sf_dir))
    return cal.fanout_counts(p, si.holidays_events(spark, sf_dir))


def _r46(c: str) -> F.Column:
    """Round to 6, then to 4 digits: sums in another order differ far behind, and ties at 4 digits
    (means of cents have many) then fall the same way as in the oracle SQL."""
    return (F.round(F.round(F.col(c) * 1e6) / 1e6 * 1e4) / 1e4).alias(c)


def rnd46(c: str) -> str:
    return rnd(rnd(c, 6), 4)


# ------------------------------------------------------------------ oil series
@query("q_oil_interp", with_ctes(
    "SELECT date, " + rnd("dcoilwtico", 4) + " AS dcoilwtico FROM oil_interp", "oil_interp"))
def q_oil_interp(spark, sf_dir):
    days = _upanel(spark, sf_dir).select("date").distinct()
    s = days.join(si.oil(spark, sf_dir), "date", "left")
    return interpolate_linear(s, "dcoilwtico", "date").select("date", _r("dcoilwtico", 4))


@query("q_oil_smooth", with_ctes(
    "SELECT date, " + rnd46("dcoilwtico") + " AS dcoilwtico FROM oil_smooth", "oil_smooth"))
def q_oil_smooth(spark, sf_dir):
    s = ft.oil_series(_upanel(spark, sf_dir), si.oil(spark, sf_dir))
    return s.select("date", _r46("dcoilwtico"))


@query("q_oil_ranges", with_ctes(
    "SELECT i.date, " + rnd("i.dcoilwtico", 4) + " AS filled, " + rnd46("s.dcoilwtico") + " AS dcoilwtico FROM oil_interp i JOIN oil_smooth s ON i.date = s.date",
    "oil_interp", "oil_smooth"))
def q_oil_ranges(spark, sf_dir):
    """The oil series filled and smoothed as a series of any length: 50 ranges, carried over blocks of 64 rows."""
    days = _upanel(spark, sf_dir).select("date").distinct()
    s = days.join(si.oil(spark, sf_dir), "date", "left").select("date", "dcoilwtico")
    filled = long_series.interpolate_linear(s, "dcoilwtico", "date", "filled", ranges=50, block_rows=64)
    smooth = long_series.rolling_mean(filled, "filled", ft.OIL_WINDOW, 1, "date", "smooth", ranges=50, block_rows=64)
    return smooth.select("date", _r("filled", 4), F.col("smooth").alias("dcoilwtico")).select("date", "filled", _r46("dcoilwtico"))


# ------------------------------------------------------------------ lags
_LAG_COLS = ([f"onpromotion_lag_{k}" for k in range(1, 8)]
             + [f"dcoilwtico_lag_{k}" for k in range(1, 8)] + ["Change_in_oil_prices"])


@query("q_lags", with_ctes(
    "SELECT date, store_nbr, family, "
    + ", ".join(f"{rnd46(c)} AS {c}" for c in _LAG_COLS)
    + " FROM (SELECT *, dcoilwtico - dcoilwtico_lag_1 AS Change_in_oil_prices "
      "FROM features_all) f", "features_all"))
def q_lags(spark, sf_dir):
    p = _written_panel(spark, sf_dir)
    oil = ft.oil_series(p, si.oil(spark, sf_dir))
    p = join_dimension(pn.partition_by_series(p), oil, "date")
    p = p.withColumn("onpromotion", F.col("onpromotion").cast("double"))
    p = pn.add_lags(p, "onpromotion", 7)
    p = pn.add_lags(p, "dcoilwtico", 7)
    p = p.withColumn("Change_in_oil_prices", F.col("dcoilwtico") - F.col("dcoilwtico_lag_1"))
    return p.select("date", "store_nbr", "family", *[_r46(c) for c in _LAG_COLS])


@query("q_year_lag", with_ctes(
    "SELECT date, store_nbr, family, " + rnd("sales_one_year_lag", 4) + " AS sales_one_year_lag "
    "FROM features_all", "features_all"))
def q_year_lag(spark, sf_dir):
    p = pn.year_lag(pn.partition_by_series(_upanel(spark, sf_dir)), "sales")
    return p.select("date", "store_nbr", "family", _r("sales_one_year_lag", 4))


@query("q_promo7", with_ctes(
    "SELECT date, store_nbr, family, promo_last_7_days FROM features", "features"))
def q_promo7(spark, sf_dir):
    p = _upanel(spark, sf_dir).withColumn("onpromotion", F.col("onpromotion").cast("double"))
    p = pn.promo_last_days(pn.add_lags(p, "onpromotion", 7))
    p = p.filter(F.col("date") >= F.lit(ft.FEATURE_START).cast("date"))
    return p.select("date", "store_nbr", "family", "promo_last_7_days")


# ------------------------------------------------------------------ feature table
_ROUND4 = {"Change_in_oil_prices", "dcoilwtico", "sales_one_year_lag", *[f"dcoilwtico_lag_{k}" for k in range(1, 8)]}


def _feature_select(cols):
    out = []
    for c in cols:
        if c in _ROUND4:
            out.append(f"{rnd46(c)} AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


def _feature_table(spark, sf_dir, with_target: bool = False):
    return ft.features_of_panel(_written_panel(spark, sf_dir), si.stores(spark, sf_dir),
                                si.oil(spark, sf_dir), si.holidays_events(spark, sf_dir),
                                with_target=with_target)


_FT_COLS = ["date", *ft.KEY_COLUMNS, *ft.FEATURES, "is_test"]


@query("q_feature_table", with_ctes(
    f"SELECT {_feature_select(_FT_COLS)} FROM features", "features"))
def q_feature_table(spark, sf_dir):
    x = _feature_table(spark, sf_dir)
    return x.select(*[_r46(c) if c in _ROUND4 else F.col(c) for c in _FT_COLS])


@query("q_head", with_ctes(
    f"SELECT {_feature_select(_FT_COLS)} FROM features "
    "ORDER BY store_nbr, family, date LIMIT 5", "features"))
def q_head(spark, sf_dir):
    """Preview: the first five rows in (store_nbr, family, date) order (the limit is the feature)."""
    return q_feature_table(spark, sf_dir).orderBy("store_nbr", "family", "date").limit(5)


@query("q_dedup_last", with_ctes("""
SELECT date, store_nbr, family, onpromotion FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY store_nbr DESC, family DESC) AS rn
  FROM upanel) d WHERE rn = 1""", "upanel"))
def q_dedup_last(spark, sf_dir):
    p = _upanel(spark, sf_dir).select("date", "store_nbr", "family", "onpromotion")
    return pn.dedup_last(p, "date", ("store_nbr", "family"))


# the model, validation and I/O queries register themselves on import
from retailcast.plans import model_queries  # noqa: E402,F401
