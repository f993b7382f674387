"""Golden micro-fixtures: lags, year lag, promotion sums, interpolation, rolling mean."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import D
from retailcast.operators import panel as pn
from retailcast.operators.series import interpolate_linear, rolling_mean


def _series(spark, rows, cols="date date, store_nbr long, family string, v double"):
    return spark.createDataFrame(rows, cols)


def test_lag_by_row_not_by_day(spark):
    df = _series(spark, [(D("2020-01-01"), 1, "A", 1.0), (D("2020-01-02"), 1, "A", 2.0),
                         (D("2020-01-05"), 1, "A", 5.0)])
    out = pn.add_lags(df, "v", 2).orderBy("date").collect()
    assert [r.v_lag_1 for r in out] == [None, 1.0, 2.0]
    assert [r.v_lag_2 for r in out] == [None, None, 1.0]


def test_year_lag_and_leap_day(spark):
    df = spark.createDataFrame(
        [(D("2015-03-01"), 1, "A", 10.0), (D("2016-02-29"), 1, "A", 20.0),
         (D("2017-03-01"), 1, "A", 30.0), (D("2017-03-01"), 2, "A", 7.0)],
        "date date, store_nbr long, family string, sales double")
    out = {(r.store_nbr, r.date): r.sales_one_year_lag
           for r in pn.year_lag(df, "sales").collect()}
    # 2015-03-01 is day 60, 2016-02-29 is day 60, 2017-03-01 is day 60
    assert out[(1, D("2015-03-01"))] == 0.0
    assert out[(1, D("2016-02-29"))] == 10.0
    assert out[(1, D("2017-03-01"))] == 20.0
    assert out[(2, D("2017-03-01"))] == 0.0


def test_promo7_nulls(spark):
    df = spark.createDataFrame([(None, None, None), (1.0, None, 2.0)],
                               "onpromotion_lag_1 double, onpromotion_lag_2 double, "
                               "onpromotion_lag_3 double")
    assert [r.promo_last_7_days for r in pn.promo_last_days(df).collect()] == [0.0, 3.0]


def test_promo_totals_include_self_and_exclude_option(spark):
    df = spark.createDataFrame(
        [(D("2020-01-01"), 1, "A", "X", 2), (D("2020-01-01"), 1, "B", "X", 3),
         (D("2020-01-01"), 2, "A", "X", 5), (D("2020-01-01"), 3, "A", None, 7)],
        "date date, store_nbr long, family string, city string, onpromotion long")
    out = {(r.store_nbr, r.family): r for r in pn.promo_totals(df).collect()}
    assert out[(1, "A")].total_other_promo_store == 5
    assert out[(1, "A")].total_other_city_promo == 7
    assert out[(3, "A")].total_other_city_promo is None  # NULL city -> NULL (join semantics)
    ex = {(r.store_nbr, r.family): r for r in pn.promo_totals(df, exclude_self=True).collect()}
    assert ex[(1, "A")].total_other_promo_store == 3


def test_dedup_last_keeps_larger_key(spark):
    df = _series(spark, [(D("2020-01-01"), 1, "A", 1.0), (D("2020-01-01"), 2, "A", 2.0),
                         (D("2020-01-02"), 1, "B", 3.0)])
    out = {r.date: r.v for r in pn.dedup_last(df, "date", ("store_nbr", "family")).collect()}
    assert out == {D("2020-01-01"): 2.0, D("2020-01-02"): 3.0}


def test_union_panel_and_densify(spark):
    tr = spark.createDataFrame([(1, D("2020-01-01"), 1, "A", 3.0, 1)],
                               "id long, date date, store_nbr long, family string, "
                               "sales double, onpromotion long")
    te = spark.createDataFrame([(2, D("2020-01-03"), 1, "A", 0)],
                               "id long, date date, store_nbr long, family string, "
                               "onpromotion long")
    u = pn.union_panel(tr, te)
    rows = {r.id: r for r in u.collect()}
    assert rows[2].sales is None and rows[2].is_test and not rows[1].is_test
    dense = pn.densify(u.drop("id"))
    assert dense.count() == 3


def _vals(df, col):
    return [r[col] for r in df.orderBy("date").collect()]


def test_interpolation_both_directions(spark):
    days = [D(f"2020-01-0{i}") for i in range(1, 6)]
    df = spark.createDataFrame(list(zip(days, [None, 1.0, None, 3.0, None])),
                               "date date, v double")
    assert _vals(interpolate_linear(df, "v"), "v") == [1.0, 1.0, 2.0, 3.0, 3.0]
    nulls = spark.createDataFrame([(d, None) for d in days], "date date, v double")
    assert _vals(interpolate_linear(nulls, "v"), "v") == [None] * 5


def test_interpolation_uneven_gap_matches_pandas(spark):
    import pandas as pd
    vals = [2.0, None, None, 8.0, None, 1.0]
    days = [D(f"2020-01-0{i}") for i in range(1, 7)]
    df = spark.createDataFrame(list(zip(days, vals)), "date date, v double")
    ours = _vals(interpolate_linear(df, "v"), "v")
    ref = pd.Series(vals).interpolate(method="linear", limit_direction="both").tolist()
    assert all(math.isclose(a, b) for a, b in zip(ours, ref))


def test_rolling_mean_min_periods(spark):
    days = [D(f"2020-01-0{i}") for i in range(1, 5)]
    df = spark.createDataFrame(list(zip(days, [None, 1.0, None, 3.0])), "date date, v double")
    assert _vals(rolling_mean(df, "v", 2, 1), "v") == [None, 1.0, 1.0, 3.0]


def test_partitioned_interpolation_per_series(spark):
    df = spark.createDataFrame([(D("2020-01-01"), "a", 1.0), (D("2020-01-02"), "a", None),
                                (D("2020-01-03"), "a", 3.0), (D("2020-01-02"), "b", None),
                                (D("2020-01-03"), "b", 9.0)], "date date, s string, v double")
    out = {(r.s, r.date): r.v for r in interpolate_linear(df, "v", partition_cols=["s"]).collect()}
    assert out[("a", D("2020-01-02"))] == 2.0
    assert out[("b", D("2020-01-02"))] == 9.0


def test_assert_unique_keys(spark):
    df = spark.createDataFrame([(D("2020-01-01"), 1, "A"), (D("2020-01-01"), 1, "A")],
                               "date date, store_nbr long, family string")
    try:
        pn.assert_unique_keys(df)
    except ValueError:
        return
    raise AssertionError("duplicate keys not detected")


def test_rows_on_dates_and_lag_table(spark):
    df = _series(spark, [(D("2020-01-01"), 1, "A", 1.0), (D("2020-01-02"), 1, "A", 2.0),
                         (D("2020-01-03"), 1, "A", 3.0)])
    keep = spark.createDataFrame([(D("2020-01-02"),), (D("2020-01-03"),), (D("2020-01-03"),)],
                                 "date date")
    assert sorted(r.v for r in pn.rows_on_dates(df, keep).collect()) == [2.0, 3.0]
    lags = pn.add_lags(df, "v", 1).select("date", "store_nbr", "family", "v_lag_1")
    back = pn.attach_lag_table(df.drop("v"), lags).orderBy("date").collect()
    assert [r.v_lag_1 for r in back] == [None, 1.0, 2.0]


@pytest.mark.parametrize("ranges, block", [(1, 1 << 17), (7, 5), (50, 1)])
def test_long_series_equal_the_one_task_ones(spark, ranges, block):
    from retailcast.operators import long_series as ls
    from retailcast.operators import series
    values = [None] * 9 + [4.0] + [None] * 23 + [1.5, 7.0, None, 2.0] + [float(i % 5) for i in range(20)] + [None] * 12
    df = spark.createDataFrame([(i * 3, v) for i, v in enumerate(values)], "t int, v double").repartition(3)
    for got, want in ((ls.interpolate_linear(df, "v", "t", ranges=ranges, block_rows=block), series.interpolate_linear(df, "v", "t")),
                      (ls.interpolate_linear(df, "v", "t", "w", ranges, block), series.interpolate_linear(df, "v", "t", out="w")),
                      (ls.rolling_mean(df, "v", 6, 2, "t", ranges=ranges, block_rows=block), series.rolling_mean(df, "v", 6, 2, "t")),
                      (ls.rolling_mean(df, "v", 30, 1, "t", "m", ranges, block), series.rolling_mean(df, "v", 30, 1, "t", out="m"))):
        assert got.columns == want.columns
        for a, b in zip(got.orderBy("t").collect(), want.orderBy("t").collect()):
            assert all(x == y or x == pytest.approx(y) for x, y in zip(a, b)), (a, b)
    none = spark.createDataFrame([(1, None), (2, None)], "t int, v double")
    assert [r["v"] for r in ls.interpolate_linear(none, "v", "t", ranges=2).collect()] == [None, None]
    assert ls.rolling_mean(none.limit(0), "v", 3, 1, "t").count() == 0
