"""Calendar expressions: date parts, payday, workday, calendar Fourier terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday0(d) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6 (not Spark's 1-based dayofweek)."""
    return F.weekday(_c(d))


def payday(d) -> Column:
    """Paid on the 15th and on the last day of each month."""
    d = _c(d)
    return (F.dayofmonth(d) == 15) | (d == F.last_day(d))


def workday(day: Column, holiday: Column, bridge: Column) -> Column:
    """No bridge day, no holiday, and not Saturday (5) or Sunday (6)."""
    return bridge.isNull() & ~holiday & ~day.isin(5, 6)


def date_parts(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns({
        "day": weekday0(d),
        "dayofyear": F.dayofyear(d),
        "month": F.month(d),
        "year": F.year(d),
        "payday": payday(d),
    })


def fourier_terms(d, freq: str = "W", order: int = 2, prefix: str = "") -> dict[str, Column]:
    """sin/cos(2*pi*k*r) for k = 1..order, r = fraction of the period elapsed at ``d``.

    Weekly: r = weekday / 7.  Monthly: (day - 1) / days in month.  Quarterly:
    days since quarter start / days in quarter.  Yearly (annual): (dayofyear - 1) /
    days in year.
    """
    d = _c(d)
    if freq == "W":
        r = weekday0(d) / F.lit(7.0)
    elif freq in ("M", "MS"):
        r = (F.dayofmonth(d) - 1) / F.dayofmonth(F.last_day(d)).cast("double")
    elif freq in ("Q", "QS"):
        qs = F.make_date(F.year(d), (F.quarter(d) - 1) * 3 + 1, F.lit(1))
        qe = F.add_months(qs, 3)
        r = F.datediff(d, qs) / F.datediff(qe, qs).cast("double")
    elif freq in ("A", "Y", "YS", "AS"):
        ys = F.make_date(F.year(d), F.lit(1), F.lit(1))
        r = F.datediff(d, ys) / F.datediff(F.add_months(ys, 12), ys).cast("double")
    else:
        raise ValueError(f"unsupported Fourier frequency {freq!r}")
    out = {}
    for k in range(1, order + 1):
        ang = F.lit(2 * math.pi * k) * r
        out[f"{prefix}sin({k},freq={freq})"] = F.sin(ang)
        out[f"{prefix}cos({k},freq={freq})"] = F.cos(ang)
    return out
