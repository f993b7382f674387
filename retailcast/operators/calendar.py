"""Holiday calendar: split into its parts and attach flags to the panel.

Rules (fixed values of the job):
* rows with ``transferred`` true are dropped; NULL counts as not transferred
* type 'Transfer' is treated as 'Holiday'; only Holiday, Bridge and Event rows
  are used, other types are ignored
* an event whose description contains 'Terremoto Manabi' is an earthquake day;
  quake days are numbered 1, 2, ... in date order (time_since_quake) and are
  not events
* an event whose description contains 'futbol' becomes 'Sports'
* holiday_description = national || local || regional, NULL -> '', no separator
* holiday is true when any of the three is present
* workday: no bridge, no holiday, not Saturday or Sunday

By default every calendar part is reduced to one row per join key first
(descriptions of one key joined with '|' in sorted order), so attaching the
calendar never multiplies panel rows.  ``fanout_counts`` tells how many rows a
plain left join of the raw parts would give, without building it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.functions.dates import weekday0, workday
from retailcast.operators.joins import bounded_broadcasts

# Fixed values
QUAKE_TEXT = "Terremoto Manabi"
SPORTS_TEXT = "futbol"
SPORTS_LABEL = "Sports"
NO_EVENT = "none"
SEP = "|"


def split_calendar(hol: DataFrame) -> dict[str, DataFrame]:
    """Return the parts bridge, event, quake, national, local, regional (raw rows)."""
    hol = _kept(hol)
    bridge = (hol.filter(F.col("type") == "Bridge").select("date").distinct()
              .withColumn("bridge", F.lit(True)))
    events = hol.filter(F.col("type") == "Event").select("date", "description")
    is_quake = F.instr(F.col("description"), QUAKE_TEXT) > 0
    # one row per quake day; the numbering window runs over distinct calendar days only
    quake = (events.filter(is_quake).select("date").distinct()
             .withColumn("time_since_quake", F.row_number().over(Window.orderBy("date"))))
    event = events.filter(~is_quake).withColumn(
        "description", F.when(F.instr(F.col("description"), SPORTS_TEXT) > 0, SPORTS_LABEL)
        .otherwise(F.col("description")))
    holiday = hol.filter(F.col("type") == "Holiday")
    local = holiday.filter(F.col("locale") == "Local").select("date", "locale_name", "description")
    regional = holiday.filter(F.col("locale") == "Regional").select("date", "locale_name",
                                                                   "description")
    national = holiday.filter(F.col("locale") == "National").select("date", "description")
    return {"bridge": bridge, "event": event, "quake": quake, "national": national,
            "local": local, "regional": regional}


def calendar_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts in one long table (kind, date, locale_name, description)."""
    def part(name, df, locale=None, descr="description"):
        return df.select(F.lit(name).alias("kind"), "date",
                         (F.col("locale_name") if locale else F.lit(None).cast("string"))
                         .alias("locale_name"),
                         (F.col(descr) if descr else F.lit(None).cast("string"))
                         .alias("description"))
    return (part("bridge", parts["bridge"], descr=None)
            .unionByName(part("event", parts["event"]))
            .unionByName(part("quake", parts["quake"].withColumn(
                "description", F.col("time_since_quake").cast("string"))))
            .unionByName(part("national", parts["national"]))
            .unionByName(part("local", parts["local"], locale=True))
            .unionByName(part("regional", parts["regional"], locale=True)))


def _kept(hol: DataFrame) -> DataFrame:
    hol = hol.filter(~F.coalesce(F.col("transferred"), F.lit(False)))
    return hol.withColumn("type", F.when(F.col("type") == "Transfer", "Holiday")
                          .otherwise(F.col("type")))


def _descr_set(c) -> F.Column:
    """'|'-joined sorted distinct non-NULL values; NULL when there are none."""
    s = F.array_sort(F.collect_set(c))
    return F.when(F.size(s) > 0, F.array_join(s, SEP))


def calendar_dims(hol: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row per key from the raw holiday table.

    (date -> _nat, bridge, _event, time_since_quake) in a single aggregation
    plus one numbering window over the quake days of that one-row-per-date
    table; ((date, city) -> _loc) and ((date, state) -> _reg).
    """
    kept = _kept(hol)
    t, d = F.col("type"), F.col("description")
    is_event = t == "Event"
    is_quake = is_event & (F.instr(d, QUAKE_TEXT) > 0)
    event = F.when(is_event & ~is_quake,
                   F.when(F.instr(d, SPORTS_TEXT) > 0, SPORTS_LABEL).otherwise(d))
    holiday = t == "Holiday"
    by_date = kept.groupBy("date").agg(
        _descr_set(F.when(holiday & (F.col("locale") == "National"), d)).alias("_nat"),
        F.max(t == "Bridge").alias("_bridge"),
        _descr_set(event).alias("_event"),
        F.max(is_quake).alias("_quake"))
    by_date = by_date.filter(F.col("_nat").isNotNull() | F.col("_bridge")
                             | F.col("_event").isNotNull() | F.col("_quake"))
    running = F.sum(F.col("_quake").cast("int")).over(
        Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by_date = by_date.select(
        "date", "_nat", F.when(F.col("_bridge"), F.lit(True)).alias("bridge"), "_event",
        F.when(F.col("_quake"), running).cast("int").alias("time_since_quake"))
    hols = kept.filter(holiday)
    loc = hols.filter(F.col("locale") == "Local").groupBy(
        "date", F.col("locale_name").alias("city")).agg(_descr_set(d).alias("_loc"))
    reg = hols.filter(F.col("locale") == "Regional").groupBy(
        "date", F.col("locale_name").alias("state")).agg(_descr_set(d).alias("_reg"))
    return by_date, loc, reg


def join_calendar_dims(panel: DataFrame, by_date: DataFrame, loc: DataFrame, reg: DataFrame,
                       keep_bridge: bool = False) -> DataFrame:
    """Left-join the (already size-checked) calendar dims and derive the flags."""
    out = (panel.join(by_date, "date", "left").join(loc, ["date", "city"], "left")
           .join(reg, ["date", "state"], "left"))
    return calendar_flags(out, keep_bridge)


def attach_calendar(panel: DataFrame, holidays: DataFrame, keep_bridge: bool = False) -> DataFrame:
    """Add holiday, holiday_description, event, time_since_quake(_sq), workday.

    ``panel`` needs date, city and state.  Calendar tables are keyed by date or
    (date, place) and bounded by the calendar, so they are broadcast after a
    size check.
    """
    return join_calendar_dims(panel, *bounded_broadcasts(*calendar_dims(holidays)),
                              keep_bridge=keep_bridge)


def fanout_counts(panel: DataFrame, holidays: DataFrame) -> DataFrame:
    """(date, n_rows): rows that a plain left join of the raw calendar parts would give.

    The join is never built: each part is counted by its key, and a panel row counts as the
    product of its keys' counts (1 where there is none).
    """
    parts = split_calendar(holidays)

    def counts(name: str, n: str, *on) -> DataFrame:
        return parts[name].groupBy("date", *on).agg(F.count(F.lit(1)).alias(n))
    by_date = None
    for name in ("national", "bridge", "event", "quake"):
        c = counts(name, f"_{name}")
        by_date = c if by_date is None else by_date.join(c, "date", "full")
    loc = counts("local", "_local", F.col("locale_name").alias("city"))
    reg = counts("regional", "_regional", F.col("locale_name").alias("state"))
    by_date, loc, reg = bounded_broadcasts(by_date, loc, reg)
    keys = panel.groupBy("date", "city", "state").agg(F.count(F.lit(1)).alias("_rows"))
    out = (keys.join(by_date, "date", "left").join(loc, ["date", "city"], "left")
           .join(reg, ["date", "state"], "left"))
    n = F.col("_rows")
    for c in ("_national", "_bridge", "_event", "_quake", "_local", "_regional"):
        n = n * F.coalesce(F.col(c), F.lit(1))
    return out.groupBy("date").agg(F.sum(n).alias("n_rows"))


def calendar_flags(out: DataFrame, keep_bridge: bool = False) -> DataFrame:
    hol = F.col("_nat").isNotNull() | F.col("_loc").isNotNull() | F.col("_reg").isNotNull()
    descr = F.concat(F.coalesce(F.col("_nat"), F.lit("")), F.coalesce(F.col("_loc"), F.lit("")),
                     F.coalesce(F.col("_reg"), F.lit("")))
    tsq = F.coalesce(F.col("time_since_quake"), F.lit(0)).cast("int")
    out = out.withColumns({
        "holiday": hol,
        "holiday_description": descr,
        "event": F.coalesce(F.col("_event"), F.lit(NO_EVENT)),
        "time_since_quake": tsq,
    })
    out = out.withColumns({
        "time_since_quake_sq": F.col("time_since_quake") * F.col("time_since_quake"),
        "workday": workday(weekday0("date"), F.col("holiday"), F.col("bridge")),
    })
    out = out.drop("_nat", "_loc", "_reg", "_event")
    return out if keep_bridge else out.drop("bridge")
