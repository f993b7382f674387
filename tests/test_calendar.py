"""Golden micro-fixtures for the calendar rules."""

from conftest import D
from retailcast.functions.dates import date_parts
from retailcast.operators.calendar import attach_calendar, fanout_counts, calendar_rows, split_calendar

HOL = "date date, type string, locale string, locale_name string, description string, " \
      "transferred boolean"
PANEL = "date date, store_nbr long, family string, city string, state string"


def _hol(spark, rows):
    return spark.createDataFrame(rows, HOL)


def _panel(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def test_transferred_and_transfer_type(spark):
    hol = _hol(spark, [
        (D("2020-01-01"), "Holiday", "National", "Ecuador", "Dropped", True),
        (D("2020-01-02"), "Holiday", "National", "Ecuador", "Kept", False),
        (D("2020-01-03"), "Holiday", "National", "Ecuador", "NullKept", None),
        (D("2020-01-04"), "Transfer", "National", "Ecuador", "Moved", False),
        (D("2020-01-05"), "Additional", "National", "Ecuador", "Ignored", False)])
    nat = {r.description for r in split_calendar(hol)["national"].collect()}
    assert nat == {"Kept", "NullKept", "Moved"}


def test_description_concat_and_flag(spark):
    hol = _hol(spark, [
        (D("2020-01-01"), "Holiday", "National", "Ecuador", "N", False),
        (D("2020-01-02"), "Holiday", "National", "Ecuador", "N", False),
        (D("2020-01-02"), "Holiday", "Local", "Quito", "L", False)])
    panel = _panel(spark, [(D("2020-01-01"), 1, "A", "Quito", "P"),
                           (D("2020-01-02"), 1, "A", "Quito", "P"),
                           (D("2020-01-03"), 1, "A", "Quito", "P")])
    out = {r.date: r for r in attach_calendar(panel, hol).collect()}
    assert out[D("2020-01-01")].holiday_description == "N"
    assert out[D("2020-01-02")].holiday_description == "NL"
    assert out[D("2020-01-03")].holiday_description == ""
    assert out[D("2020-01-03")].holiday is False and out[D("2020-01-01")].holiday is True


def test_two_nationals_no_fanout_by_default(spark):
    hol = _hol(spark, [(D("2020-01-01"), "Holiday", "National", "Ecuador", "B", False),
                       (D("2020-01-01"), "Holiday", "National", "Ecuador", "A", False)])
    panel = _panel(spark, [(D("2020-01-01"), 1, "A", "Quito", "P")])
    rows = attach_calendar(panel, hol).collect()
    assert len(rows) == 1 and rows[0].holiday_description == "A|B"
    assert fanout_counts(panel, hol).collect()[0].n_rows == 2


def test_quake_numbering_and_sports(spark):
    hol = _hol(spark, [
        (D("2016-04-16"), "Event", "National", "Ecuador", "Terremoto Manabi", False),
        (D("2016-04-17"), "Event", "National", "Ecuador", "Terremoto Manabi+1", False),
        (D("2016-04-18"), "Event", "National", "Ecuador", "Terremoto Manabi+2", False),
        (D("2016-06-01"), "Event", "National", "Ecuador", "Mundial de futbol", False)])
    days = ["2016-04-15", "2016-04-16", "2016-04-17", "2016-04-18", "2016-06-01"]
    panel = _panel(spark, [(D(d), 1, "A", "Quito", "P") for d in days])
    out = {str(r.date): r for r in attach_calendar(panel, hol).collect()}
    assert [out[d].time_since_quake for d in days] == [0, 1, 2, 3, 0]
    assert out["2016-04-18"].time_since_quake_sq == 9
    assert out["2016-04-16"].event == "none"
    assert out["2016-06-01"].event == "Sports"
    assert out["2016-04-15"].event == "none"
    kinds = {r.kind for r in calendar_rows(split_calendar(hol)).collect()}
    assert kinds == {"quake", "event"}


def test_workday(spark):
    hol = _hol(spark, [(D("2020-01-03"), "Bridge", "National", "Ecuador", "Puente", False),
                       (D("2020-01-06"), "Holiday", "Regional", "P", "R", False)])
    days = {"2020-01-04": False, "2020-01-03": False, "2020-01-06": False, "2020-01-13": True}
    panel = _panel(spark, [(D(d), 1, "A", "Quito", "P") for d in days])
    out = {str(r.date): r.workday for r in attach_calendar(panel, hol).collect()}
    assert out == days


def test_payday_and_weekday(spark):
    days = ["2020-01-15", "2021-02-28", "2020-02-28", "2020-02-29", "2020-04-30", "2020-04-14",
            "2024-01-01", "2024-01-06"]
    df = spark.createDataFrame([(D(d),) for d in days], "date date")
    out = {str(r.date): r for r in date_parts(df).collect()}
    assert out["2020-01-15"].payday and out["2021-02-28"].payday and out["2020-02-29"].payday
    assert not out["2020-02-28"].payday and out["2020-04-30"].payday
    assert not out["2020-04-14"].payday
    assert out["2024-01-01"].day == 0 and out["2024-01-06"].day == 5
