import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from model import month_shift
from pyspark.sql import functions as F

from slotwise.functions import clock, text
from slotwise.functions.draw import draw, letters


def test_month_ends(spark):
    days = [dt.date(2021, 2, 28), dt.date(2020, 2, 29), dt.date(2024, 1, 30), dt.date(2023, 6, 1)]
    df = spark.createDataFrame([(d, m) for d in days for m in (1, 12, 36, 11988)], "d date, m int")
    for d, m, got in df.select("d", "m", clock.add_months(F.col("d"), F.col("m"))).collect():
        assert got == month_shift(d, m), (d, m)
    assert month_shift(dt.date(2021, 2, 28), 36) == dt.date(2024, 2, 29)


def test_age_is_half_open(spark):
    df = spark.createDataFrame(
        [(dt.date(2020, 5, 10),), (dt.date(2020, 5, 11),), (dt.date(2017, 5, 10),)], "b date"
    )
    within = clock.age_within(F.col("b"), F.lit(1), F.lit(4), dt.datetime(2021, 5, 10, 0, 0))
    assert [r[0] for r in df.select(within).collect()] == [True, False, False]


@settings(max_examples=50, deadline=None)
@given(st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2050, 1, 1)), st.integers(1, 7))
def test_week_day(moment, start):
    day = clock.week_day(moment, start)
    assert 1 <= day <= 7
    assert (day == 1) == (moment.isoweekday() == start)


def test_glue_skips_null_and_blank_is_null(spark):
    df = spark.createDataFrame([("a", None), ("", "b")], "x string, y string")
    assert [r[0] for r in df.select(text.glue(F.col("x"), 1, F.col("y"))).collect()] == ["a1", "1b"]
    assert [tuple(r) for r in text.blank_to_null(df).collect()] == [("a", None), (None, "b")]


def test_draw_is_repeatable_and_even(spark):
    df = spark.range(100000).select(
        draw(F.col("id"), 1, 0, 10).alias("a"), draw(F.col("id"), 2, 0, 10).alias("b")
    )
    counts = {tuple(r)[:2]: r["count"] for r in df.groupBy("a", "b").count().collect()}
    assert len(counts) == 100 and 700 < min(counts.values()) and max(counts.values()) < 1300
    word = letters(F.lit(7), 50, 8)
    first, second = spark.range(2).select(word).collect()
    assert first == second and len(first[0]) == 8 and first[0].isalpha()


def test_clock_columns_agree_with_constants(spark):
    moments = [dt.datetime(2024, 5, 12, 0, 5), dt.datetime(2024, 2, 29, 22, 30)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    t = F.col("t")
    found = df.select(
        "t",
        clock.clock_text_of(t),
        clock.week_day_of(t),
        clock.week_day_of(t, 7),
        clock.later(t, hours=2),
        clock.later(t, days=1, minutes=30),
    ).collect()
    for m, text_, monday, sunday, two_hours, next_day in found:
        assert text_ == clock.clock_text(m)
        assert monday == clock.week_day(m) and sunday == clock.week_day(m, 7)
        assert two_hours == m + dt.timedelta(hours=2)
        assert next_day == m + dt.timedelta(days=1, minutes=30)
    days = spark.createDataFrame([("2019.1.01",), ("2019.11.01",)], "x string")
    parsed = [r[0] for r in days.select(clock.parse_day(F.col("x"))).collect()]
    assert parsed == [dt.date(2019, 1, 1), dt.date(2019, 11, 1)]
