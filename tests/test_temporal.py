import datetime as dt

import pytest
from pyspark.sql import functions as F

from tertulia.fixed_values import WEEKDAYS_ES
from tertulia.functions.temporal import parse_chat_timestamp
from tertulia.operators import temporal

FORMS = [
    ("3/11/25, 20:05 ", dt.datetime(2025, 3, 11, 20, 5)),
    ("31/12/25, 20:05", dt.datetime(2025, 12, 31, 20, 5)),
    ("11/3/2025, 8:05 p. m.", dt.datetime(2025, 11, 3, 20, 5)),
    ("1/2/25, 12:05 a. m.", dt.datetime(2025, 1, 2, 0, 5)),
    ("1/2/25, 12:05 PM", dt.datetime(2025, 1, 2, 12, 5)),
    ("1/2/25, 7:05:09 pm", dt.datetime(2025, 1, 2, 19, 5, 9)),
    ("1/2/99, 1:05", dt.datetime(1999, 1, 2, 1, 5)),
    ("30/2/25, 10:00", None), ("bad", None), ("13/13/25, 1:00", None), ("1/2/25, 13:05 pm", None),
    ("1/2/025, 1:05", None), ("1/2/25, 24:00", None), ("1/2/25, 1:60", None), (None, None),
    ("2024-01-05 10:11:12", dt.datetime(2024, 1, 5, 10, 11, 12)),
    ("2024-01-05T10:11", dt.datetime(2024, 1, 5, 10, 11)), ("2024-13-05", None),
]


def test_forms(on_texts):
    out = on_texts(lambda c: parse_chat_timestamp(c, pivot_year=2026), [f for f, _ in FORMS])
    assert out == [m for _, m in FORMS]


def test_day_first(on_texts):
    out = on_texts(lambda c: parse_chat_timestamp(c, "dmy"), ["3/11/25, 20:05", "12/13/25, 1:00"])
    assert out == [dt.datetime(2025, 11, 3, 20, 5), None]
    with pytest.raises(ValueError):
        on_texts(lambda c: parse_chat_timestamp(c, "ymd"), ["x"])


# 2025-01-06 is a Monday, written 1/6/25.
ROWS = [
    ("1/6/25, 10:00", "a", "x"), ("1/6/25, 11:00", "Sistema", "y"), ("1/7/25, 10:30", "a", None),
    ("1/12/25, 9:00", "a", "x"), ("bad", "a", "x"),
]


def test_days_and_hours(messages):
    df = messages(*ROWS)
    days = temporal.messages_by_day(df).collect()
    assert [(r.day_idx, r.day_name, r["count"]) for r in days] == list(
        zip(range(7), WEEKDAYS_ES, [2, 1, 0, 0, 0, 0, 1]))
    assert [tuple(r) for r in temporal.messages_by_hour(df).collect()] == [(9, 1), (10, 2), (11, 1)]
    dense = temporal.messages_by_hour(df, dense=True).collect()
    assert len(dense) == 24 and sum(r["count"] for r in dense) == 4
    labels = list("abcdefg")
    assert [r.day_name for r in temporal.messages_by_day(df, labels=labels).collect()] == labels
    assert temporal.messages_by_day(df, by=["chat_id"]).first().asDict() == {
        "chat_id": "c", "day_idx": 0, "day_name": "Lunes", "count": 2}


def test_empty_input_keeps_all_days(messages):
    df = messages(("bad", "a", "x"))
    assert [r["count"] for r in temporal.messages_by_day(df).collect()] == [0] * 7
    assert temporal.activity_heatmap(df).collect() == []


def test_heatmap_and_peaks(messages):
    df = messages(*ROWS)
    heat = {r.hour: r.asDict() for r in temporal.activity_heatmap(df).collect()}
    # The message-less row adds its hour and day but counts nothing.
    assert set(heat) == {9, 10, 11} and list(heat[10])[1:] == WEEKDAYS_ES
    assert heat[10]["Lunes"] == 1 and heat[10]["Martes"] == 0 and heat[9]["Domingo"] == 1
    peaks = {r.peak: (r.day_name, r.hour, r["count"]) for r in temporal.activity_peaks(df).collect()}
    assert peaks == {
        "busiest_day": ("Lunes", None, 2), "quietest_day": ("Miércoles", None, 0),
        "busiest_hour": (None, 10, 2), "busiest_cell": ("Lunes", 10, 1),
    }


def test_sums_agree(messages):
    df = messages(*[(f"{1 + i % 12}/{1 + i % 28}/25, {i % 24}:00", "a", "x") for i in range(500)], ("bad", "a", "x"))
    by_day = sum(r["count"] for r in temporal.messages_by_day(df).collect())
    cells = sum(sum(r[d] for d in WEEKDAYS_ES) for r in temporal.activity_heatmap(df).collect())
    assert by_day == cells == temporal.date_range(df).first().dated_messages == 500


def test_calendar_and_real_timestamps(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 6, 10),)], "timestamp timestamp_ntz")
    row = temporal.with_calendar(df).first()
    assert (row.hour, row.day_idx, row.day_name) == (10, 0, "Lunes")
    span = temporal.date_range(df).first()
    assert span.first_message == span.last_message == dt.datetime(2025, 1, 6, 10)


def test_groups_without_dates_show_zeros(spark, messages):
    df = messages(("1/2/25, 10:00", "a", "x"), ("bad", "b", "y"))
    found = temporal.messages_by_day(df, by=["sender"]).groupBy("sender").agg(F.sum("count").alias("n")).collect()
    assert {(r.sender, r.n) for r in found} == {("a", 1), ("b", 0)}
    assert temporal.messages_by_hour(df, by=["sender"], dense=True).count() == 48
