import statistics

import pytest
from pyspark.sql import functions as F

from tertulia.operators import members

ROWS = [
    ("t", "ana", "uno dos tres"), ("t", "ana", "x"), ("t", "beto", "mucho texto aquí"), ("t", "beto", ""),
    ("t", "caro", "👍🏽"), ("t", "Sistema", "aviso"), ("t", "ana", None), ("t", None, "sin nombre"),
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_top_active(messages):
    df = messages(*ROWS)
    assert rows_of(members.top_active_members(df, 2)) == [("ana", 3), ("beto", 2)]
    assert rows_of(members.top_active_members(df, 1, by=["chat_id"])) == [("c", "ana", 3)]


def test_word_count(messages):
    df = messages(*ROWS)
    assert rows_of(members.avg_user_word_count(df)) == [("ana", 2.0), ("beto", 1.5), ("caro", 1.0)]
    assert dict(rows_of(members.avg_user_word_count(df, null_text="nan")))["ana"] == 5 / 3
    given = df.withColumn("word_count", F.lit(7))
    assert rows_of(members.avg_user_word_count(given, 1)) == [("ana", 7.0)]
    counts = [r.word_count for r in members.with_word_count(df).orderBy("msg_idx").collect()]
    assert counts == [3, 1, 3, 0, 1, 1, None, 2]


def test_statistics(messages):
    df = messages(*ROWS)
    assert rows_of(members.user_statistics(df)) == [("ana", 2, 13, 6.5), ("beto", 2, 16, 8.0), ("caro", 1, 2, 2.0)]
    # As a text, a missing message has a size, though it is still not counted.
    assert rows_of(members.user_statistics(df, null_text="None"))[0] == ("ana", 2, 17, 17 / 3)


def test_short_writers(messages):
    df = messages(*ROWS)
    assert rows_of(members.users_short_messages(df, 2)) == [("caro", 2.0, 1), ("ana", 6.5, 2)]
    given = df.withColumn("message_size", F.lit(1))
    assert rows_of(members.users_short_messages(given, 1)) == [("ana", 1.0, 2)]


def test_boxplot_against_plain_python(messages):
    sizes = {"a": [1, 2, 3, 4, 100, 7, 7, 9], "b": [5], "c": [1, 50, 51, 52], "d": [3, 3]}
    df = messages(*[("t", s, "x" * n) for s, ns in sizes.items() for n in ns])
    out = members.message_size_boxplot(df, 3).collect()
    assert [r.sender for r in out] == ["a", "c", "d"]
    for r in out:
        data = sorted(sizes[r.sender])
        q1, med, q3 = statistics.quantiles(data, n=4, method="inclusive")
        inside = [v for v in data if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3))
        assert (r.whisker_low, r.whisker_high) == (min(inside[0], q1), max(inside[-1], q3))


def test_rows_of_top_members(messages):
    out = members.messages_of_top_members(messages(*ROWS), 1).collect()
    assert [r.message for r in out] == ["uno dos tres", "x", None]


def test_profile(messages):
    df = messages(*[("t", "many", "abc")] * 9, ("t", "long", "x" * 90), ("t", "p", "ab"), ("t", "q", "ab"))
    profile = {r.sender: r.profile for r in members.participation_profile(df).collect()}
    assert profile == {"many": "many_short", "long": "few_long", "p": "few_short", "q": "few_short"}


def test_top_k_plan(messages):
    df = members.top_active_members(messages(*ROWS), 3)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()
    grouped = members.top_active_members(messages(*ROWS), 3, by=["chat_id"])
    assert "WindowGroupLimit" in grouped._jdf.queryExecution().executedPlan().toString()
