"""Column functions by tables of hand-computed values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marketlens.functions import numbers, text, times


def values(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "function,inputs,want",
    [
        (numbers.parse_price, ["$12.50", "abc", "1.2.3", "", "0", ".5", None], [12.5, None, 1.2, None, None, 0.5, None]),
        (lambda c: numbers.parse_count(c, 0), ["12 boxes", "", "-3", "x4", None], [12, 0, -3, 0, 0]),
        (text.clean_phone, ["(503) 555-0101", "1-503-555-0101", "123", None], ["+15035550101", "+15035550101", None, None]),
        (text.zip_code, ["Salem OR 97301-1234", "none"], ["97301", ""]),
        (text.plain, ["  A-b C!", None], ["ab c", ""]),
        (text.collapsed, ["  A  b\tC! ", None], ["a b c!", None]),
        (text.compact, ["A b-1", None], ["ab1", ""]),
        (text.host, ["https://www.A.com:80/x", "no url", None], ["a.com", None, None]),
        (text.clean_url, ["a.com/?q=1", "http://b.com/", " ", None], ["https://a.com", "http://b.com", None, None]),
        (text.emails, ["x A@b.co a@B.co", None], [["a@b.co"], []]),
        (text.json_list, ['["a","b"]', "bad", None], [["a", "b"], [], []]),
        (text.json_shown, ['["a","b"]', "bad", None], ["a, b", "bad", None]),
        (text.tags, ["a, ,b ", ""], [["a", "b"], []]),
        (lambda c: text.shorten(c, 3), ["abcd", "abc", None], ["abc…", "abc", None]),
        (lambda c: numbers.ordinal(c, ("low", "high")), ["high", "x", None], [2, None, None]),
        (lambda c: times.is_open_hourly(c, F.lit("2024-01-31 20:00").cast("timestamp_ntz")), ["10am-8pm", "12pm-12am", "Closed", "?", None], [False, False, False, None, None]),
        (lambda c: times.is_open_minutes(c, F.lit("2024-01-31 20:15").cast("timestamp_ntz")), ["10am - 8:30pm", "12pm–12am", "Closed", "?", None], [True, True, False, None, None]),
    ],
)
def test_text(spark, function, inputs, want):
    assert values(spark, function, inputs) == want


def test_numbers(spark):
    assert values(spark, numbers.half_up, [2.5, -2.5, None], "double") == [3, -2, None]
    assert values(spark, lambda c: numbers.or_default(c, F.lit(9)), [0, None, 4], "int") == [9, 9, 4]
    assert values(spark, lambda c: numbers.ladder(c, ((90, "a"), (80, "b")), "c"), [95, 80, 1], "int") == ["a", "b", "c"]
    assert values(spark, times.clock, [0, 570, 720, 1439], "int") == ["12am", "9:30am", "12pm", "11:59pm"]
    assert values(spark, times.age_label, [5, 300, 7200, 200_000], "long") == ["just now", "5m ago", "2h ago", "2d ago"]


def test_similarity(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("", "a"), ("x", "x")], "a string, b string")
    assert [round(r[0], 4) for r in rows.select(text.similarity(F.col("a"), F.col("b"))).collect()] == [0.6667, 0.0, 1.0]


def test_miles_and_grid(spark):
    one = spark.range(1)
    assert 2440 < one.select(numbers.miles(F.lit(34.05), F.lit(-118.24), F.lit(40.71), F.lit(-74.01))).first()[0] < 2450
    days = one.select(times.month_cells(F.lit(datetime(2026, 8, 1).date()))).first()[0]
    assert len(days) == 35 and str(days[0]) == "2026-07-27" and str(days[-1]) == "2026-08-30"
