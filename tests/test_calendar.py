import datetime as dt

import pytest

from chronofold import DynamicGroupBySettings
from chronofold.operators.calendar import Duration, java_pattern, parse_duration, window_keys


def test_durations():
    assert parse_duration("0") == Duration() and parse_duration("0y").zero
    assert parse_duration("1y").months == 12 and parse_duration("1q2mo").months == 5
    assert parse_duration("1d12h").micros == 36 * 3_600_000_000 and parse_duration("2w").weeks
    for bad in ("", "y", "1x", "1mo1d"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_patterns():
    assert java_pattern("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss" and java_pattern("%dT%b") == "dd'T'MMM"
    with pytest.raises(ValueError):
        java_pattern("%Q")


def starts(spark, kind, values, *args):
    df = spark.createDataFrame([(v,) for v in values], f"t {kind}")
    return sorted(str(r["t"]) for r in window_keys(df, DynamicGroupBySettings("t", *args)).collect())


def test_window_starts(spark):
    d = [dt.date(2024, 2, 29)]
    assert starts(spark, "date", d, "1mo", "1mo") == ["2024-02-01"]
    assert starts(spark, "date", d, "1w", "1w") == ["2024-02-26"]
    assert starts(spark, "date", d, "1mo", "3mo") == ["2023-12-01", "2024-01-01", "2024-02-01"]
    assert starts(spark, "date", d, "1y", "1y", "1mo") == ["2024-02-01"]
    assert starts(spark, "date", d, "10d", "1d") in ([], ["2024-02-29"])
    assert starts(spark, "timestamp", [dt.datetime(2024, 1, 1, 13, 30)], "6h", "6h") == ["2024-01-01 12:00:00"]
    assert starts(spark, "date", [None], "1d", "1d") == []
    with pytest.raises(ValueError):
        starts(spark, "date", d, "1mo", "3d")
