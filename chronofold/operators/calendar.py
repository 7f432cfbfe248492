"""Calendar windows as derived grouping keys."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.settings import DynamicGroupBySettings

# Units of durations, in microseconds, days or months.
MICROS = {"ns": 0.001, "us": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
DAYS = {"d": 1, "w": 7}
MONTHS = {"mo": 1, "q": 3, "y": 12}
DAY = 86_400_000_000
#: 1970-01-05, the Monday that weeks are counted from, as days since 1970-01-01.
MONDAY = 4
# Strftime codes as Java patterns.
CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "j": "DDD"}


@dataclass(frozen=True)
class Duration:
    months: int = 0
    micros: int = 0
    weeks: bool = False

    @property
    def zero(self) -> bool:
        return not self.months and not self.micros


def parse_duration(text: str) -> Duration:
    """"1y", "3mo", "1w2d", "12h", "0"; calendar and fixed units don't mix."""
    text = text.strip()
    sign = -1 if text.startswith("-") else 1
    body = text.lstrip("+-")
    if body == "0":
        return Duration()
    if not re.fullmatch(r"(?:\d+(?:ns|us|ms|mo|[smhdwqy]))+", body):
        raise ValueError(f"not a duration: {text!r}")
    months, micros, units = 0, 0.0, set()
    for n, unit in re.findall(r"(\d+)(ns|us|ms|mo|[smhdwqy])", body):
        units.add(unit)
        if unit in MONTHS:
            months += int(n) * MONTHS[unit]
        else:
            micros += int(n) * (DAYS[unit] * DAY if unit in DAYS else MICROS[unit])
    if months and micros:
        raise ValueError(f"{text!r} mixes months with fixed units")
    return Duration(sign * months, sign * int(micros), units == {"w"})


def java_pattern(strftime: str) -> str:
    out, quoted = "", ""
    for part in re.findall(r"%.|[^%]+|%", strftime):
        if part[0] == "%":
            if part[1:] not in CODES:
                raise ValueError(f"unknown code {part!r} in {strftime!r}")
            out += CODES[part[1:]]
        else:
            out += "".join(f"'{c}'" if c.isalpha() else c for c in part)
    return out + quoted


def window_keys(df: DataFrame, settings: DynamicGroupBySettings) -> DataFrame:
    """``df`` with the time column replaced by the start of each window a row falls in.

    Windows are [start, start + period). Rows of overlapping windows are repeated,
    rows between windows and rows without a time fall out. Times are dates, but
    for timestamps with durations below a day.
    """
    every, period, offset = (parse_duration(d) for d in (settings.every, settings.period, settings.offset))
    if every.zero or period.zero or every.months < 0 or every.micros < 0 or period.months < 0 or period.micros < 0:
        raise ValueError("every and period must be positive durations")
    if bool(every.months) != bool(period.months) or (not offset.zero and bool(offset.months) != bool(every.months)):
        raise ValueError("every, period and offset must all be of months or all be fixed")
    name = settings.time_col
    t, kind = F.col(name), df.schema[name].dataType
    fine = isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and any(d.micros % DAY for d in (every, period, offset))
    if isinstance(kind, T.StringType):
        t = F.to_date(t, java_pattern(settings.datetime_format or "%Y-%m-%d %H:%M:%S"))
    elif not fine:
        t = t.cast("date")

    if every.months:
        at, step, length, shift = F.year(t) * 12 + F.month(t) - 1, every.months, period.months, offset.months

        def start(k: Column) -> Column:
            m = k * step + shift
            return F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))
    elif fine:
        at, step, length, shift = F.unix_micros(t.cast("timestamp")), every.micros, period.micros, offset.micros + (MONDAY * DAY if every.weeks else 0)

        def start(k: Column) -> Column:
            return F.timestamp_micros(k * step + shift)
    else:
        for d in (every, period, offset):
            if d.micros % DAY:
                raise ValueError("windows below a day need a timestamp column")
        at, step, length, shift = F.unix_date(t).cast("long"), every.micros // DAY, period.micros // DAY, offset.micros // DAY + (MONDAY if every.weeks else 0)

        def start(k: Column) -> Column:
            return F.date_from_unix_date((k * step + shift).cast("int"))

    last = F.floor((at - shift) / step).cast("long")
    if length == step:
        return df.where(t.isNotNull()).withColumn(name, start(last))
    # the windows that begin at or before a row and end after it
    first = (F.floor((at - shift - length) / step) + 1).cast("long")
    keyed = df.where(t.isNotNull()).withColumn("__from", first).withColumn("__to", last)
    return keyed.where("__from <= __to").withColumn("__k", F.explode(F.sequence("__from", "__to"))).withColumn(name, start(F.col("__k"))).drop("__from", "__to", "__k")
