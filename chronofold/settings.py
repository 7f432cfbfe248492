"""What to extract: feature sets, grouping, values, order, windows."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class FeatureSetting(Enum):
    """Minimal is part of Efficient, which is part of Comprehensive (that adds sample entropy)."""

    Minimal = "minimal"
    Efficient = "efficient"
    Comprehensive = "comprehensive"


@dataclass(frozen=True)
class DynamicGroupBySettings:
    """Calendar windows: one starts every ``every`` (shifted by ``offset``) and lasts ``period``.

    Durations are like "1y", "3mo", "1w2d", "12h"; a bare "0" is no duration.
    ``datetime_format`` (strftime codes) is for time columns that are strings.
    """

    time_col: str
    every: str
    period: str
    offset: str = "0"
    datetime_format: str | None = None


@dataclass(frozen=True)
class ExtractionSettings:
    """``order_cols`` give the order of a series; without them it is that of the time column, or of the input as it comes (best effort: Spark tables have no order)."""

    grouping_cols: list[str]
    value_cols: list[str]
    feature_setting: FeatureSetting = FeatureSetting.Efficient
    config_path: str | None = None
    dynamic_settings: DynamicGroupBySettings | None = None
    order_cols: list[str] | None = field(default=None)

    def __post_init__(self) -> None:
        if not self.value_cols:
            raise ValueError("at least one value column is needed")
        names = [*self.grouping_cols, *self.value_cols, *([self.dynamic_settings.time_col] if self.dynamic_settings else [])]
        if len(set(names)) != len(names):
            raise ValueError(f"grouping, value and time columns must differ: {names}")
