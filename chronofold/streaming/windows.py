"""Order-free features over a stream, per group and time window.

Features that need a series in order can't be had from partial sums; those that
can are kept as state of a few numbers for each group and window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold import config
from chronofold.functions import text
from chronofold.plans.features import FEATURES, NULLABLE, Build
from chronofold.settings import ExtractionSettings

ORDER_FREE = ("length", "sum_values", "mean", "minimum", "maximum", "standard_deviation", "variance", "skewness", "root_mean_square", "kurtosis", "absolute_energy", "variance_larger_than_standard_deviation", "large_standard_deviation", "absolute_maximum", "count_above", "count_below", "variation_coefficient", "range_count")


def stream_features(df: DataFrame, settings: ExtractionSettings, watermark: str, features: tuple[str, ...] = ORDER_FREE) -> DataFrame:
    """Features of ``features`` per group and window of a streaming ``df``.

    Windows are those of ``settings.dynamic_settings``, with fixed durations as
    Spark writes them ("5 minutes"). Rows later than ``watermark`` are dropped, as
    is the state of windows that it has passed.
    """
    unfit = set(features) - set(ORDER_FREE)
    if unfit or settings.dynamic_settings is None:
        raise ValueError(f"a stream needs windows and order-free features, not {sorted(unfit)}")
    d, parameters = settings.dynamic_settings, config.load(settings.config_path)
    builds = [Build(k, c, [], [], ranked=False) for k, c in enumerate(settings.value_cols)]
    outputs = {"length": text.coalesce(builds[0].n(), 0).cast("long")} if "length" in features else {}
    for b, value in zip(builds, settings.value_cols):
        for n in features:
            if n != "length" and n in parameters:
                for suffix, made in FEATURES[n](b, parameters[n]):
                    there = text.when(b.some(), made)
                    outputs[f"{value}__{suffix}"] = there if n in NULLABLE else text.coalesce(there, text.nan())
    window = F.window(d.time_col, d.period, d.every, d.offset) if d.offset != "0" else F.window(d.time_col, d.period, d.every)
    keys = settings.grouping_cols
    grouped = df.withWatermark(d.time_col, watermark).groupBy(*keys, window.alias("__window"))
    state = grouped.agg(*(F.expr(c.sql).alias(n) for b in builds for n, c in b.aggregates.items()))
    return state.select(*keys, F.col("__window.start").alias(d.time_col), *(F.expr(c.sql).alias(n) for n, c in outputs.items()))
