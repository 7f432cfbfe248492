"""``extract_features``: one row of features per group, or per group and window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold import config
from chronofold.functions import text
from chronofold.functions.numeric import nan
from chronofold.functions.ship import ship_package
from chronofold.operators.calendar import window_keys
from chronofold.plans.features import FEATURES, NULLABLE, RANKED, Build
from chronofold.settings import ExtractionSettings, FeatureSetting


#: Bytes of input as stored, for each value column, that one task takes: some 400,000 rows, which the sorts widen to 2 KB each.
#: A task of the whole set costs some seconds for its expressions alone, so much smaller ones are slower.
SLICE = 4 << 20
#: A plan's leaf of this size is one of which Spark knows no size.
UNKNOWN = 1 << 60


def extract_features(df: DataFrame, settings: ExtractionSettings, streaming: bool = False, features: dict[str, list[dict]] | None = None) -> DataFrame:
    """Grouping columns, the window's start (if any), ``length`` and the features of ``settings``.

    Lazy: nothing runs before an action on the result. Nulls are left out of
    their own series, each value column for itself; groups without a value stay,
    with NaN (or null for median, quantile and
    variance_larger_than_standard_deviation). ``streaming`` is accepted and has
    no effect. ``features`` (parameter sets by name) takes the place of a file.
    """
    chosen = config.load(settings.config_path) if features is None else features
    names = list(config.MINIMAL)
    if settings.feature_setting is not FeatureSetting.Minimal:
        names += config.EFFICIENT
    wanted = {n: chosen[n] for n in names if n in chosen}
    entropy = settings.feature_setting is FeatureSetting.Comprehensive

    order = list(settings.order_cols or [])
    keys = list(settings.grouping_cols)
    if settings.dynamic_settings:
        name = settings.dynamic_settings.time_col
        if name in order:  # the window's start takes the column's place
            df = df.withColumn("__time", F.col(name))
            order = ["__time" if c == name else c for c in order]
        elif not order:
            df = df.withColumn("__time", F.col(name)).withColumn("__row", F.monotonically_increasing_id())
            order = ["__time", "__row"]
        keys = [*keys, name]
    elif not order:
        df = df.withColumn("__row", F.monotonically_increasing_id())
        order = ["__row"]
    extra = [c for c in order if c not in (*keys, *settings.value_cols)]
    df = df.select(*(F.col(f"`{c}`") for c in (*keys, *settings.value_cols, *extra)))
    if settings.dynamic_settings:
        df = window_keys(df, settings.dynamic_settings)
    if not wanted and not entropy:
        return df.select(*keys).distinct()
    ordering = {c: f"__o{k}" for k, c in enumerate(order)}
    partition = [f"__k{k}" for k in range(len(keys))] + (["__c"] if len(settings.value_cols) > 1 else [])
    ranked = any(n in wanted for n in RANKED)
    builds = [Build(k, c, partition, list(ordering.values()), ranked) for k, c in enumerate(settings.value_cols)]

    outputs: list[Column] = []
    undefined = text.nan()
    taken: set[str] = set()

    def add(name: str, value: text.Text) -> None:
        if name in taken:
            raise ValueError(f"two features have the name {name}: their parameters differ by less than the name shows")
        taken.add(name)
        outputs.append(F.expr(value.sql).alias(name))

    if "length" in wanted:
        add("length", text.coalesce(builds[0].n(), 0).cast("long"))
    for part in (config.MINIMAL, config.EFFICIENT):
        for b, value in zip(builds, settings.value_cols):
            for n in part:
                if n in wanted and n != "length":
                    for suffix, column in FEATURES[n](b, wanted[n]):
                        there = text.when(b.some(), column)
                        add(f"{value}__{suffix}", there if n in NULLABLE else text.coalesce(there, undefined))
    aggregates = [F.expr(c.sql).alias(n) for b in builds for n, c in b.aggregates.items()]
    base = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    if any(b.series for b in builds):
        base = _joined(base, _series(df, keys, settings.value_cols, ordering, partition, builds), keys)
    if entropy:
        for value in settings.value_cols:
            outputs.append(F.coalesce(F.col(f"`{value}__sample_entropy`"), nan()).alias(f"{value}__sample_entropy"))
        base = _joined(base, _entropy(df, keys, settings.value_cols, order), keys)
    return base.select(*(F.col(f"`{k}`") for k in keys), *outputs)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the grouping columns, in which null is a value; ``right`` has them as __k0, __k1, ..."""
    if not keys:
        return left.crossJoin(right)  # one row on either side
    on = None
    for k, name in enumerate(keys):
        same = left[f"`{name}`"].eqNullSafe(right[f"__k{k}"])
        on = same if on is None else on & same
    return left.join(right, on, "left").drop(*(f"__k{k}" for k in range(len(keys))))


def _tasks(df: DataFrame, columns: int) -> int | None:
    """A number of tasks that grows with the input, or None where one for each core does: then Spark chooses.

    Left to itself Spark joins partitions until there is one for each core, or 64 MB of narrow rows, however
    wide the windows make them. Sizes come from the plan's statistics, so nothing runs.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    size = lambda p: int(str(p.stats().sizeInBytes()))
    leaves = plan.collectLeaves()
    sizes = [size(leaves.apply(k)) for k in range(leaves.size())]
    if any(s >= UNKNOWN for s in sizes):
        return None
    # a join's estimate is a product; that of its inputs is nearer
    tasks = -(-min(size(plan), sum(sizes)) * columns // SLICE)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.conf.get("spark.sql.adaptive.enabled") == "true":
        least = min(least, spark.sparkContext.defaultParallelism)
    return tasks if tasks > least else None


def _series(df: DataFrame, keys: list[str], values: list[str], ordering: dict[str, str], partition: list[str], builds: list[Build]) -> DataFrame:
    """One row per group with a struct s0, s1, ... of series aggregates per value column."""
    named = [F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)] + [F.col(f"`{c}`").alias(o) for c, o in ordering.items()]
    if len(values) == 1:
        rows = df.select(*named, F.col(f"`{values[0]}`").cast("double").alias("x"))
    else:
        pairs = F.array(*(F.struct(F.lit(k).alias("__c"), F.col(f"`{c}`").cast("double").alias("x")) for k, c in enumerate(values)))
        rows = df.select(*named, F.explode(pairs).alias("__p")).select(*(c for n in (*(f"__k{k}" for k in range(len(keys))), *ordering.values()) for c in [n]), "__p.*")
    rows = rows.where("x is not null")
    # one exchange: every window and the aggregation below are partitioned by the group or finer
    if partition:
        tasks = _tasks(df, len(values))
        rows = rows.repartition(tasks, *partition) if tasks else rows.repartition(*partition)
    need = {stage: {} for stage in builds[0].rows}
    made: dict[str, text.Text] = {}
    for b in builds:
        for stage, columns in b.rows.items():
            need[stage] |= columns
        made |= b.series
    for columns in need.values():
        if columns:
            rows = rows.select("*", *(F.expr(c.sql).alias(n) for n, c in columns.items()))
    struct = rows.groupBy(*partition).agg(*(F.expr(c.sql).alias(n) for n, c in made.items()))
    if len(values) == 1:
        return struct.select(*(f"__k{k}" for k in range(len(keys))), F.struct(*made).alias("s0"))
    wide = [F.first(F.when(F.col("__c") == k, F.struct(*made)), ignorenulls=True).alias(f"s{k}") for k in range(len(values))]
    return struct.groupBy(*partition[:-1]).agg(*wide)


def sample_entropy(x: np.ndarray, m: int = 2, ratio: float = 0.2, block: int = 512) -> float:
    """ln of the share of template pairs of m values within ratio * deviation that stay so with m + 1."""
    n = len(x)
    if n == 0:
        return float("nan")
    r = ratio * x.std(ddof=1) if n > 1 else float("nan")
    with np.errstate(all="ignore"):
        short = long = 0
        for a in range(0, n, block):
            rows = np.arange(a, min(n, a + block))
            close = np.abs(x[rows][:, None] - x[None, :]) < r
            # windows of length m starting at i and j, i < j: compare shifted rows of the same table
            pair = np.arange(n)[None, :] > rows[:, None]
            both = close & pair
            for k in range(1, m + 1):
                i = rows + k
                ok = np.zeros_like(both)
                fits = i < n
                ok[fits, : n - k] = np.abs(x[i[fits]][:, None] - x[None, k:]) < r
                both &= ok
                if k == m - 1:
                    short += int(both.sum())
                elif k == m:
                    long += int(both.sum())
        return float(np.log(np.float64(short) / np.float64(long)))


def _entropy(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Quadratic in a group's length, so one task takes a group in blocks of rows; nulls count as NaN."""
    ship_package(df.sparkSession)
    named = [F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)]
    sorting = [f"__o{k}" for k in range(len(order))]
    rows = df.select(*named, *(F.col(f"`{c}`").alias(o) for c, o in zip(order, sorting)), *(F.col(f"`{c}`").cast("double").alias(f"__v{k}") for k, c in enumerate(values)))
    schema = T.StructType([*rows.schema.fields[: len(keys)], *(T.StructField(f"{v}__sample_entropy", T.DoubleType()) for v in values)])
    firsts = [f"__k{k}" for k in range(len(keys))]

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sorting, kind="stable")
        out = {k: [pdf[k].iloc[0]] for k in firsts}
        out |= {f"{v}__sample_entropy": [sample_entropy(pdf[f"__v{k}"].to_numpy(float))] for k, v in enumerate(values)}
        return pd.DataFrame(out)

    return rows.groupBy(*firsts).applyInPandas(of_group, schema)


def feature_names(df: DataFrame, settings: ExtractionSettings) -> Iterator[str]:
    """The names of the feature columns, in order of output."""
    keys = {*settings.grouping_cols, *([settings.dynamic_settings.time_col] if settings.dynamic_settings else [])}
    return (c for c in extract_features(df, settings).columns if c not in keys)
