"""Registered queries of the feature engine, with the same results in plain SQL.

Every feature runs over the whole ``events`` table: values become whole numbers
around zero (so that ties and signs occur), large ones become nulls.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold import config
from chronofold.extract import extract_features
from chronofold.operators import post
from chronofold.settings import DynamicGroupBySettings, ExtractionSettings, FeatureSetting
from chronofold.sources.readers import from_rows, read_csv, read_stations, read_table

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
VALUE = "CASE WHEN value <= 400 THEN floor(value - 50) END"
#: A second series, with nulls in other rows.
OTHER = "CASE WHEN event_id % 7 <> 0 THEN floor(value / 3) - 40 END"
CONFIG = str(Path(__file__).with_name("sample.toml"))


def rounded(df: DataFrame, keys: list[str], digits: int = DIGITS) -> DataFrame:
    """Feature columns rounded, since engines add in different orders; negative zero as zero."""
    columns = [(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes if c not in keys]
    return df.select(*keys, *columns)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "ts", "event_id", F.expr(VALUE).cast("double").alias("value"))


def _feature(name: str, key: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        settings = ExtractionSettings([key], ["value"], order_cols=["ts", "event_id"])
        return rounded(extract_features(_series(spark, sf_dir), settings, features={name: config.defaults()[name]}), [key])

    return query


def _sql(key: str, columns: dict[str, str], rows: str = "", source: str = "") -> str:
    """``columns``: aggregates over r (key, i, x, n, mu, var, sd, mn, mx and what ``rows`` adds), by output name."""
    picked = ", ".join(f'{e} AS "value__{n}"' if n == "length" else f'round(coalesce({e}, \'NaN\'::DOUBLE), {DIGITS}) + 0.0 AS "value__{n}"' if not n.startswith("?") else f'round({e}, {DIGITS}) + 0.0 AS "value__{n[1:]}"' for n, e in columns.items())
    picked = picked.replace('"value__length"', '"length"')
    return f"""
WITH v AS (
  SELECT {key}, x, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS i
  FROM (SELECT *, CAST({VALUE} AS DOUBLE) AS x FROM events) WHERE x IS NOT NULL
), g AS (
  SELECT {key}, count(*) AS n, avg(x) AS mu, var_samp(x) AS var, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v GROUP BY {key}
), r AS (
  SELECT v.*, n, mu, var, sd, mn, mx{", " + rows if rows else ""} FROM v JOIN g USING ({key})
  WINDOW w AS (PARTITION BY v.{key} ORDER BY i)
){source}
SELECT {key}, {picked} FROM {"r" if not source else "z"} GROUP BY {key}
"""


def _one(expr: str) -> str:
    return f"any_value({expr})"


N, MU, VAR, SD, MN, MX = map(_one, ("n", "mu", "var", "sd", "mn", "mx"))
MID = "quantile_cont(x, 0.5)"


def _strike(sign: str, key: str) -> tuple[dict[str, str], str, str]:
    return ({}, "", f""", marked AS (SELECT *, x {sign} mu AS hit FROM r), isles AS (
  SELECT *, i - row_number() OVER (PARTITION BY {key}, hit ORDER BY i) AS isle FROM marked
), sizes AS (SELECT {key}, CASE WHEN hit THEN count(*) ELSE 0 END AS size FROM isles GROUP BY {key}, hit, isle), z AS (SELECT {key}, size AS x FROM sizes)""")


def _freq(key: str) -> str:
    return f", z AS (SELECT {key}, x, count(*) AS f, any_value(n) AS n FROM r GROUP BY {key}, x)"


def feature_sql(name: str, key: str, parameters: list[dict] | None = None) -> str:
    """The feature's columns (with default parameters) over the series of ``events`` by ``key``."""
    p = config.defaults()[name] if parameters is None else parameters
    lead = lambda k: "x" if k == 0 else f"lead(x, {k}) OVER w"
    plain: dict[str, dict[str, str]] = {
        "length": {"length": "count(x)"},
        "sum_values": {name: "sum(x)"},
        "mean": {name: "avg(x)"},
        "median": {"?median": MID},
        "minimum": {name: "min(x)"},
        "maximum": {name: "max(x)"},
        "standard_deviation": {name: "stddev_samp(x)"},
        "variance": {name: "var_samp(x)"},
        "skewness": {name: "avg((x - mu) ** 3) / nullif(avg((x - mu) ** 2), 0) ** 1.5"},
        "root_mean_square": {name: "sqrt(avg(x * x))"},
        "kurtosis": {name: "avg((x - mu) ** 4) / nullif(avg((x - mu) ** 2), 0) ** 2"},
        "absolute_energy": {name: "sum(x * x)"},
        "linear_trend": {"linear_trend_intercept": "regr_intercept(x, i)", "linear_trend_slope": "regr_slope(x, i)"},
        "variance_larger_than_standard_deviation": {f"?{name}": "CAST(var_samp(x) > stddev_samp(x) AS DOUBLE)"},
        "ratio_beyond_r_sigma": {f"{name}__r_{q['r']:.2f}": f"avg(CASE WHEN abs(x - mu) > {q['r']} * sd THEN 1.0 ELSE 0.0 END)" for q in p if "r" in q},
        "large_standard_deviation": {f"{name}__r_{q['r']:.2f}": f"CASE WHEN {SD} > {q['r']} * ({MX} - {MN}) THEN 1.0 ELSE 0.0 END" for q in p if "r" in q},
        "symmetry_looking": {f"{name}__r_{q['r']:.2f}": f"CASE WHEN abs({MU} - {MID}) < {q['r']} * ({MX} - {MN}) THEN 1.0 ELSE 0.0 END" for q in p if "r" in q},
        "has_duplicate_max": {name: "CAST(count(*) FILTER (x = mx) > 1 AS DOUBLE)"},
        "has_duplicate_min": {name: "CAST(count(*) FILTER (x = mn) > 1 AS DOUBLE)"},
        "absolute_maximum": {name: "max(abs(x))"},
        "count_above_mean": {name: "CAST(count(*) FILTER (x > mu) AS DOUBLE)"},
        "count_below_mean": {name: "CAST(count(*) FILTER (x < mu) AS DOUBLE)"},
        "count_above": {f"{name}__t_{q['t']:.1f}": f"CAST(count(*) FILTER (x > {q['t']}) AS DOUBLE)" for q in p if "t" in q},
        "count_below": {f"{name}__t_{q['t']:.1f}": f"CAST(count(*) FILTER (x < {q['t']}) AS DOUBLE)" for q in p if "t" in q},
        "first_location_of_maximum": {name: f"min(i) FILTER (x = mx) / CAST({N} AS DOUBLE)"},
        "first_location_of_minimum": {name: f"min(i) FILTER (x = mn) / CAST({N} AS DOUBLE)"},
        "last_location_of_maximum": {name: f"1 - min(i) FILTER (x = mx) / CAST({N} AS DOUBLE)"},
        "last_location_of_minimum": {name: f"1 - min(i) FILTER (x = mn) / CAST({N} AS DOUBLE)"},
        "variation_coefficient": {name: f"stddev_samp(x) / nullif({MU}, 0)"},
        "mean_change": {name: f"(arg_max(x, i) - arg_min(x, i)) / nullif({N} - 1, 0)"},
        "quantile": {f"?{name}__q_{q['q']:.1f}": f"(list_sort(list(x))[CAST(floor(({N} - 1) * CAST({q['q']} AS DOUBLE)) AS BIGINT) + 1] + list_sort(list(x))[CAST(ceil(({N} - 1) * CAST({q['q']} AS DOUBLE)) AS BIGINT) + 1]) / 2" for q in p if "q" in q},
        "mean_n_absolute_max": {f"{name}__n_{q['n']}": f"CASE WHEN {N} >= {q['n']} THEN list_avg(list_reverse_sort(list(abs(x)))[1:{q['n']}]) END" for q in p if "n" in q},
        "range_count": {f"{name}__min_{q['min']:.1f}__max_{q['max']:.1f}": f"CAST(count(*) FILTER (x BETWEEN {q['min']!r} AND {q['max']!r}) AS DOUBLE)" for q in p if "max" in q},
    }
    if name in plain:
        return _sql(key, plain[name])
    if name in ("mean_absolute_change", "absolute_sum_of_changes"):
        return _sql(key, {name: "avg(abs(y - x))" if name[0] == "m" else "coalesce(sum(abs(y - x)), 0)"}, f"{lead(1)} AS y")
    if name == "cid_ce":
        total = "sqrt(coalesce(sum((y - x) ** 2), 0))"
        return _sql(key, {f"{name}__normalize_t": f"CASE WHEN {N} = 1 THEN 0.0 ELSE {total} / nullif({SD}, 0) END", f"{name}__normalize_f": total}, f"{lead(1)} AS y")
    if name.startswith("longest_strike"):
        _, _, source = _strike(">" if "above" in name else "<", key)
        return _sql(key, {name: "CAST(max(x) AS DOUBLE)"}, source=source)
    repeats = {
        "has_duplicate": "CAST(max(f) > 1 AS DOUBLE)",
        "ratio_value_number_to_time_series_length": f"CAST(count(*) AS DOUBLE) / {N}",
        "sum_of_reoccurring_values": "coalesce(sum(x) FILTER (f > 1), 0)",
        "sum_of_reoccurring_data_points": "coalesce(sum(x * f) FILTER (f > 1), 0)",
        "percentage_of_reoccurring_values_to_all_values": "CAST(count(*) FILTER (f > 1) AS DOUBLE) / count(*)",
        "percentage_of_reoccurring_values_to_all_datapoints": f"CAST(count(*) FILTER (f > 1) AS DOUBLE) / {N}",
    }
    if name in repeats:
        return _sql(key, {name: repeats[name]}, source=_freq(key))
    if name == "agg_linear_trend":
        sizes = sorted({q["chunk_size"] for q in p})
        parts = " UNION ALL ".join(f"SELECT {key}, {c} AS c, i // {c} AS k, avg(x) AS a_mean, min(x) AS a_min, max(x) AS a_max, var_samp(x) AS a_var, any_value(n) AS n FROM r GROUP BY {key}, i // {c}" for c in sizes)
        columns = {}
        for q in p:
            c, a = q["chunk_size"], q["aggregator"]
            for part in ("intercept", "slope"):
                fit = f"regr_{part}(a_{a}, k) FILTER (c = {c})"
                columns[f"{name}_{part}__chunk_size_{c}__agg_{a}"] = f"CASE WHEN {N} >= {c} AND count(*) FILTER (c = {c} AND a_{a} IS NULL) = 0 THEN {fit} END"
        return _sql(key, columns, source=f", z AS ({parts})")
    if name == "autocorrelation":
        return _sql(key, {f"{name}__lag_{q['lag']}": f"sum((x - mu) * (y{q['lag']} - mu)) / nullif(({N} - {q['lag']}) * {VAR}, 0)" for q in p}, ", ".join(f"{lead(q['lag'])} AS y{q['lag']}" for q in p))
    if name == "number_crossing_m":
        columns = {f"{name}__m_{q['m']:.1f}": f"CAST(count(*) FILTER (x > {q['m']} AND y{k} < {q['m']} OR x < {q['m']} AND y{k} > {q['m']}) AS DOUBLE)" for k, q in enumerate(p)}
        return _sql(key, columns, ", ".join(f"last_value(CASE WHEN x <> {q['m']} THEN x END IGNORE NULLS) OVER (PARTITION BY v.{key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y{k}" for k, q in enumerate(p)))
    if name == "index_mass_quantile":
        columns = {f"{name}__q_{q['q']}": f"CASE WHEN sum(abs(x)) > 0 THEN (coalesce(min(i) FILTER (so_far / total >= {q['q']!r}), 0) + 1) / CAST({N} AS DOUBLE) END" for q in p}
        return _sql(key, columns, f"sum(abs(x)) OVER (PARTITION BY v.{key} ORDER BY i ROWS UNBOUNDED PRECEDING) AS so_far, sum(abs(x)) OVER (PARTITION BY v.{key}) AS total")
    if name in ("c3", "time_reversal_asymmetry_statistic"):
        lags = sorted({k for q in p for k in (q["lag"], 2 * q["lag"])})
        term = "x * y{0} * y{1}" if name == "c3" else "y{1} * y{1} * y{0} - y{0} * x * x"
        return _sql(key, {f"{name}__lag_{q['lag']}": f"CASE WHEN {N} <= {2 * q['lag']} THEN 0.0 ELSE avg({term.format(q['lag'], 2 * q['lag'])}) END" for q in p}, ", ".join(f"{lead(k)} AS y{k}" for k in lags))
    if name == "number_peaks":
        frames = ", ".join(f"max(x) OVER (PARTITION BY v.{key} ORDER BY i ROWS BETWEEN {q['n']} PRECEDING AND 1 PRECEDING) AS a{q['n']}, max(x) OVER (PARTITION BY v.{key} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {q['n']} FOLLOWING) AS b{q['n']}" for q in p)
        return _sql(key, {f"{name}__n_{q['n']}": f"CAST(count(*) FILTER (x > a{q['n']} AND x > b{q['n']} AND i >= {q['n']} AND i < n - {q['n']}) AS DOUBLE)" for q in p}, frames)
    raise KeyError(name)


def _set(setting: FeatureSetting, keys: list[str], values: Callable[[SparkSession, str], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = values(spark, sf_dir)
        names = [c for c in df.columns if c not in (*keys, "ts", "event_id")]
        return rounded(extract_features(df, ExtractionSettings(keys, names, setting, order_cols=["ts", "event_id"])), keys)

    return query


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read_table(spark, sf_dir, "events").withColumn("other", F.expr(OTHER).cast("double")).withColumn("value", F.expr(VALUE).cast("double"))
    return both.select("user_id", "ts", "event_id", "value", "other")


def _two_sql(name: str) -> str:
    """The feature of the second series."""
    return feature_sql(name, "user_id").replace(VALUE, OTHER).replace('"value__', '"other__')


def _windowed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered features inside windows: the whole Efficient set."""
    settings = ExtractionSettings(["event_type"], ["value"], FeatureSetting.Efficient, dynamic_settings=DynamicGroupBySettings("ts", "10d", "10d"), order_cols=["ts", "event_id"])
    return rounded(extract_features(_series(spark, sf_dir), settings), ["event_type", "ts"])


def _windowed_sql() -> str:
    days = "CAST(floor(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 10.0) AS INTEGER) * 10"
    source = f"FROM (SELECT *, event_type || '@' || ({days}) AS slot FROM events))"
    return _joined_sql([feature_sql(n, "slot").replace("FROM events)", source) for n in config.defaults()], "slot").replace("SELECT *", "SELECT split_part(slot, '@', 1) AS event_type, DATE '1970-01-01' + CAST(split_part(slot, '@', 2) AS INTEGER) AS ts, * EXCLUDE (slot)", 1)


def _joined_sql(parts: list[str], key: str) -> str:
    named = [f"({p}) AS t{k}" for k, p in enumerate(parts)]
    return "SELECT * FROM " + " JOIN ".join([named[0], *(f"{p} USING ({key})" for p in named[1:])])


def _half_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows below a day, shifted, as text: engines name their kinds of timestamps in their own ways."""
    settings = ExtractionSettings(["event_type"], ["value"], FeatureSetting.Minimal, dynamic_settings=DynamicGroupBySettings("ts", "12h", "12h", "3h"), order_cols=["ts", "event_id"])
    found = extract_features(read_table(spark, sf_dir, "events"), settings, features={n: [{}] for n in ("length", "mean", "maximum")})
    return rounded(found.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), ["event_type", "ts"])


def _configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = ExtractionSettings(["event_type"], ["value"], config_path=CONFIG, order_cols=["ts", "event_id"])
    return rounded(extract_features(_series(spark, sf_dir), settings), ["event_type"])


def _written(df: DataFrame, **options: str | bool) -> str:
    """``df`` as CSV below the warehouse, which all executors share, until the interpreter ends."""
    spark = df.sparkSession
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/chronofold-csv-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).csv(path)

    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(remove)
    return path


def _csv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a header line, rows with any null dropped, rows filtered."""
    path = _written(_two(spark, sf_dir).select("user_id", "value", "other"), header=True)
    df = read_csv(spark, path, "user_id long, value double, other double", drop_nulls=True).where("value > -20")
    settings = ExtractionSettings(["user_id"], ["value", "other"], FeatureSetting.Minimal)
    return rounded(extract_features(df, settings, features={n: [{}] for n in ("length", "mean", "minimum")}), ["user_id"])


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``location;temperature`` without a header."""
    e = read_table(spark, sf_dir, "events")
    df = read_stations(spark, _written(e.select("event_type", "value"), sep=";"))
    settings = ExtractionSettings(["location"], ["temperature"], FeatureSetting.Minimal)
    return rounded(extract_features(df, settings, features={n: [{}] for n in ("length", "mean", "minimum", "maximum")}), ["location"])


#: Groups a (several values), b (one value), c (none).
ROWS = [("a", 1.0), ("a", 4.0), ("b", 2.5), ("a", 2.0), ("c", None)]
POINTS = [(1, 0.0, 0.5), (2, 9.0, 9.5), (3, 0.5, 0.0), (4, 9.5, 9.0), (5, 0.2, 0.2), (6, 9.1, 9.1), (7, None, 1.0)]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = from_rows(spark, ROWS, "id string, val double")
    return rounded(extract_features(df, ExtractionSettings(["id"], ["val"], order_cols=["ord"]), features={n: [{}] for n in ("length", "mean", "standard_deviation", "mean_change")}), ["id"])


def _no_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undefined features become nulls, and columns that hold one fall out."""
    return post.drop_null_columns(post.nan_to_null(_rows(spark, sf_dir).where("id <> 'c'"), ["id"]), ["id"])


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters that lie far apart, each named by its least id."""
    found = post.kmeans(from_rows(spark, POINTS, "id long, x double, y double"), ["x", "y"], 2)
    return found.select("id", F.min("id").over(Window.partitionBy("cluster")).alias("cluster"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming flag has no effect."""
    settings = ExtractionSettings(["user_id"], ["value"], FeatureSetting.Minimal, order_cols=["ts", "event_id"])
    return rounded(extract_features(_series(spark, sf_dir), settings, streaming=True), ["user_id"])


def _windows(every: str, period: str, offset: str = "0", text: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = read_table(spark, sf_dir, "orders")
        if text:
            o = o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
        dynamic = DynamicGroupBySettings("o_orderdate", every, period, offset, "%Y-%m-%d" if text else None)
        settings = ExtractionSettings(["o_custkey"], ["o_totalprice"], FeatureSetting.Minimal, dynamic_settings=dynamic, order_cols=["o_orderdate", "o_orderkey"])
        features = {n: [{}] for n in ("length", "sum_values", "mean", "minimum", "maximum")}
        return rounded(extract_features(o, settings, features=features), ["o_custkey", "o_orderdate"])

    return query


def _windows_sql(start: str, extra: str = "") -> str:
    return f"""
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders)
SELECT o_custkey, {start} AS o_orderdate, count(o_totalprice) AS length,
  round(sum(o_totalprice), 6) + 0.0 AS o_totalprice__sum_values, round(avg(o_totalprice), 6) + 0.0 AS o_totalprice__mean,
  round(min(o_totalprice), 6) + 0.0 AS o_totalprice__minimum, round(max(o_totalprice), 6) + 0.0 AS o_totalprice__maximum
FROM o {extra} GROUP BY ALL
"""


def _months(n: int, shift: int = 0) -> str:
    at = f"((m - {shift}) // {n} * {n} + {shift})"
    return f"make_date({at} // 12, {at} % 12 + 1, 1)"


def _multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = ExtractionSettings(["event_type", "user_id"], ["value"], order_cols=["ts", "event_id"])
    features = {n: [{}] for n in ("length", "sum_values", "linear_trend", "mean_change")}
    return rounded(extract_features(_series(spark, sf_dir), settings, features=features), ["event_type", "user_id"])


def _all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose values are all null stay: here all but those of one event type."""
    e = _series(spark, sf_dir).withColumn("value", F.expr("CASE WHEN event_type = 'click' THEN value END"))
    settings = ExtractionSettings(["event_type"], ["value"], order_cols=["ts", "event_id"])
    features = {n: [{}] for n in ("length", "mean", "median", "maximum", "mean_absolute_change")}
    return rounded(extract_features(e, settings, features=features), ["event_type"])


def _empty_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_features(_series(spark, sf_dir), ExtractionSettings(["user_id"], ["value"], order_cols=["ts", "event_id"]), features={})


def _sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    settings = ExtractionSettings(["user_id"], ["value"], FeatureSetting.Comprehensive, order_cols=["ts", "event_id"])
    return rounded(extract_features(e, settings, features={}), ["user_id"])


def _csv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal features of several value columns with rows dropped where any is null."""
    df = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount").na.drop("any")
    settings = ExtractionSettings(["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"], FeatureSetting.Minimal)
    return rounded(extract_features(df, settings, features={n: [{}] for n in ("length", "mean", "minimum", "maximum", "median")}), ["l_suppkey"], 4)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = ExtractionSettings(["user_id"], ["value"], FeatureSetting.Minimal, order_cols=["ts", "event_id"])
    return extract_features(_series(spark, sf_dir), settings, features={n: [{}] for n in ("mean", "standard_deviation", "minimum", "maximum", "root_mean_square")})


def _zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(post.zscore(_vectors(spark, sf_dir), ["user_id"]), ["user_id"])


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _vectors(spark, sf_dir)
    columns = [c for c in f.columns if c != "user_id"]
    found = post.cosine_top_k(f, columns, {c: float(k + 1) for k, c in enumerate(columns)}, 10, ["user_id"])
    return rounded(found.select("user_id", "similarity"), ["user_id"])


STATS = {"mean": "avg(x)", "standard_deviation": "stddev_samp(x)", "minimum": "min(x)", "maximum": "max(x)", "root_mean_square": "sqrt(avg(x * x))"}
_F = "WITH f AS (SELECT user_id, " + ", ".join(f"{e} AS value__{n}" for n, e in STATS.items()) + f" FROM (SELECT user_id, CAST({VALUE} AS DOUBLE) AS x FROM events) GROUP BY user_id)"
_Q = list(enumerate((f"value__{n}" for n in ("mean", "minimum", "maximum", "standard_deviation", "root_mean_square")), 1))

#: Long series suit the features that look far.
BY_TYPE = ("agg_linear_trend", "number_peaks", "linear_trend", "quantile")


def queries() -> dict[str, Query]:
    out = {f"feat_{n}": _feature(n, "event_type" if n in BY_TYPE else "user_id") for n in config.defaults()}
    out |= {
        "set_minimal": _set(FeatureSetting.Minimal, ["user_id"], lambda s, d: _series(s, d).drop("event_type")),
        "set_efficient": _set(FeatureSetting.Efficient, ["user_id"], lambda s, d: _series(s, d).drop("event_type")),
        "set_efficient_two_values": _set(FeatureSetting.Efficient, ["user_id"], _two),
        "set_comprehensive": _set(FeatureSetting.Comprehensive, ["user_id"], lambda s, d: _series(s, d).drop("event_type")),
        "dyn_1y": _windows("1y", "1y", "0y"),
        "dyn_3y_text": _windows("3y", "3y", "0y", text=True),
        "dyn_1mo_of_3mo": _windows("1mo", "3mo"),
        "dyn_7d": _windows("7d", "7d"),
        "dyn_1w": _windows("1w", "1w"),
        "dyn_gap": _windows("2mo", "1mo"),
        "dyn_offset_3mo": _windows("1y", "1y", "3mo"),
        "dyn_offset_2d": _windows("7d", "7d", "2d"),
        "dyn_12h": _half_days,
        "dyn_10d_efficient": _windowed_set,
        "config_file": _configured,
        "csv_drop_nulls_filter": _csv_header,
        "csv_stations": _stations,
        "frame_of_rows": _rows,
        "post_drop_null_columns": _no_null_columns,
        "post_kmeans": _clusters,
        "streaming_flag": _flagged,
        "feat_sample_entropy": _sample_entropy,
        "multi_key": _multi_key,
        "all_null_group": _all_null,
        "empty_config": _empty_config,
        "drop_nulls_minimal": _csv_shape,
        "post_zscore": _zscores,
        "post_cosine_top_k": _cosine,
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {f"feat_{n}": feature_sql(n, "event_type" if n in BY_TYPE else "user_id") for n in config.defaults()}
    minimal = {"length": "count(x)", "sum_values": "sum(x)", "mean": "avg(x)", "?median": MID, "minimum": "min(x)", "maximum": "max(x)", "standard_deviation": "stddev_samp(x)", "variance": "var_samp(x)", "skewness": "avg((x - mu) ** 3) / nullif(avg((x - mu) ** 2), 0) ** 1.5", "root_mean_square": "sqrt(avg(x * x))"}
    out["set_minimal"] = _sql("user_id", minimal)
    out["streaming_flag"] = out["set_minimal"]
    first = [feature_sql(n, "user_id") for n in config.defaults()]
    out["set_efficient"] = _joined_sql(first, "user_id")
    out["set_efficient_two_values"] = _joined_sql([*first, *(_two_sql(n) for n in config.defaults() if n != "length")], "user_id")
    out["dyn_10d_efficient"] = _windowed_sql()
    out["dyn_gap"] = _windows_sql("make_date(m // 12, m % 12 + 1, 1)", "WHERE m % 2 = 0")
    out["dyn_offset_3mo"] = _windows_sql(_months(12, 3))
    out["dyn_offset_2d"] = _windows_sql("DATE '1970-01-01' + CAST(floor((days - 2) / 7.0) AS INTEGER) * 7 + 2")
    out["dyn_12h"] = "SELECT event_type, strftime(to_timestamp(floor((epoch(ts) - 10800) / 43200) * 43200 + 10800) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ts, count(value) AS length, round(avg(value), 6) + 0.0 AS value__mean, round(max(value), 6) + 0.0 AS value__maximum FROM events GROUP BY ALL"
    out["config_file"] = _joined_sql([feature_sql(n, "event_type", p) for n, p in config.load(CONFIG).items()], "event_type")
    two = f"(SELECT user_id, CAST({VALUE} AS DOUBLE) AS a, CAST({OTHER} AS DOUBLE) AS b FROM events)"
    out["csv_drop_nulls_filter"] = f"SELECT user_id, count(a) AS length, round(avg(a), 6) + 0.0 AS value__mean, min(a) + 0.0 AS value__minimum, round(avg(b), 6) + 0.0 AS other__mean, min(b) + 0.0 AS other__minimum FROM {two} WHERE a IS NOT NULL AND b IS NOT NULL AND a > -20 GROUP BY user_id"
    out["csv_stations"] = "SELECT event_type AS location, count(value) AS length, round(avg(value), 6) + 0.0 AS temperature__mean, min(value) AS temperature__minimum, max(value) AS temperature__maximum FROM events GROUP BY event_type"
    nan = "'NaN'::DOUBLE"
    out["frame_of_rows"] = f"""SELECT * FROM (VALUES ('a', CAST(3 AS BIGINT), round(CAST(7 AS DOUBLE) / 3, 6), round(sqrt(CAST(7 AS DOUBLE) / 3), 6), CAST(0.5 AS DOUBLE)),
  ('b', 1, 2.5, {nan}, {nan}), ('c', 0, {nan}, {nan}, {nan})) AS t(id, length, val__mean, val__standard_deviation, val__mean_change)"""
    out["post_drop_null_columns"] = "SELECT * FROM (VALUES ('a', CAST(3 AS BIGINT), round(CAST(7 AS DOUBLE) / 3, 6)), ('b', 1, 2.5)) AS t(id, length, val__mean)"
    out["post_kmeans"] = "SELECT CAST(id AS BIGINT) AS id, CAST(cluster AS BIGINT) AS cluster FROM (VALUES (1, 1), (3, 1), (5, 1), (2, 2), (4, 2), (6, 2)) AS t(id, cluster)"
    out["dyn_1y"] = _windows_sql("make_date(year(d), 1, 1)")
    out["dyn_3y_text"] = _windows_sql(_months(36))
    out["dyn_1mo_of_3mo"] = _windows_sql("make_date((m - back) // 12, (m - back) % 12 + 1, 1)", ", (SELECT unnest([0, 1, 2]) AS back)")
    out["dyn_7d"] = _windows_sql("DATE '1970-01-01' + CAST(floor(days / 7.0) AS INTEGER) * 7")
    out["dyn_1w"] = _windows_sql("CAST(date_trunc('week', d) AS DATE)")
    series = f"(SELECT *, CAST({VALUE} AS DOUBLE) AS x FROM events)"
    out["multi_key"] = f"""
WITH v AS (SELECT event_type, user_id, x, CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY event_type, user_id, x IS NULL ORDER BY ts, event_id) - 1 END AS i FROM {series})
SELECT event_type, user_id, count(x) AS length, round(coalesce(sum(x), 'NaN'::DOUBLE), 6) + 0.0 AS value__sum_values,
  round(coalesce(regr_intercept(x, i), 'NaN'::DOUBLE), 6) + 0.0 AS value__linear_trend_intercept, round(coalesce(regr_slope(x, i), 'NaN'::DOUBLE), 6) + 0.0 AS value__linear_trend_slope,
  round(coalesce((arg_max(x, i) - arg_min(x, i)) / nullif(count(x) - 1, 0), 'NaN'::DOUBLE), 6) + 0.0 AS value__mean_change
FROM v GROUP BY event_type, user_id
"""
    out["all_null_group"] = f"""
WITH v AS (SELECT event_type, ts, event_id, CASE WHEN event_type = 'click' THEN x END AS x FROM {series}),
y AS (SELECT event_type, x, lead(x) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nx FROM v WHERE x IS NOT NULL)
SELECT v.event_type, count(v.x) AS length, round(coalesce(avg(v.x), 'NaN'::DOUBLE), 6) + 0.0 AS value__mean, round(quantile_cont(v.x, 0.5), 6) + 0.0 AS value__median,
  round(coalesce(max(v.x), 'NaN'::DOUBLE), 6) + 0.0 AS value__maximum,
  round(coalesce((SELECT avg(abs(nx - x)) FROM y WHERE y.event_type = v.event_type), 'NaN'::DOUBLE), 6) + 0.0 AS value__mean_absolute_change
FROM v GROUP BY v.event_type
"""
    out["feat_sample_entropy"] = """
WITH v AS (
  SELECT user_id, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c, row_number() OVER w AS i FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), g AS (SELECT user_id, 0.2 * stddev_samp(value) AS r FROM events GROUP BY user_id),
p AS (
  SELECT user_id, count(*) FILTER (abs(x.b - y.b) < r) AS m2, count(*) FILTER (abs(x.b - y.b) < r AND abs(x.c - y.c) < r) AS m3
  FROM v x JOIN v y USING (user_id) JOIN g USING (user_id) WHERE x.i < y.i AND abs(x.a - y.a) < r GROUP BY user_id
)
SELECT user_id, round(CASE WHEN coalesce(m2, 0) = 0 THEN 'NaN'::DOUBLE WHEN m3 = 0 THEN 'Infinity'::DOUBLE ELSE ln(m2 / CAST(m3 AS DOUBLE)) END, 6) + 0.0 AS value__sample_entropy
FROM g LEFT JOIN p USING (user_id)
"""
    # a null counts as not a number in the entropy, and makes it one
    rows = out["feat_sample_entropy"].replace("value AS a, lead(value, 1)", "x AS a, lead(x, 1)").replace("lead(value, 2)", "lead(x, 2)").replace("row_number() OVER w AS i FROM events", f"row_number() OVER w AS i FROM {series} WHERE x IS NOT NULL").replace("stddev_samp(value) AS r FROM events", f"stddev_samp(x) AS r FROM {series}")
    whole = f"SELECT user_id, CASE WHEN nulls > 0 THEN 'NaN'::DOUBLE ELSE value__sample_entropy END AS value__sample_entropy FROM ({rows}) JOIN (SELECT user_id, count(*) - count(x) AS nulls FROM {series} GROUP BY user_id) USING (user_id)"
    out["set_comprehensive"] = _joined_sql([*first, whole], "user_id")
    out["empty_config"] = "SELECT DISTINCT user_id FROM events"
    columns = ("l_quantity", "l_extendedprice", "l_discount")
    stats = {"mean": "avg({0})", "median": "quantile_cont({0}, 0.5)", "minimum": "min({0})", "maximum": "max({0})"}
    out["drop_nulls_minimal"] = "SELECT l_suppkey, count(l_quantity) AS length, " + ", ".join(f"round({e.format(f'CAST({c} AS DOUBLE)')}, 4) + 0.0 AS {c}__{n}" for c in columns for n, e in stats.items()) + f" FROM lineitem WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)} GROUP BY l_suppkey"
    out["post_zscore"] = _F + " SELECT user_id, " + ", ".join(f"round((value__{n} - avg(value__{n}) OVER ()) / nullif(stddev_samp(value__{n}) OVER (), 0), 6) + 0.0 AS value__{n}" for n in STATS) + " FROM f"
    dot = " + ".join(f"{c} * {k}" for k, c in _Q)
    norm = f"sqrt({' + '.join(f'{c} * {c}' for _, c in _Q)}) * sqrt({' + '.join(f'{k} * {k}.0' for k, _ in _Q)})"
    out["post_cosine_top_k"] = _F + f" SELECT user_id, round(similarity, 6) + 0.0 AS similarity FROM (SELECT user_id, ({dot}) / nullif({norm}, 0) AS similarity FROM f) ORDER BY similarity DESC, user_id LIMIT 10"
    return out
