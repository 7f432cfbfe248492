"""Literal cases for the features: small series by group, expected values by group."""

import math
import re

import pytest

from chronofold import DynamicGroupBySettings, ExtractionSettings, FeatureSetting, extract_features
from chronofold.config import defaults
from chronofold.sources.readers import from_rows

NAN = float("nan")
TEN, SEVEN = [1.0] * 10, [float(k) for k in range(1, 8)]

# (feature, parameters, series by group, {output suffix: values by group}). The results at borders (undefined,
# too short, equal or crossing values) have to be these; the other series are our own, worked out by hand.
CASES = [
    ("length", [{}], [[1.0], [1.0, 2.0], [1.0, None]], {"length": [1, 2, 1]}),
    ("sum_values", [{}], [[2.5], [4.0, -1.0], [0.5, 0.5, 7.0]], {"sum_values": [2.5, 3, 8]}),
    ("minimum", [{}], [[6.0], [3.0, -2.0, 8.0]], {"minimum": [6, -2]}),
    ("maximum", [{}], [[6.0], [3.0, -2.0, 8.0], [1.0, NAN]], {"maximum": [6, 8, NAN]}),
    ("absolute_energy", [{}], [[3.0], [2.0, -5.0]], {"absolute_energy": [9, 29]}),
    ("median", [{}], [[7.0], [2.0, 5.0], [9.0, 1.0, 4.0], [None]], {"median": [7, 3.5, 4, None]}),
    ("linear_trend", [{}], [[5.0, 5.0], [2.0, 6.0], [9.0, 7.0, 5.0]], {"linear_trend_intercept": [5, 2, 9], "linear_trend_slope": [0, 4, -2]}),
    ("has_duplicate_max", [{}], [[4.0], [4.0, 6.0], [6.0, 4.0, 6.0]], {"has_duplicate_max": [0, 0, 1]}),
    ("has_duplicate_min", [{}], [[4.0], [4.0, 6.0], [4.0, 6.0, 4.0]], {"has_duplicate_min": [0, 0, 1]}),
    ("has_duplicate", [{}], [[4.0], [4.0, 6.0], [4.0, 6.0, 4.0]], {"has_duplicate": [0, 0, 1]}),
    ("ratio_value_number_to_time_series_length", [{}], [[5.0, 6.0], [7.0] * 5], {"ratio_value_number_to_time_series_length": [1, 0.2]}),
    ("variation_coefficient", [{}], [[-3.0, 3.0]], {"variation_coefficient": [NAN]}),
    ("sum_of_reoccurring_values", [{}], [[5.0, 5.0, 2.0, 2.0, 2.0, 9.0]], {"sum_of_reoccurring_values": [7]}),
    ("sum_of_reoccurring_data_points", [{}], [[5.0, 5.0, 2.0, 2.0, 2.0, 9.0]], {"sum_of_reoccurring_data_points": [16]}),
    ("standard_deviation", [{}], [[4.0] * 3, [4.0], [1.0, 3.0]], {"standard_deviation": [0, NAN, math.sqrt(2)]}),
    ("variance", [{}], [[4.0] * 3, [4.0], [1.0, 3.0]], {"variance": [0, NAN, 2]}),
    ("variance_larger_than_standard_deviation", [{}], [[-1.0, -1.0, 1.0, 1.0, 1.0], [-1.0, -1.0, 0.1, 0.1, 0.1], [1.0]], {"variance_larger_than_standard_deviation": [1, 0, None]}),
    ("large_standard_deviation", [{"r": 0.25}, {"r": 0.5}, {"r": 0.7}], [[-1.0, -1.0, 1.0, 1.0]], {"large_standard_deviation__r_0.25": [1], "large_standard_deviation__r_0.50": [1], "large_standard_deviation__r_0.70": [0]}),
    ("symmetry_looking", [{"r": 0.05}], [[-1.0, -1.0, 1.0, 1.0], [-1.0] * 4 + [1.0], [-2.0] * 3 + [-1.0] * 3, [-0.9, -0.900001]], {"symmetry_looking__r_0.05": [1, 0, 1, 1]}),
    ("percentage_of_reoccurring_values_to_all_values", [{}], [[3.0, 3.0, 8.0], [1.0, 2.0, 5.0, 5.0]], {"percentage_of_reoccurring_values_to_all_values": [0.5, 1 / 3]}),
    ("percentage_of_reoccurring_values_to_all_datapoints", [{}], [[3.0, 3.0, 8.0], [1.0, 2.0, 5.0, 5.0]], {"percentage_of_reoccurring_values_to_all_datapoints": [1 / 3, 0.25]}),
    ("agg_linear_trend", [{"chunk_size": 5, "aggregator": "mean"}], [[1.0, 1.0], [2.0] * 5 + [3.0] * 3], {"agg_linear_trend_intercept__chunk_size_5__agg_mean": [NAN, 2], "agg_linear_trend_slope__chunk_size_5__agg_mean": [NAN, 1]}),
    ("agg_linear_trend", [{"chunk_size": 2, "aggregator": "var"}], [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0]], {"agg_linear_trend_intercept__chunk_size_2__agg_var": [NAN, 0.5], "agg_linear_trend_slope__chunk_size_2__agg_var": [NAN, 0]}),
    ("mean_n_absolute_max", [{"n": 7}], [[1.0, 1.0], SEVEN], {"mean_n_absolute_max__n_7": [NAN, 4]}),
    ("mean_change", [{}], [[4.0, 4.0], [1.0, 3.0, 9.0], [1.0]], {"mean_change": [0, 4, NAN]}),
    ("number_crossing_m", [{"m": 0.0}], [[1.0, 1.0], [-1.0, 2.0, 3.0, -4.0, -5.0, -6.0, 7.0], [1.0, 0.0, -1.0], [1.0, 0.0, 1.0, 0.0, -1.0, 0.0, -1.0]], {"number_crossing_m__m_0.0": [0, 3, 1, 1]}),
    ("number_crossing_m", [{"m": 1.0}], [[0.0, 1.0], [0.0, 1.0, -3.0, -4.0, -5.0, 6.0, 7.0], [2.0, NAN, 3.0], [2.0, 0.0, NAN]], {"number_crossing_m__m_1.0": [0, 1, NAN, 1]}),
    ("number_crossing_m", [{"m": -1.0}], [[-1.0, -1.0], [1.0, 2.0, -3.0, -4.0, -5.0, 6.0, 7.0]], {"number_crossing_m__m_-1.0": [0, 2]}),
    ("range_count", [{"min": -1.0, "max": 1.0}, {"min": 1.0, "max": 0.0}], [[2.0, 0.0, -2.0], [1.0, 0.0, 1.0, 0.0, -2.0, 0.0, -2.0]], {"range_count__min_-1.0__max_1.0": [1, 5], "range_count__min_1.0__max_0.0": [NAN, NAN]}),
    ("index_mass_quantile", [{"q": 0.5}, {"q": 1.0}], [[1.0] * 4, [1.0, 1.0, 0.0, 0.0, 0.0], [0.0]], {"index_mass_quantile__q_0.5": [0.5, 0.2, NAN], "index_mass_quantile__q_ 1": [1, 0.4, NAN]}),
    ("c3", [{"lag": k} for k in (1, 2)], [TEN, [1.0, 2.0, -3.0, 4.0]], {"c3__lag_1": [1, -15], "c3__lag_2": [1, 0]}),
    ("time_reversal_asymmetry_statistic", [{"lag": k} for k in (1, 2)], [TEN, [1.0, 2.0, -3.0, 4.0]], {"time_reversal_asymmetry_statistic__lag_1": [0, -10], "time_reversal_asymmetry_statistic__lag_2": [0, 0]}),
    ("number_peaks", [{"n": 1}, {"n": 3}, {"n": 5}], [[0.0, 1.0, 2.0, 1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 4.0, 3.0, 2.0, 1.0]], {"number_peaks__n_1": [2], "number_peaks__n_3": [1], "number_peaks__n_5": [0]}),
    ("cid_ce", [{"normalize": True}, {"normalize": False}], [[1.0], [2.0, 2.0], [1.0, 3.0]], {"cid_ce__normalize_t": [0, NAN, math.sqrt(2)], "cid_ce__normalize_f": [0, 0, 2]}),
    ("longest_strike_above_mean", [{}], [[1.0, 2.0, 1.0, 2.0, 2.0], [1.0, 1.0]], {"longest_strike_above_mean": [2, 0]}),
    ("autocorrelation", [{"lag": 0}, {"lag": 3}], [[1.0, 2.0, 3.0], [2.0, 2.0]], {"autocorrelation__lag_0": [2 / 3, NAN], "autocorrelation__lag_3": [NAN, NAN]}),
    ("quantile", [{"q": 0.5}, {"q": 0.3}], [[4.0, 1.0, 2.0], [1.0, 2.0], [None]], {"quantile__q_0.5": [2, 1.5, None], "quantile__q_0.3": [1.5, 1.5, None]}),
    ("skewness", [{}], [[1.0, 2.0, 4.0, 9.0], [1.0]], {"skewness": [22.5 / 9.5**1.5, NAN]}),
    ("kurtosis", [{}], [[1.0, 2.0, 4.0, 9.0], [1.0, 1.0]], {"kurtosis": [180.5 / 9.5**2, NAN]}),
    ("count_below", [{"t": 0.0}], [[-1.0, 1.0, 2.0]], {"count_below__t_0.0": [1]}),
    ("ratio_beyond_r_sigma", [{"r": 1.0}], [[1.0], [0.0, 0.0, 0.0, 9.0]], {"ratio_beyond_r_sigma__r_1.00": [0, 0.25]}),
]


def by_group(df, key="id"):
    return sorted(df.collect(), key=lambda r: r[key])


@pytest.mark.parametrize("feature, parameters, series, expected", CASES, ids=[f"{c[0]}-{k}" for k, c in enumerate(CASES)])
def test_feature(spark, feature, parameters, series, expected):
    df = from_rows(spark, [(f"{g:02}", x) for g, s in enumerate(series) for x in s], "id string, val double")
    got = by_group(extract_features(df, ExtractionSettings(["id"], ["val"], order_cols=["ord"]), features={feature: parameters}))
    for suffix, values in expected.items():
        name = suffix if suffix == "length" else f"val__{suffix}"
        for row, want in zip(got, values, strict=True):
            if want is None or isinstance(want, float) and math.isnan(want):
                assert row[name] is None if want is None else math.isnan(row[name]), (name, row)
            else:
                assert row[name] == pytest.approx(want, rel=1e-3), (name, row)


def test_default_set_has_all_columns_in_order(spark):
    df = from_rows(spark, [("a", 1.0, 4.0), ("a", 2.0, 5.0), ("b", None, 6.0)], "id string, val double, value double")
    out = extract_features(df, ExtractionSettings(["id"], ["val", "value"], order_cols=["ord"]))
    assert len(out.columns) == 314
    assert out.columns[:4] == ["id", "length", "val__sum_values", "val__mean"]
    assert out.columns.index("value__root_mean_square") < out.columns.index("val__kurtosis")
    rows = by_group(out)
    assert [r["length"] for r in rows] == [2, 0]
    assert math.isnan(rows[1]["val__mean"]) and rows[1]["val__median"] is None and rows[1]["value__mean"] == 6
    assert len(extract_features(df, ExtractionSettings(["id"], ["val"], FeatureSetting.Minimal)).columns) == 11
    assert "val__sample_entropy" in extract_features(df, ExtractionSettings(["id"], ["val"], FeatureSetting.Comprehensive)).columns


def test_empty_input_null_keys_and_two_keys(spark):
    empty = from_rows(spark, [], "id string, val double")
    assert extract_features(empty, ExtractionSettings(["id"], ["val"], order_cols=["ord"])).count() == 0
    df = from_rows(spark, [(None, 1, 1), (None, 1, 3), ("a", 1, 5)], "id string, id2 int, val int")
    got = extract_features(df, ExtractionSettings(["id", "id2"], ["val"], order_cols=["ord"]), features={"mean": [{}], "linear_trend": [{}]}).collect()
    assert {(r["id"], r["val__mean"], r["val__linear_trend_slope"]) for r in got if r["id"] is None} == {(None, 2.0, 2.0)}


def test_rows_follow_the_given_order(spark):
    df = spark.createDataFrame([("a", 3, 3.0), ("a", 1, 1.0), ("a", 2, 2.0)], "id string, t int, val double")
    up = extract_features(df, ExtractionSettings(["id"], ["val"], order_cols=["t"]), features={"linear_trend": [{}]}).first()
    assert up["val__linear_trend_slope"] == 1


def test_long_constant_series(spark):
    df = spark.range(200_002).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS id", "CAST(id % 2 AS DOUBLE) AS val", "id AS ord")
    got = by_group(extract_features(df, ExtractionSettings(["id"], ["val"], order_cols=["ord"]), features={"mean": [{}], "linear_trend": [{}]}))
    assert [r["val__mean"] for r in got] == [0, 1]


def test_tasks_grow_with_the_input(spark):
    """Planned only: left to itself Spark takes one task for each core, however many rows there are."""

    def tasks(rows, *values):
        df = spark.range(rows).selectExpr("id % 1000 AS key", "id AS ord", *(f"CAST(id % 7 AS DOUBLE) AS {v}" for v in values))
        out = extract_features(df, ExtractionSettings(["key"], list(values), order_cols=["ord"]), features={"mean_change": [{}]})
        return re.findall(r"RepartitionByExpression \[[^]]*\](?:, (\d+))?", out._jdf.queryExecution().analyzed().toString())

    assert tasks(1000, "a") == [""]
    one, two, both = (int(tasks(*args)[0]) for args in ((20_000_000, "a"), (40_000_000, "a"), (20_000_000, "a", "b")))
    assert one > 4 and abs(two - 2 * one) <= 1 and both >= 2 * one - 1


DATES = ["2001-01-01", "2002-01-01", "2003-01-01"]


def dated(spark, values):
    return from_rows(spark, [(g, d, v) for g in "ab" for d, v in zip(DATES, values)], "id string, time string, val double")


def test_windows_of_three_years_share_an_origin_at_year_zero(spark):
    settings = ExtractionSettings(["id"], ["val"], dynamic_settings=DynamicGroupBySettings("time", "3y", "3y", "0y", "%Y-%m-%d"))
    out = extract_features(dated(spark, [1.0, 2.0, 3.0]), settings, features={"length": [{}], "sum_values": [{}], "mean_change": [{}]})
    assert out.columns == ["id", "time", "length", "val__sum_values", "val__mean_change"]
    assert [(str(r["time"]), r["length"], r["val__sum_values"], r["val__mean_change"]) for r in by_group(out)] == [("2001-01-01", 3, 6.0, 1.0)] * 2


def test_yearly_windows_keep_groups_without_values(spark):
    settings = ExtractionSettings(["id"], ["val"], FeatureSetting.Minimal, dynamic_settings=DynamicGroupBySettings("time", "1y", "1y", "0", "%Y-%m-%d"))
    rows = extract_features(dated(spark, [1.0, 2.0, None]), settings).orderBy("id", "time").collect()
    assert len(rows) == 6 and rows[1]["val__mean"] == 2 and math.isnan(rows[2]["val__mean"])


def test_bad_settings_raise(spark):
    df = from_rows(spark, [("a", 1.0)], "id string, val double")
    with pytest.raises(ValueError):
        ExtractionSettings(["id"], [])
    with pytest.raises(ValueError):
        ExtractionSettings(["id"], ["id"])
    with pytest.raises(ValueError):
        extract_features(df, ExtractionSettings(["id"], ["val"]), features={"quantile": [{"q": 0.25}, {"q": 0.2}, {"q": 0.22}]})
    assert set(defaults()) and len(defaults()) == 51
