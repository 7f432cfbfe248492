"""Random series against plain numpy, with nulls, ties, constants and very short ones."""

import math

import numpy as np
import pytest

from chronofold import ExtractionSettings, FeatureSetting, extract_features
from chronofold.extract import sample_entropy
from chronofold.sources.readers import from_rows


def entropy_twin(x):
    r = 0.2 * np.std(x, ddof=1)
    counts = []
    for m in (2, 3):
        t = [x[i : i + m] for i in range(len(x) - m + 1)]
        counts.append(sum(bool((np.abs(t[i] - t[j]) < r).all()) for i in range(len(t)) for j in range(i)))
    with np.errstate(all="ignore"):
        return float(np.log(np.float64(counts[0]) / np.float64(counts[1])))


def test_sample_entropy_matches_pairs_in_any_block():
    rng = np.random.default_rng(1)
    for n in (3, 4, 17, 60):
        x = rng.integers(0, 6, n).astype(float)
        for block in (1, 7, 512):
            assert sample_entropy(x, block=block) == pytest.approx(entropy_twin(x), nan_ok=True)


def test_random_series(spark):
    rng = np.random.default_rng(3)
    series = [list(map(float, rng.integers(-5, 6, n))) for n in (1, 2, 3, 12, 60, 130)] + [[2.0] * 5, [None, 1.0, None, 3.0, 3.0]]
    df = from_rows(spark, [(f"{g:02}", x) for g, s in enumerate(series) for x in s], "id string, val double")
    got = sorted(extract_features(df, ExtractionSettings(["id"], ["val"], FeatureSetting.Comprehensive, order_cols=["ord"])).collect(), key=lambda r: r["id"])
    with np.errstate(all="ignore"):
        for row, s in zip(got, series):
            x = np.array([v for v in s if v is not None])
            n, d = len(x), np.diff(x)
            want = {
                "root_mean_square": math.sqrt((x**2).mean()), "mean_absolute_change": np.abs(d).mean() if n > 1 else math.nan, "absolute_sum_of_changes": np.abs(d).sum(),
                "count_above_mean": (x > x.mean()).sum(), "first_location_of_maximum": x.argmax() / n, "last_location_of_minimum": 1 - x.argmin() / n, "absolute_maximum": np.abs(x).max(),
            }
            for q in (0.1, 0.3, 0.7):
                want[f"quantile__q_{q}"] = np.quantile(x, q, method="midpoint")
            for lag in (0, 1, 5):
                c = x - x.mean()
                v = x.var(ddof=1) if n > 1 else math.nan
                want[f"autocorrelation__lag_{lag}"] = (c[: n - lag] * c[lag:]).sum() / ((n - lag) * v) if n > lag and v else math.nan
            for name, v in want.items():
                assert row[f"val__{name}"] == pytest.approx(v, nan_ok=True), (name, s)
