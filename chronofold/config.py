"""Which features are extracted with which parameters, read from TOML.

A section enables a feature; features with parameters need ``parameters``, an
array of tables. A file replaces the defaults, it isn't merged with them.
"""

from __future__ import annotations

import tomllib
from pathlib import Path

DEFAULT_PATH = ".chronofold.toml"

# The names of the features, in the order of their columns.
MINIMAL = ["length", "sum_values", "mean", "median", "minimum", "maximum", "standard_deviation", "variance", "skewness", "root_mean_square"]
EFFICIENT = [
    "kurtosis", "absolute_energy", "mean_absolute_change", "linear_trend", "variance_larger_than_standard_deviation", "ratio_beyond_r_sigma", "large_standard_deviation", "symmetry_looking",
    "has_duplicate_max", "has_duplicate_min", "cid_ce", "absolute_maximum", "absolute_sum_of_changes", "count_above_mean", "count_below_mean", "count_above", "count_below",
    "first_location_of_maximum", "first_location_of_minimum", "last_location_of_maximum", "last_location_of_minimum", "longest_strike_above_mean", "longest_strike_below_mean", "has_duplicate",
    "variation_coefficient", "mean_change", "ratio_value_number_to_time_series_length", "sum_of_reoccurring_values", "sum_of_reoccurring_data_points",
    "percentage_of_reoccurring_values_to_all_values", "percentage_of_reoccurring_values_to_all_datapoints", "agg_linear_trend", "mean_n_absolute_max", "autocorrelation", "quantile",
    "number_crossing_m", "range_count", "index_mass_quantile", "c3", "time_reversal_asymmetry_statistic", "number_peaks",
]

_TWENTIETHS = [{"r": k / 20} for k in range(1, 20)]

# The default parameters.
PARAMETERS: dict[str, list[dict]] = {
    "ratio_beyond_r_sigma": [{"r": r} for r in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 6.0, 7.0, 10.0)],
    "large_standard_deviation": _TWENTIETHS,
    "symmetry_looking": _TWENTIETHS,
    "cid_ce": [{"normalize": True}, {"normalize": False}],
    "count_above": [{"t": 0.0}],
    "count_below": [{"t": 0.0}],
    "agg_linear_trend": [{"chunk_size": c, "aggregator": a} for c in (5, 10, 50) for a in ("mean", "min", "max", "var")],
    "mean_n_absolute_max": [{"n": 7}],
    "autocorrelation": [{"lag": k} for k in range(10)],
    "quantile": [{"q": q} for q in (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)],
    "number_crossing_m": [{"m": m} for m in (-1.0, 0.0, 1.0)],
    "range_count": [{"min": -1.0, "max": 1.0}, {"min": -1e12, "max": 0.0}, {"min": 0.0, "max": 1e12}],
    "index_mass_quantile": [{"q": k / 10} for k in range(1, 10)],
    "c3": [{"lag": k} for k in (1, 2, 3)],
    "time_reversal_asymmetry_statistic": [{"lag": k} for k in (1, 2, 3)],
    "number_peaks": [{"n": n} for n in (1, 3, 5, 10, 50)],
}
#: Parameters that are whole numbers and must be at least so large.
_LEAST = {("agg_linear_trend", "chunk_size"): 1, ("mean_n_absolute_max", "n"): 1, ("number_peaks", "n"): 1, ("autocorrelation", "lag"): 0, ("c3", "lag"): 0, ("time_reversal_asymmetry_statistic", "lag"): 0}
AGGREGATORS = ("mean", "min", "max", "var")


def defaults() -> dict[str, list[dict]]:
    return {name: PARAMETERS.get(name, [{}]) for name in (*MINIMAL, *EFFICIENT)}


def load(path: str | None = None) -> dict[str, list[dict]]:
    """Features and their parameter sets; the defaults where no file is given and none lies in the working folder."""
    if path is None:
        if not Path(DEFAULT_PATH).exists():
            return defaults()
        path = DEFAULT_PATH
    elif not Path(path).exists():
        return defaults()
    try:
        with open(path, "rb") as f:
            sections = tomllib.load(f)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path} is not valid TOML: {e}") from e
    return {name: _checked(name, section) for name, section in sections.items() if name in (*MINIMAL, *EFFICIENT)}


def _checked(name: str, section: dict) -> list[dict]:
    if name not in PARAMETERS:
        return [{}]
    given = section.get("parameters")
    if not isinstance(given, list) or not given:
        raise ValueError(f"[{name}] needs a list of parameters")
    kinds = PARAMETERS[name][0]
    out = []
    for p in given:
        if not kinds.keys() <= p.keys():
            raise ValueError(f"[{name}] needs {', '.join(kinds)}, not {p}")
        p = {k: float(p[k]) if isinstance(kinds[k], float) else p[k] for k in kinds}
        for k, v in p.items():
            least = _LEAST.get((name, k))
            if least is not None and (isinstance(v, bool) or not isinstance(v, int) or v < least):
                raise ValueError(f"[{name}] {k} must be a whole number of at least {least}, not {v!r}")
        if name == "agg_linear_trend" and p["aggregator"] not in AGGREGATORS:
            raise ValueError(f"[{name}] aggregator must be one of {', '.join(AGGREGATORS)}, not {p['aggregator']!r}")
        if name in ("quantile", "index_mass_quantile") and not 0 <= p["q"] <= 1:
            raise ValueError(f"[{name}] q must be from 0 to 1, not {p['q']}")
        out.append(p)
    return out
