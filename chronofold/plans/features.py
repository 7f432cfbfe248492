"""The features, as columns over three kinds of intermediate results.

``Build`` collects what the chosen features of one value column need:

- group aggregates over the input as it is (``a``): order-free, partially
  aggregated before the shuffle, there for every group;
- series rows (``row``): window columns over one value column's non-null values,
  all partitioned by the group, so that one exchange serves all of them;
- series aggregates (``s``): group aggregates over those rows.

A feature returns (suffix, expression) pairs over ``a`` and ``s`` results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from chronofold.functions import text as F
from chronofold.functions.text import Text, eq, flag, gt, nan, try_divide

Output = tuple[str, Text]


def _once(method):
    """Remember a method's expression by its arguments."""

    @functools.wraps(method)
    def remembered(self, *args):
        key = (method.__name__, *args)
        if key not in self.made:
            self.made[key] = method(self, *args)
        return self.made[key]

    return remembered


class Build:
    """What one value column needs; ``at`` is its number."""

    def __init__(self, at: int, value: str, partition: list[str], order: list[str], ranked: bool):
        self.at, self.value, self.ranked = at, F.named(value).cast("double"), ranked
        self.made: dict[tuple, Text] = {}
        self.aggregates: dict[str, Text] = {}
        self.series: dict[str, Text] = {}
        #: Window columns by stage; a stage may use those before it.
        self.rows: dict[str, dict[str, Text]] = {"value": {}, "size": {}, "all": {}, "order": {}, "after": {}, "chunk": {}}
        self.group = F.partition(*partition)
        self.ordered = F.ordered(self.group, *(f"`{c}`" for c in order))
        self.by_value = F.ordered(self.group, "x")
        self.same_value = F.partition(*partition, "x")
        self.by_size = F.ordered(self.group, "abs(x) DESC")
        self.partition = partition

    def a(self, name: str, column: Text) -> Text:
        self.aggregates[f"a{self.at}_{name}"] = column
        return F.col(f"a{self.at}_{name}")

    def s(self, name: str, column: Text) -> Text:
        self.series[name] = column
        return F.col(f"s{self.at}.{name}")

    @_once
    def spread(self) -> Text:
        return self.maximum() - self.minimum()

    @_once
    def skew(self) -> Text:
        """Distance of mean and median."""
        return F.abs(self.mean() - self.median())

    @_once
    def far(self) -> Text:
        """Distance from the mean; like ``sd`` taken in the series' order, for where the two are equal their last bits decide."""
        return F.abs(F.col("x") - self.row("order", "center", F.avg("x").over(F.whole(self.ordered))))

    @_once
    def some(self) -> Text:
        return self.n() > 0

    def row(self, stage: str, name: str, column: Text) -> Text:
        self.rows[stage][name] = column
        return F.col(name)

    # shared group aggregates
    @_once
    def n(self) -> Text:
        return self.a("n", F.count(self.value))

    @_once
    def mean(self) -> Text:
        return self.a("mean", F.avg(self.value))

    @_once
    def variance(self) -> Text:
        return self.a("var", F.var_samp(self.value))

    @_once
    def deviation(self) -> Text:
        return self.a("std", F.stddev_samp(self.value))

    @_once
    def maximum(self) -> Text:
        return self.a("max", F.max(self.value))

    @_once
    def minimum(self) -> Text:
        low = self.a("min", F.min(self.value))
        return F.when(F.isnan(self.maximum()), nan()).otherwise(low)

    @_once
    def median(self) -> Text:
        return self.quantile(0.5, "median") if self.ranked else self.a("median", F.median(self.value))

    @_once
    def quantile(self, q: float, name: str) -> Text:
        """Midpoint rule: the mean of the two neighbours of (n - 1) * q."""
        rank, place = self.rank(), (self.size() - 1) * F.lit(q)
        low = self.s(f"{name}_lo", F.max(F.when(rank == F.floor(place), F.col("x"))))
        high = self.s(f"{name}_hi", F.max(F.when(rank == F.ceil(place), F.col("x"))))
        return low / 2 + high / 2

    # shared window columns
    @_once
    def index(self) -> Text:
        return self.row("order", "i", F.row_number().over(self.ordered) - 1)

    @_once
    def size(self) -> Text:
        return self.row("all", "n", F.count(F.lit(1)).over(self.group))

    @_once
    def mu(self) -> Text:
        return self.row("all", "mu", F.avg("x").over(self.group))

    @_once
    def sd(self) -> Text:
        """The running formula that SQL engines use, x with itself: stddev_samp rounds in another way."""
        return self.row("order", "sd", F.sqrt(F.covar_samp("x", "x").over(F.whole(self.ordered))))

    @_once
    def mx(self) -> Text:
        return self.row("all", "mx", F.max("x").over(self.group))

    @_once
    def mn(self) -> Text:
        return self.row("all", "mn", F.when(F.max(F.isnan("x")).over(self.group), nan()).otherwise(F.min("x").over(self.group)))

    @_once
    def rank(self) -> Text:
        return self.row("value", "rank", F.row_number().over(self.by_value) - 1)

    @_once
    def freq(self) -> Text:
        return self.row("value", "freq", F.count(F.lit(1)).over(self.same_value))

    @_once
    def is_first(self) -> Text:
        """One row of each distinct value: that with the lowest rank among its equals."""
        return self.row("value", "once", F.row_number().over(F.ordered(self.same_value, "x")) == 1)

    @_once
    def lead(self, k: int) -> Text:
        return F.col("x") if k == 0 else self.row("order", f"lead{k}", F.lead("x", k).over(self.ordered))

    @_once
    def change(self) -> Text:
        return self.lead(1) - F.col("x")


def _x() -> Text:
    return F.col("x")


def _sum(c: Text) -> Text:
    return F.sum(c.cast("double"))


def _counted(name: str, condition: Callable[[Build, dict], Text], names: Callable[[dict], str] | None = None):
    """A feature that counts values for which a condition over the input holds."""

    def feature(b: Build, parameters: list[dict]) -> list[Output]:
        out = []
        for k, p in enumerate(parameters):
            out.append((name + (names(p) if names else ""), b.a(f"{name}_{k}", _sum(condition(b, p)))))
        return out

    return feature


def _simple(name: str, make: Callable[[Build], Text]):
    return lambda b, _: [(name, make(b))]


def _each(name: str, make: Callable[[Build, dict], Text], names: Callable[[dict], str]):
    return lambda b, parameters: [(f"{name}__{names(p)}", make(b, p)) for p in parameters]


def _linear_trend(b: Build, _: list[dict]) -> list[Output]:
    i = b.index().cast("double")
    return [("linear_trend_intercept", b.s("lt_i", F.regr_intercept(_x(), i))), ("linear_trend_slope", b.s("lt_s", F.regr_slope(_x(), i)))]


def _beyond(b: Build, p: dict) -> Text:
    far = gt(b.far(), b.sd() * p["r"])
    return b.s(f"beyond_{p['r']}".replace(".", "_"), F.avg(flag(far)))


def _cid(b: Build, p: dict) -> Text:
    total = F.sqrt(F.coalesce(b.s("sq_change", F.sum(b.change() * b.change())), F.lit(0.0)))
    return F.when(b.n() == 1, F.lit(0.0)).otherwise(try_divide(total, b.deviation())) if p["normalize"] else total


def _first(b: Build, name: str, best: Text) -> Text:
    return try_divide(b.s(name, F.min(F.when(eq(_x(), best), b.index()))).cast("double"), b.n().cast("double"))


def _strike(b: Build, name: str, holds: Text) -> Text:
    """Longest run of rows for which ``holds``: distance to the last row where it doesn't."""
    i = b.index()
    broken = F.last_value(F.when(~F.coalesce(holds, F.lit(False)), i)).over(F.rows(b.ordered, None, 0))
    last = b.row("after", f"{name}_last", broken)
    return F.coalesce(b.s(name, F.max(i - F.coalesce(last, F.lit(-1)))).cast("double"), F.lit(0.0))


def _repeats(b: Build, name: str, value: Text) -> Text:
    return b.s(name, F.sum(F.when(b.is_first() & (b.freq() > 1), value.cast("double")).otherwise(0.0)))


def _distinct(b: Build) -> Text:
    return b.s("distinct", _sum(b.is_first()))


def _chunk_trend(b: Build, parameters: list[dict]) -> list[Output]:
    out = []
    for p in parameters:
        c, a = p["chunk_size"], p["aggregator"]
        chunk = b.row("after", f"chunk{c}", F.floor(b.index() / F.lit(c)).cast("int"))
        over = F.partition(*b.partition, f"chunk{c}")
        made = {"mean": F.avg("x"), "max": F.max("x"), "min": F.min("x"), "var": F.var_samp("x")}[a].over(over)
        if a == "min":
            made = F.when(F.max(F.isnan("x")).over(over), nan()).otherwise(made)
        value = b.row("chunk", f"chunk{c}_{a}", F.coalesce(made, nan()))
        first, at = b.index() % c == 0, chunk.cast("double")
        enough = b.n() >= c
        for part, regr in (("intercept", F.regr_intercept), ("slope", F.regr_slope)):
            fit = b.s(f"trend_{part}_{c}_{a}", regr(F.when(first, value), F.when(first, at)))
            out.append((f"agg_linear_trend_{part}__chunk_size_{c}__agg_{a}", F.when(enough, fit)))
    return out


def _largest(b: Build, p: dict) -> Text:
    rank = b.row("size", "size_rank", F.row_number().over(b.by_size))
    return F.when(b.n() >= p["n"], b.s(f"largest_{p['n']}", F.avg(F.when(rank <= p["n"], F.abs(_x())))))


def _autocorrelation(b: Build, p: dict) -> Text:
    k = p["lag"]
    total = b.s(f"auto_{k}", F.sum((_x() - b.mu()) * (b.lead(k) - b.mu())))
    return F.when(b.n() > k, try_divide(total, (b.n() - k) * b.variance()))


def _number(v: float) -> str:
    return f"{v}".replace(".", "_").replace("-", "m").replace("+", "")


def _crossings(b: Build, p: dict) -> Text:
    m, name = F.lit(p["m"]), _number(p["m"])
    off = (_x() != m) | F.isnan(_x())
    before = b.row("order", f"before_{name}", F.last_value(F.when(off, _x())).over(F.rows(b.ordered, None, -1)))
    crossed = (gt(_x(), m) & gt(m, before)) | (gt(m, _x()) & gt(before, m))
    count = b.s(f"cross_{name}", F.sum(flag(crossed)))
    # NaN is allowed in the last place only
    bad = b.s(f"cross_nan_{name}", F.max(flag(F.isnan(before) & off)))
    return F.when(bad > 0, nan()).otherwise(count)


def _mass(b: Build, p: dict) -> Text:
    so_far = b.row("order", "mass", F.sum(F.abs("x")).over(F.rows(b.ordered, None, 0)))
    total = b.row("all", "total_mass", F.sum(F.abs("x")).over(b.group))
    reached = ~gt(F.lit(p["q"]), try_divide(so_far, total)) & ~F.isnan(try_divide(so_far, total))
    first = b.s(f"mass_{_number(p['q'])}", F.min(F.when(reached, b.index())))
    some = b.a("mass", F.sum(F.abs(b.value)))
    return F.when(some == 0, nan()).otherwise(try_divide(F.coalesce(first, F.lit(0)) + 1.0, b.n().cast("double")))


def _c3(b: Build, p: dict) -> Text:
    k = p["lag"]
    mean = b.s(f"c3_{k}", F.avg(_x() * b.lead(k) * b.lead(2 * k)))
    return F.when(b.n() <= 2 * k, F.lit(0.0)).otherwise(mean)


def _reversal(b: Build, p: dict) -> Text:
    k = p["lag"]
    far, near = b.lead(2 * k), b.lead(k)
    mean = b.s(f"reversal_{k}", F.avg(far * far * near - near * _x() * _x()))
    return F.when(b.n() <= 2 * k, F.lit(0.0)).otherwise(mean)


def _peaks(b: Build, p: dict) -> Text:
    n = p["n"]
    left = b.row("order", f"left{n}", F.max("x").over(F.rows(b.ordered, -n, -1)))
    right = b.row("order", f"right{n}", F.max("x").over(F.rows(b.ordered, 1, n)))
    peak = gt(_x(), left) & gt(_x(), right) & (b.index() >= n) & (b.index() < b.size() - n)
    return b.s(f"peaks_{n}", F.sum(flag(peak)))


def _range(b: Build, p: dict) -> Text:
    lo, hi = p["min"], p["max"]
    if hi < lo:
        return nan()
    inside = (b.value >= lo) & (b.value <= hi) & ~F.isnan(b.value)
    return b.a(f"range_{_number(lo)}_{_number(hi)}", _sum(inside))


FEATURES: dict[str, Callable[[Build, list[dict]], list[Output]]] = {
    "sum_values": _simple("sum_values", lambda b: b.a("sum", F.sum(b.value))),
    "mean": _simple("mean", Build.mean),
    "median": _simple("median", Build.median),
    "minimum": _simple("minimum", Build.minimum),
    "maximum": _simple("maximum", Build.maximum),
    "standard_deviation": _simple("standard_deviation", Build.deviation),
    "variance": _simple("variance", Build.variance),
    "skewness": _simple("skewness", lambda b: b.a("skew", F.skewness(b.value))),
    "root_mean_square": _simple("root_mean_square", lambda b: F.sqrt(b.a("mean_sq", F.avg(b.value * b.value)))),
    "kurtosis": _simple("kurtosis", lambda b: b.a("kurt", F.kurtosis(b.value)) + 3),
    "absolute_energy": _simple("absolute_energy", lambda b: b.a("energy", F.sum(b.value * b.value))),
    "mean_absolute_change": _simple("mean_absolute_change", lambda b: b.s("mean_abs_change", F.avg(F.abs(b.change())))),
    "linear_trend": _linear_trend,
    "variance_larger_than_standard_deviation": _simple("variance_larger_than_standard_deviation", lambda b: gt(b.variance(), b.deviation()).cast("double")),
    "ratio_beyond_r_sigma": _each("ratio_beyond_r_sigma", _beyond, lambda p: f"r_{p['r']:.2f}"),
    "large_standard_deviation": _each("large_standard_deviation", lambda b, p: flag(gt(b.deviation(), b.spread() * p["r"])), lambda p: f"r_{p['r']:.2f}"),
    "symmetry_looking": _each("symmetry_looking", lambda b, p: flag(gt(b.spread() * p["r"], b.skew())), lambda p: f"r_{p['r']:.2f}"),
    "has_duplicate_max": _simple("has_duplicate_max", lambda b: (b.s("n_max", F.sum(flag(eq(_x(), b.mx())))) > 1).cast("double")),
    "has_duplicate_min": _simple("has_duplicate_min", lambda b: (b.s("n_min", F.sum(flag(eq(_x(), b.mn())))) > 1).cast("double")),
    "cid_ce": _each("cid_ce", _cid, lambda p: f"normalize_{'t' if p['normalize'] else 'f'}"),
    "absolute_maximum": _simple("absolute_maximum", lambda b: b.a("abs_max", F.max(F.abs(b.value)))),
    "absolute_sum_of_changes": _simple("absolute_sum_of_changes", lambda b: F.coalesce(b.s("abs_change", F.sum(F.abs(b.change()))), F.lit(0.0))),
    "count_above_mean": _simple("count_above_mean", lambda b: b.s("above_mean", F.sum(flag(gt(_x(), b.mu()))))),
    "count_below_mean": _simple("count_below_mean", lambda b: b.s("below_mean", F.sum(flag(gt(b.mu(), _x()))))),
    "count_above": _counted("count_above", lambda b, p: gt(b.value, F.lit(p["t"])), lambda p: f"__t_{p['t']:.1f}"),
    "count_below": _counted("count_below", lambda b, p: gt(F.lit(p["t"]), b.value), lambda p: f"__t_{p['t']:.1f}"),
    "first_location_of_maximum": _simple("first_location_of_maximum", lambda b: _first(b, "first_max", b.mx())),
    "first_location_of_minimum": _simple("first_location_of_minimum", lambda b: _first(b, "first_min", b.mn())),
    "last_location_of_maximum": _simple("last_location_of_maximum", lambda b: 1 - _first(b, "first_max", b.mx())),
    "last_location_of_minimum": _simple("last_location_of_minimum", lambda b: 1 - _first(b, "first_min", b.mn())),
    "longest_strike_above_mean": _simple("longest_strike_above_mean", lambda b: _strike(b, "above", gt(_x(), b.mu()))),
    "longest_strike_below_mean": _simple("longest_strike_below_mean", lambda b: _strike(b, "below", gt(b.mu(), _x()))),
    "has_duplicate": _simple("has_duplicate", lambda b: (b.s("max_freq", F.max(b.freq())) > 1).cast("double")),
    "variation_coefficient": _simple("variation_coefficient", lambda b: try_divide(b.deviation(), b.mean())),
    "mean_change": _simple("mean_change", lambda b: try_divide(b.s("last", F.max(F.when(b.index() == b.size() - 1, _x()))) - b.s("first", F.max(F.when(b.index() == 0, _x()))), (b.n() - 1).cast("double"))),
    "ratio_value_number_to_time_series_length": _simple("ratio_value_number_to_time_series_length", lambda b: try_divide(_distinct(b), b.n().cast("double"))),
    "sum_of_reoccurring_values": _simple("sum_of_reoccurring_values", lambda b: _repeats(b, "repeat_values", _x())),
    "sum_of_reoccurring_data_points": _simple("sum_of_reoccurring_data_points", lambda b: _repeats(b, "repeat_points", _x() * b.freq())),
    "percentage_of_reoccurring_values_to_all_values": _simple("percentage_of_reoccurring_values_to_all_values", lambda b: try_divide(_repeats(b, "repeats", F.lit(1)), _distinct(b))),
    "percentage_of_reoccurring_values_to_all_datapoints": _simple("percentage_of_reoccurring_values_to_all_datapoints", lambda b: try_divide(_repeats(b, "repeats", F.lit(1)), b.n().cast("double"))),
    "agg_linear_trend": _chunk_trend,
    "mean_n_absolute_max": _each("mean_n_absolute_max", _largest, lambda p: f"n_{p['n']}"),
    "autocorrelation": _each("autocorrelation", _autocorrelation, lambda p: f"lag_{p['lag']}"),
    "quantile": _each("quantile", lambda b, p: b.quantile(p["q"], f"q_{_number(p['q'])}"), lambda p: f"q_{p['q']:.1f}"),
    "number_crossing_m": _each("number_crossing_m", _crossings, lambda p: f"m_{p['m']:.1f}"),
    "range_count": _each("range_count", _range, lambda p: f"min_{p['min']:.1f}__max_{p['max']:.1f}"),
    "index_mass_quantile": _each("index_mass_quantile", _mass, lambda p: f"q_{p['q']:g}" if p["q"] % 1 else f"q_{p['q']:2.0f}"),
    "c3": _each("c3", _c3, lambda p: f"lag_{p['lag']}"),
    "time_reversal_asymmetry_statistic": _each("time_reversal_asymmetry_statistic", _reversal, lambda p: f"lag_{p['lag']}"),
    "number_peaks": _each("number_peaks", _peaks, lambda p: f"n_{p['n']}"),
}
#: Where there is no value these are null; all others are NaN.
NULLABLE = ("median", "variance_larger_than_standard_deviation", "quantile")
#: Features that need a rank anyway: then medians come from it as well.
RANKED = ("quantile", "symmetry_looking")
