"""Column expressions as SQL text.

A set of 156 features takes thousands of expressions; made as text, a whole
feature costs one call into the JVM. ``Text`` has the operators of a column and
the functions below the names of their SQL counterparts.
"""

from __future__ import annotations


class Text:
    def __init__(self, sql: str):
        self.sql = sql

    def __add__(self, other): return _two(self, "+", other)
    def __radd__(self, other): return _two(other, "+", self)
    def __sub__(self, other): return _two(self, "-", other)
    def __rsub__(self, other): return _two(other, "-", self)
    def __mul__(self, other): return _two(self, "*", other)
    def __rmul__(self, other): return _two(other, "*", self)
    def __truediv__(self, other): return _two(self, "/", other)
    def __mod__(self, other): return _two(self, "%", other)
    def __gt__(self, other): return _two(self, ">", other)
    def __ge__(self, other): return _two(self, ">=", other)
    def __lt__(self, other): return _two(self, "<", other)
    def __le__(self, other): return _two(self, "<=", other)
    def __eq__(self, other): return _two(self, "=", other)
    def __ne__(self, other): return _two(self, "<>", other)
    def __and__(self, other): return _two(self, "AND", other)
    def __or__(self, other): return _two(self, "OR", other)
    def __invert__(self): return Text(f"(NOT {self.sql})")
    __hash__ = None

    def cast(self, kind: str) -> Text:
        return Text(f"CAST({self.sql} AS {kind})")

    def over(self, window: str) -> Text:
        return Text(f"{self.sql} OVER ({window})")


class When(Text):
    """CASE WHEN without an ELSE (null), to which ``otherwise`` adds one."""

    def __init__(self, condition: Text, value):
        self.head = f"CASE WHEN {condition.sql} THEN {lit(value).sql}"
        super().__init__(f"({self.head} END)")

    def otherwise(self, value) -> Text:
        return Text(f"({self.head} ELSE {lit(value).sql} END)")


def lit(value) -> Text:
    if isinstance(value, Text):
        return value
    if isinstance(value, bool):
        return Text("true" if value else "false")
    if isinstance(value, float):
        return Text(f"CAST('{value!r}' AS DOUBLE)")
    return Text(f"{value}")


def _two(a, sign: str, b) -> Text:
    return Text(f"({lit(a).sql} {sign} {lit(b).sql})")


def col(name: str) -> Text:
    return Text(".".join(f"`{part}`" for part in name.split(".")))


def named(name: str) -> Text:
    """A column whose name may hold dots."""
    return Text("`" + name.replace("`", "``") + "`")


def call(function: str, *args) -> Text:
    return Text(f"{function}({', '.join(lit(a).sql for a in args)})")


def _function(name: str):
    return lambda *args: call(name, *(col(a) if isinstance(a, str) else a for a in args))


abs, avg, ceil, coalesce, count, covar_samp, floor, isnan, kurtosis, lead, max, median, min, regr_intercept, regr_slope, row_number, skewness, sqrt, stddev_samp, sum, try_divide, var_samp = (  # noqa: A001
    _function(n) for n in ("abs", "avg", "ceil", "coalesce", "count", "covar_samp", "floor", "isnan", "kurtosis", "lead", "max", "median", "min", "regr_intercept", "regr_slope", "row_number", "skewness", "sqrt", "stddev_samp", "sum", "try_divide", "var_samp")
)
when = When


def last_value(value: Text) -> Text:
    """The last value that isn't null."""
    return Text(f"last({value.sql}, true)")


def nan() -> Text:
    return Text("double('NaN')")


def gt(a: Text, b: Text) -> Text:
    """a > b, false where either is NaN (Spark alone takes NaN for the largest)."""
    return (a > b) & ~isnan(a)


def eq(a: Text, b: Text) -> Text:
    return (a == b) & ~isnan(a)


def flag(c: Text) -> Text:
    return When(c, 1.0).otherwise(0.0)


def partition(*columns: str) -> str:
    return "PARTITION BY " + ", ".join(f"`{c}`" for c in columns) if columns else ""


def ordered(window: str, *by: str) -> str:
    return f"{window} ORDER BY {', '.join(by)}"


def rows(window: str, start: int | None, end: int) -> str:
    """A frame of rows from ``start`` (None: the first one) to ``end``, relative to the current row."""

    def bound(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"

    return f"{window} ROWS BETWEEN {'UNBOUNDED PRECEDING' if start is None else bound(start)} AND {bound(end)}"


def whole(window: str) -> str:
    """All rows of an ordered window, taken in its order."""
    return f"{window} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
