"""Column functions over arrays of numbers, oldest value first. All results are doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def or_nan(x: Column) -> Column:
    return F.when(finite(x), x.cast("double")).otherwise(F.lit(NAN))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def tail(a: Column, n: int) -> Column:
    """The last n elements; empty if there are fewer."""
    return doubles(F.slice(a, -n, n))


def lag(a: Column, k: int) -> Column:
    """The k-th element from the end as a double; null if there is none."""
    return F.try_element_at(a, F.lit(-k)).cast("double")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def deviation(a: Column, mean_of: Column | None = None) -> Column:
    """Population standard deviation in two passes."""

    def around(values: Column, center: Column) -> Column:
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - center) * (x - center)) / F.nullif(F.size(values), F.lit(0)))

    return let(a, lambda values: let(mean(values) if mean_of is None else mean_of, lambda center: around(values, center)))


def steps(a: Column) -> Column:
    """Absolute differences of neighbours."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), lambda x, y: F.abs(x - y))


def mean_step(a: Column) -> Column:
    """Mean absolute difference of neighbours; 0 for a single value."""
    return F.when(F.size(a) > 1, total(steps(a)) / F.greatest(F.size(a) - 1, F.lit(1))).otherwise(F.lit(0.0))


def spread(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def slope(a: Column, n: int) -> Column:
    """Least-squares slope of n values over 0..n-1."""
    middle = (n - 1) / 2.0
    weighed = F.transform(a, lambda y, i: (i - F.lit(middle)) * y)
    return total(weighed) / F.lit(n * (n * n - 1) / 12.0)


def longest_run(a: Column, tolerance: float = 1e-9) -> Column:
    """Length of the longest run of neighbours that differ by ``tolerance`` at most."""
    start = F.struct(F.lit(1).alias("now"), F.lit(1).alias("best"))

    def grow(state: Column, step: Column) -> Column:
        now = F.when(step <= tolerance, state["now"] + 1).otherwise(F.lit(1))
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    return F.aggregate(steps(a), start, grow, lambda s: s["best"])


def clip(x: Column, low: float, high: float) -> Column:
    """Within low..high. Test for finiteness first: a NaN passes as ``high``."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
