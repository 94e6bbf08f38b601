"""Element-wise algebra, indexing, shapes and reductions of array columns.

Binary operations take two arrays of equal length or an array and a scalar column; unequal lengths raise. Integer
assignment truncates toward zero; floor division and modulo follow the divisor's sign; variance is that of the population.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def zipped(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    """f of the elements of two arrays; raises unless their lengths are equal."""
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("shapes differ")))


def scaled(a: Column | str, s: Column | float, f: Callable[[Column, Column], Column]) -> Column:
    s = _col(s)
    return F.transform(_col(a), lambda x: f(x, s))


def floor_divide(x: Column, y: Column) -> Column:
    return F.floor(x / y).cast("double")


def modulo(x: Column, y: Column) -> Column:
    return x - y * F.floor(x / y)


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def arange(start: Column | int, stop: Column | int, step: int = 1) -> Column:
    """start, start + step, ... before stop; empty if there are none."""
    start, stop = _col(start), _col(stop)
    n = F.ceil((stop - start) / F.lit(float(step))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (start + i * step).cast("double"))).otherwise(F.array().cast("array<double>"))


def eye(n: Column | int, m: Column | int) -> Column:
    rows, cols = F.sequence(F.lit(0), _col(n) - 1), F.sequence(F.lit(0), _col(m) - 1)
    return F.transform(rows, lambda i: F.transform(cols, lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def item(a: Column | str, i: Column | int) -> Column:
    """0-based element; negative from the end; null out of range."""
    a, i = _col(a), _col(i)
    return F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i))


def sliced(a: Column | str, start: int, stop: int | None = None, step: int = 1) -> Column:
    a = _col(a)
    end = F.size(a) if stop is None else F.least(F.lit(stop), F.size(a))
    return F.filter(a, lambda x, i: (i >= start) & (i < end) & ((i - start) % step == 0))


def assigned(a: Column | str, i: Column | int, value: Column | float) -> Column:
    """A copy with one element replaced."""
    i, value = _col(i), _col(value)
    return F.transform(_col(a), lambda x, k: F.when(k == i, value.cast("double")).otherwise(x))


def total(a: Column | str) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double"))


def product(a: Column | str) -> Column:
    return F.aggregate(_col(a), F.lit(1.0), lambda s, x: s * x.cast("double"))


def mean(a: Column | str) -> Column:
    return total(a) / F.nullif(F.size(_col(a)), F.lit(0))


def peak_to_peak(a: Column | str) -> Column:
    return F.array_max(_col(a)) - F.array_min(_col(a))


def argmax(a: Column | str) -> Column:
    a = _col(a)
    return F.array_position(a, F.array_max(a)) - 1


def argmin(a: Column | str) -> Column:
    a = _col(a)
    return F.array_position(a, F.array_min(a)) - 1


def variance(a: Column | str) -> Column:
    a = _col(a)
    m = mean(a)
    return F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))


def reshaped(a: Column | str, rows: Column | int, cols: Column | int) -> Column:
    a, cols = _col(a), _col(cols)
    return F.transform(F.sequence(F.lit(0), _col(rows) - 1), lambda i: F.slice(a, i * cols + 1, cols))


def transposed(m: Column | str) -> Column:
    m = _col(m)
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def unique(a: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_col(a)))


def bincount(a: Column | str, minlength: int = 0) -> Column:
    """Counts of the whole parts 0 .. max."""
    a = _col(a)
    n = F.greatest(F.coalesce(F.array_max(F.transform(a, lambda x: x.cast("int"))) + 1, F.lit(0)), F.lit(minlength))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.size(F.filter(a, lambda x: x.cast("int") == k)))).otherwise(F.array().cast("array<int>"))
