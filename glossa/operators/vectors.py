"""Arithmetic over array columns: element by element, reductions, array tools; all are JVM expressions.  Dual numbers for derivatives."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- element by element -------------------------------------------------------------------------------------------------------


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """By elements; by zero gives null."""
    return F.zip_with(a, b, lambda x, y: F.when(y != 0, x / y))


def scaled(a: Column, by: float | Column) -> Column:
    return F.transform(a, lambda x: x * by)


def over(a: Column, by: Column) -> Column:
    """By one number, which is found once a row and not once an element; by zero gives NaN."""
    return F.get(F.transform(F.array(by), lambda n: F.transform(a, lambda x: F.when(n != 0, x / n).otherwise(x * F.lit(float("nan"))))), 0)


def shifted(a: Column, by: float | Column) -> Column:
    return F.transform(a, lambda x: x + by)


def mapped(a: Column, f) -> Column:
    """A column function on every element: F.exp, F.log, F.abs, ..."""
    return F.transform(a, f)


def powered(a: Column, p: float) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(p)))


def rounded(a: Column, digits: int) -> Column:
    """Half away from zero; a negative that rounds to zero keeps its sign (-0.0), which Spark's round drops."""
    def one(x: Column) -> Column:
        r = F.round(x, digits)
        return F.when(r == 0, x * F.lit(0.0)).otherwise(r)

    return F.transform(a, one)


# --- reductions -----------------------------------------------------------------------------------------------------------------


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Of an empty array null."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def variance(a: Column) -> Column:
    """Of the sample (n - 1); of fewer than two elements null."""
    m = mean(a)
    return F.when(F.size(a) > 1, F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(a) - 1))


def inner_product(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def norm1(a: Column) -> Column:
    return total(F.transform(a, F.abs))


def norm2(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def norm_max(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def argmax(a: Column) -> Column:
    """0-based place of the first greatest element; -1 for an empty array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1).otherwise(-1).cast("int")


def argmin(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_position(a, F.array_min(a)) - 1).otherwise(-1).cast("int")


def log_sum(a: Column) -> Column:
    """log of the sum of exponentials, around the greatest element; minus infinity for an empty array."""
    top = F.array_max(a)
    return F.when(F.size(a) > 0, top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))).otherwise(F.lit(float("-inf")))


def normalised(a: Column) -> Column:
    """Divided by the sum; null where that is 0."""
    s = total(a)
    return F.when(s != 0, F.transform(a, lambda x: x / s))


def log_normalised(a: Column) -> Column:
    s = log_sum(a)
    return F.transform(a, lambda x: x - s)


def standardised(a: Column) -> Column:
    m, d = mean(a), F.sqrt(variance(a))
    return F.when(d > 0, F.transform(a, lambda x: (x - m) / d))


def distance(a: Column, b: Column) -> Column:
    return norm2(subtract(a, b))


def cosine(a: Column, b: Column) -> Column:
    n = norm2(a) * norm2(b)
    return F.when(n > 0, inner_product(a, b) / n)


# --- array tools ----------------------------------------------------------------------------------------------------------------


def remove_at(a: Column, i: Column | int) -> Column:
    """Without the element at 0-based place i; a place outside leaves the array as it is."""
    return F.filter(a, lambda x, k: k != i)


def to_2d(a: Column, width: int) -> Column:
    """Rows of `width` elements; the last may be shorter."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, F.lit(width)))


def flattened(a: Column) -> Column:
    return F.flatten(a)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the first element that differs, then by length."""
    n = F.least(F.size(a), F.size(b))
    at = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(a, i) != F.get(b, i))
    first = at[0]
    return F.when(F.size(at) > 0, F.when(F.get(a, first) < F.get(b, first), -1).otherwise(1)).otherwise(F.signum(F.size(a) - F.size(b)).cast("int"))


def equal_contents(a: Column, b: Column) -> Column:
    """The same elements in the same order."""
    return a.eqNullSafe(b)


# --- dual numbers ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dual:
    """A value with its derivative; arithmetic keeps both."""

    value: float
    slope: float = 0.0

    @staticmethod
    def of(x) -> Dual:
        return x if isinstance(x, Dual) else Dual(float(x))

    def __add__(self, o):
        o = Dual.of(o)
        return Dual(self.value + o.value, self.slope + o.slope)

    def __mul__(self, o):
        o = Dual.of(o)
        return Dual(self.value * o.value, self.slope * o.value + self.value * o.slope)

    def __truediv__(self, o):
        o = Dual.of(o)
        return Dual(self.value / o.value, (self.slope * o.value - self.value * o.slope) / (o.value * o.value))

    def __pow__(self, p: float):
        return Dual(self.value**p, p * self.value ** (p - 1) * self.slope)

    def __neg__(self):
        return Dual(-self.value, -self.slope)

    def __sub__(self, o):
        return self + -Dual.of(o)

    def __rsub__(self, o):
        return Dual.of(o) - self

    def __rtruediv__(self, o):
        return Dual.of(o) / self

    __radd__, __rmul__ = __add__, __mul__

    def exp(self):
        e = math.exp(self.value)
        return Dual(e, e * self.slope)

    def log(self):
        return Dual(math.log(self.value), self.slope / self.value)


def derivative(f, x: float) -> float:
    """Slope of a function written over dual numbers."""
    return Dual.of(f(Dual(x, 1.0))).slope


# --- scalar functions -----------------------------------------------------------------------------------------------------------


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_base(x: Column, base: float) -> Column:
    return F.log(x) / math.log(base)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: Coefficients of Lanczos' series for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Of positive x."""
    z = x - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
