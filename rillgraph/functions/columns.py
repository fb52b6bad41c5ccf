"""Stateless node functions as column expressions; NaN in gives NaN out, and no ANSI errors."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def number(c: Column) -> Column:
    """A double in which null counts as NaN."""
    return F.coalesce(c.cast("double"), nan())


def guarded(value: Column, *inputs: Column) -> Column:
    return F.when(reduce(or_, [F.isnan(c) for c in inputs]), nan()).otherwise(value)


def over(a: Column, b: Column) -> Column:
    """a / b in floating point: infinite over a zero, by both signs, and NaN for 0 / 0."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def spread(a: Column, b: Column) -> Column:
    return a - b


def tri_arb_spread(leg1: Column, leg2: Column, direct: Column) -> Column:
    return direct - leg1 * leg2


def average(*xs: Column) -> Column:
    return reduce(add, xs) / F.lit(float(len(xs))) if xs else nan()


def weighted_average(*xs: Column, ieee: bool = False) -> Column:
    """NaN if the weights sum to zero; with ``ieee`` the quotient by it."""
    if len(xs) % 2 or not xs:
        return nan()
    weight = reduce(add, xs[1::2])
    product = reduce(add, [v * w for v, w in zip(xs[::2], xs[1::2], strict=True)])
    if ieee:
        return guarded(over(product, weight), *xs)
    return guarded(F.when(weight == 0, nan()).otherwise(F.try_divide(product, weight)), *xs)


def harmonic_mean(*xs: Column, ieee: bool = False) -> Column:
    """NaN if an input is zero; with ``ieee`` one over zero is infinite, as in SQL, and the mean 0."""
    if not xs:
        return nan()
    if ieee:
        return guarded(over(F.lit(float(len(xs))), reduce(add, [over(F.lit(1.0), x) for x in xs])), *xs)
    s = reduce(add, [F.try_divide(F.lit(1.0), x) for x in xs])
    zero = reduce(or_, [x == 0 for x in xs])
    return guarded(F.when(zero, nan()).when(s == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(float(len(xs))), s)), *xs)


def condition(x: Column, operator: str, threshold: float) -> Column:
    """A comparison in which NaN is less, more and equal to nothing."""
    t = F.lit(float(threshold))
    tests = {">": x > t, "<": x < t, ">=": x >= t, "<=": x <= t, "==": x == t}
    if operator == "!=":
        return F.isnan(x) | (x != t)
    if operator not in tests:
        raise ValueError(f"unknown operator {operator}")
    return ~F.isnan(x) & tests[operator]


def select(test: Column, yes: Column, no: Column) -> Column:
    return F.when(test, yes).otherwise(no)


def element(vector: Column, index: int) -> Column:
    return number(F.get(vector, F.lit(index)))


def copy_vector(vector: Column, size: int) -> Column:
    """The first ``size`` elements, zeros where there are none."""
    if size <= 0:
        raise ValueError("size must be positive")
    return F.slice(F.concat(F.slice(vector, 1, size), F.array_repeat(F.lit(0.0), size)), 1, size)


def flattened(*inputs: Column | tuple[Column, bool]) -> Column:
    """Scalars and vectors as one array of doubles, for functions from arrays to arrays."""
    return F.flatten(F.array(*[c if is_vector else F.array(c) for c, is_vector in inputs]))
