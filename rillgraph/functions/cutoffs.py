"""When a new value counts as a change: for single values and for columns."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Cutoff = Callable[[float, float], bool]


def bits(x: float) -> bytes:
    return struct.pack("<d", x)


def exact(p: float, c: float) -> bool:
    return (p != p) != (c != c) or (p == p and bits(p) != bits(c))


def always(p: float, c: float) -> bool:
    return True


def never(p: float, c: float) -> bool:
    return False


def absolute(tolerance: float) -> Cutoff:
    def changed(p: float, c: float) -> bool:
        if p != p or c != c:
            return (p != p) != (c != c)
        return abs(c - p) > tolerance

    return changed


def relative(tolerance: float) -> Cutoff:
    def changed(p: float, c: float) -> bool:
        if p != p or c != c:
            return (p != p) != (c != c)
        most = max(abs(p), abs(c))
        return most != 0.0 and abs(c - p) / most > tolerance

    return changed


def cutoff_of(properties: dict[str, Any]) -> Cutoff:
    """From node properties. A value that isn't a string counts as exact."""
    name = properties.get("cutoff")
    if callable(name):
        return name
    if not isinstance(name, str):
        return exact
    if name in ("absolute", "relative"):
        given = properties.get("tolerance")
        return absolute(1e-15 if given is None else float(given)) if name == "absolute" else relative(1e-10 if given is None else float(given))
    plain = {"exact": exact, "always": always, "never": never}
    if name not in plain:
        raise ValueError(f"unknown cutoff {name}")
    return plain[name]


def changed_column(kind: str, prev: Column, cur: Column, tolerance: float | None = None) -> Column:
    """The same over columns, for evaluated rows; a change from or to NaN always counts.

    The previous value of the first row is NaN, given as null or NaN.
    """
    nan = lambda c: c.isNull() | F.isnan(c)
    flip = nan(prev) != nan(cur)
    both = ~nan(prev) & ~nan(cur)
    if kind == "always":
        return F.lit(True)
    if kind == "never":
        return flip
    if kind == "exact":
        # bit for bit: the two zeros differ, which shows in what they divide
        zeros = (prev == 0) & (cur == 0)
        test = (prev != cur) | (zeros & (F.pow(prev, F.lit(-1.0)) != F.pow(cur, F.lit(-1.0))))
    elif kind == "absolute":
        test = F.abs(cur - prev) > F.lit(1e-15 if tolerance is None else tolerance)
    elif kind == "relative":
        most = F.greatest(F.abs(prev), F.abs(cur))
        test = F.when(most == 0, F.lit(False)).otherwise(F.abs(cur - prev) / most > F.lit(1e-10 if tolerance is None else tolerance))
    else:
        raise ValueError(f"unknown cutoff {kind}")
    return flip | (both & F.coalesce(test, F.lit(False)))


def changed_array(properties: dict[str, Any], source: bool = False) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The cutoff of node properties over arrays of previous and new values.

    Of computed nodes a change from or to NaN always counts; of a source a change from NaN does.
    """
    one, name = cutoff_of(properties), properties.get("cutoff")
    tolerance = properties.get("tolerance")

    def changed(p: np.ndarray, c: np.ndarray) -> np.ndarray:
        before, flip, both = np.isnan(p), np.isnan(p) != np.isnan(c), ~(np.isnan(p) | np.isnan(c))
        if callable(name):
            return (before if source else flip) | np.fromiter(map(one, p.tolist(), c.tolist()), bool, len(p))
        if name == "always":
            return np.ones(len(p), bool)
        if name == "never":
            return before if source else flip
        if source:
            flip |= before
        with np.errstate(invalid="ignore", over="ignore"):
            if name == "absolute":
                test = np.abs(c - p) > (1e-15 if tolerance is None else float(tolerance))
            elif name == "relative":
                most = np.maximum(np.abs(p), np.abs(c))
                test = (most != 0) & (np.abs(c - p) / np.where(most == 0, 1.0, most) > (1e-10 if tolerance is None else float(tolerance)))
            else:
                test = np.ascontiguousarray(p).view(np.int64) != np.ascontiguousarray(c).view(np.int64)
        return flip | (both & test)

    return changed


def vector_changed(prev: list[float], cur: list[float], tolerance: float) -> bool:
    return any(((p != p) != (c != c)) or abs(c - p) > tolerance for p, c in zip(prev, cur, strict=True))


def vector_changed_column(prev: Column, cur: Column, tolerance: float) -> Column:
    """Any element beyond the tolerance, or from or to NaN."""

    def moved(p: Column, c: Column) -> Column:
        return F.when(F.isnan(p) | F.isnan(c), F.isnan(p) != F.isnan(c)).otherwise(F.abs(c - p) > F.lit(tolerance))

    return F.exists(F.zip_with(prev, cur, moved), lambda x: x)


def is_nan(x: float) -> bool:
    return math.isnan(x)
