"""Kernels: what a node computes from its inputs, a row or a stretch of rows at a time.

``step`` takes one evaluation; ``run`` takes consecutive evaluations of one key as arrays and
carries state on, so stretches may be cut anywhere. An input that is NaN gives
NaN and leaves the state as it was.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np

NAN = float("nan")
LN2 = math.log(2.0)


def _at_least(value: int, least: int, what: str) -> int:
    if value < least:
        raise ValueError(f"{what} must be at least {least}")
    return value


class Kernel:
    """Guards NaN and errors; subclasses give ``value`` and perhaps ``values``."""

    def step(self, args: Sequence[float], now: float | None = None) -> float:
        for a in args:
            if a != a:
                return NAN
        try:
            return float(self.value(*args))
        except (ArithmeticError, ValueError):
            return NAN

    def run(self, args: Sequence[np.ndarray], now: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(args[0]) if args else 0, NAN)
        ok = ~np.isnan(np.vstack(args)).any(axis=0) if args else np.zeros(0, bool)
        if ok.any():
            out[ok] = self.values(*(a[ok] for a in args))
        return out

    def value(self, *args: float) -> float:
        raise NotImplementedError

    def values(self, *args: np.ndarray) -> np.ndarray:
        return np.array([self.step(row) for row in zip(*args, strict=True)], float)


class Plain(Kernel):
    """A stateless function that works on numbers and on arrays."""

    def __init__(self, fn: Callable, array_fn: Callable | None = None):
        self.value, self._array_fn = fn, array_fn

    def values(self, *args: np.ndarray) -> np.ndarray:
        if self._array_fn is None:
            return super().values(*args)
        with np.errstate(all="ignore"):
            return self._array_fn(*args)


def spread() -> Kernel:
    return Plain(lambda a, b: a - b, lambda a, b: a - b)


def tri_arb() -> Kernel:
    return Plain(lambda x, y, d: d - x * y, lambda x, y, d: d - x * y)


def average() -> Kernel:
    def one(*xs):
        return sum(xs) / len(xs) if xs else NAN

    return Plain(one, lambda *xs: sum(xs) / len(xs))


def over(a: float, b: float) -> float:
    """a / b in floating point: infinite over a zero, by both signs, and NaN for 0 / 0."""
    return a / b if b else a * math.copysign(math.inf, b)


def weighted_average(ieee: bool = False) -> Kernel:
    """NaN if the weights sum to zero; with ``ieee`` the quotient by it."""

    def one(*xs):
        if len(xs) % 2 or not xs:
            return NAN
        weight = reduce(add, xs[1::2])
        return NAN if weight == 0 and not ieee else over(reduce(add, [v * w for v, w in zip(xs[::2], xs[1::2], strict=True)]), weight)

    def many(*xs):
        if len(xs) % 2:
            return np.full(len(xs[0]), NAN)
        weight = reduce(add, xs[1::2])
        quotient = reduce(add, [v * w for v, w in zip(xs[::2], xs[1::2], strict=True)]) / weight
        return quotient if ieee else np.where(weight == 0, NAN, quotient)

    return Plain(one, many)


def harmonic_mean(ieee: bool = False) -> Kernel:
    """NaN if an input is zero; with ``ieee`` one over zero is infinite, and the mean 0."""

    def one(*xs):
        if not xs or not ieee and any(x == 0 for x in xs):
            return NAN
        s = reduce(add, [over(1.0, x) for x in xs])
        return math.inf if s == 0 and not ieee else over(len(xs), s)

    def many(*xs):
        s = reduce(add, [1.0 / x for x in xs])
        if ieee:
            return len(xs) / s
        zero = np.any([x == 0 for x in xs], axis=0)
        return np.where(zero, NAN, np.where(s == 0, np.inf, len(xs) / s))

    return Plain(one, many)


class Window(Kernel):
    """The last ``size`` evaluations; shorter at the start."""

    least = 1
    arity = 1

    def __init__(self, size: int):
        self.size = _at_least(size, self.least, "window")
        self.held: deque[tuple[float, ...]] = deque(maxlen=self.size)

    def value(self, *args: float) -> float:
        self.held.append(args)
        return self.of(*(np.array(c)[None, :] for c in zip(*self.held, strict=True)))[0]

    def values(self, *args: np.ndarray) -> np.ndarray:
        before = len(self.held)
        columns = [np.concatenate([[h[k] for h in self.held], a]) for k, a in enumerate(args)]
        n = len(columns[0])
        out = np.empty(n - before)
        for i in range(before, min(self.size - 1, n)):  # windows that aren't full yet
            out[i - before] = self.of(*(c[None, : i + 1] for c in columns))[0]
        full = max(before, self.size - 1)
        if n > full:
            views = [np.lib.stride_tricks.sliding_window_view(c, self.size)[full - self.size + 1 :] for c in columns]
            for a in range(0, n - full, 65_536 // self.size + 1):
                b = min(n - full, a + 65_536 // self.size + 1)
                out[full - before + a : full - before + b] = self.of(*(v[a:b] for v in views))
        self.held.extend(zip(*(a[-self.size :] for a in args), strict=True))
        return out

    def of(self, *rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Sma(Window):
    def of(self, x):
        return x.mean(axis=1)


class RollingSum(Window):
    least = 2

    def of(self, x):
        return x.sum(axis=1)


class RollingMax(Window):
    def of(self, x):
        return x.max(axis=1)


class RollingMin(Window):
    def of(self, x):
        return x.min(axis=1)


class RollingVariance(Window):
    """Sample variance; one row gives 0."""

    least = 2

    def of(self, x):
        return np.zeros(len(x)) if x.shape[1] < 2 else x.var(axis=1, ddof=1)


class HistVol(Window):
    """Population deviation; one row gives 0."""

    least = 2

    def of(self, x):
        return x.std(axis=1)


class ZScore(Window):
    least = 2

    def of(self, x):
        var = x.var(axis=1)
        with np.errstate(all="ignore"):
            return np.where((x.shape[1] < 2) | (var <= 1e-9), 0.0, (x[:, -1] - x.mean(axis=1)) / np.sqrt(var))


class Beta(Window):
    """Covariance over the variance of the second input."""

    least, arity = 2, 2

    def of(self, x, y):
        var = y.var(axis=1)
        cov = ((x - x.mean(axis=1, keepdims=True)) * (y - y.mean(axis=1, keepdims=True))).mean(axis=1)
        with np.errstate(all="ignore"):
            return np.where((x.shape[1] < 2) | (var <= 1e-9), 0.0, cov / var)


class Correlation(Window):
    least, arity = 2, 2

    def of(self, x, y):
        dx, dy = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        mx, my = (dx * dx).sum(axis=1), (dy * dy).sum(axis=1)
        with np.errstate(all="ignore"):
            r = (dx * dy).sum(axis=1) / np.sqrt(mx * my)
        return np.where((x.shape[1] < 2) | (mx <= 1e-14) | (my <= 1e-14), 0.0, np.clip(r, -1, 1))


class Accumulated(Window):
    """A user's accumulator: anything with add, remove and result."""

    least = 2

    def __init__(self, size: int, accumulator):
        super().__init__(size)
        self.accumulator = accumulator

    def value(self, x: float) -> float:
        if len(self.held) == self.size:
            self.accumulator.remove(self.held[0][0])
        self.accumulator.add(x)
        self.held.append((x,))
        return self.accumulator.result()

    values = Kernel.values


class Diff(Kernel):
    def __init__(self):
        self.last = None

    def value(self, x):
        out, self.last = 0.0 if self.last is None else x - self.last, x
        return out

    def values(self, x):
        before = x[:1] if self.last is None else [self.last]
        self.last = float(x[-1])
        return np.diff(x, prepend=before)


class LogReturn(Kernel):
    """Values that aren't positive give NaN and are passed over."""

    def __init__(self):
        self.last = None

    def value(self, x):
        if x <= 0:
            return NAN
        out, self.last = 0.0 if self.last is None else math.log(x / self.last), x
        return out

    def values(self, x):
        out, ok = np.full(len(x), NAN), x > 0
        good = x[ok]
        if len(good):
            out[ok] = np.log(good / np.concatenate([good[:1] if self.last is None else [self.last], good[:-1]]))
            self.last = float(good[-1])
        return out


def smoothed(x: np.ndarray, alpha: float, start: float | None) -> np.ndarray:
    """s = alpha x + (1 - alpha) s, from ``start`` or else from the first value; the same bits as row by row."""
    kept = 1 - alpha
    out = np.fromiter(accumulate(x.tolist(), lambda s, v: alpha * v + kept * s, initial=start), float)
    return out if start is None else out[1:]


class Ewma(Kernel):
    def __init__(self, alpha: float):
        if not 0 < alpha <= 1:
            raise ValueError("alpha must be over 0 and at most 1")
        self.alpha, self.s = alpha, None

    def value(self, x):
        self.s = x if self.s is None else self.alpha * x + (1 - self.alpha) * self.s
        return self.s

    def values(self, x):
        out = smoothed(x, self.alpha, self.s)
        self.s = float(out[-1])
        return out


class Macd(Kernel):
    def __init__(self, fast: int, slow: int):
        self.fast, self.slow = Ewma(2.0 / (_at_least(fast, 1, "fast") + 1)), Ewma(2.0 / (_at_least(slow, 1, "slow") + 1))

    def value(self, x):
        return self.fast.value(x) - self.slow.value(x)

    def values(self, x):
        return self.fast.values(x) - self.slow.values(x)


class Rsi(Kernel):
    def __init__(self, size: int):
        self.size, self.last, self.gain, self.loss = _at_least(size, 1, "window"), None, 0.0, 0.0

    def value(self, x):
        if self.last is None:
            self.last = x
            return 50.0
        change, self.last = x - self.last, x
        a = 1.0 / self.size
        self.gain = a * max(change, 0.0) + (1 - a) * self.gain
        self.loss = a * max(-change, 0.0) + (1 - a) * self.loss
        if self.loss == 0:
            return 50.0 if self.gain == 0 else 100.0
        return 100.0 - 100.0 / (1.0 + self.gain / self.loss)

    def values(self, x):
        first = self.last is None
        change = np.diff(x, prepend=x[:1] if first else [self.last])
        if first:
            change = change[1:]
        self.last = float(x[-1])
        if not len(change):
            return np.full(len(x), 50.0)
        gain, loss = (smoothed(np.maximum(c, 0.0), 1.0 / self.size, s) for c, s in ((change, self.gain), (-change, self.loss)))
        self.gain, self.loss = float(gain[-1]), float(loss[-1])
        with np.errstate(all="ignore"):
            out = np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), 100.0 - 100.0 / (1.0 + gain / loss))
        return np.concatenate([[50.0], out]) if first else out


class Timed(Kernel):
    """Kernels that look at the time of the evaluation, in milliseconds."""

    def step(self, args, now=None):
        return NAN if args[0] != args[0] else self.at(args[0], now)

    def run(self, args, now=None):
        return np.array([NAN if x != x else self.at(x, t) for x, t in zip(args[0].tolist(), now.tolist(), strict=True)], float)

    def at(self, x: float, now: float) -> float:
        raise NotImplementedError


class Throttle(Timed):
    """Fires when the window has passed since it last fired; holds its value else."""

    def __init__(self, window_ms: float):
        self.window, self.fired, self.held = window_ms, None, NAN

    def step(self, args, now=None):
        return self.at(args[0], now)

    def run(self, args, now=None):
        return np.array([self.at(x, t) for x, t in zip(args[0].tolist(), now.tolist(), strict=True)], float)

    def at(self, x, now):
        if self.fired is None or now - self.fired >= self.window:
            self.fired, self.held = now, x
        return self.held


class TimeDecay(Timed):
    """EWMA whose weight halves every half life; no time passed means no change."""

    def __init__(self, half_life_ms: float):
        if half_life_ms <= 0:
            raise ValueError("the half life must be positive")
        self.half, self.last, self.s = half_life_ms, None, NAN

    def at(self, x, now):
        if self.last is None:
            self.last, self.s = now, x
        elif (dt := now - self.last) > 0:
            kept = math.exp(-LN2 * dt / self.half)
            self.last, self.s = now, x * (1 - kept) + self.s * kept
        return self.s


class Twap(Timed):
    """Time-weighted mean since the start; each value holds until the next."""

    def __init__(self):
        self.last, self.held, self.area, self.span = None, NAN, 0.0, 0.0

    def at(self, x, now):
        if self.last is None:
            self.last, self.held = now, x
            return x
        if (dt := now - self.last) > 0:
            self.area += self.held * dt
            self.span += dt
            self.last, self.held = now, x
        return self.held if self.span == 0 else self.area / self.span
