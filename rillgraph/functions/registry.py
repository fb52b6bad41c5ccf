"""Node kinds by name: their inputs, and what makes a runtime node of a spec."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np

from . import kernels as K

COMPARISONS: dict[str, Callable[[float, float], bool]] = {
    ">": lambda x, t: x > t,
    "<": lambda x, t: x < t,
    ">=": lambda x, t: x >= t,
    "<=": lambda x, t: x <= t,
    "==": lambda x, t: x == t,
    "!=": lambda x, t: x != t,
}


@dataclass(frozen=True)
class Kind:
    """``shape``: scalar, vector, boolean, switch, timer or a source of either.

    ``inputs``: names of bound inputs in order, or None for all inputs by sorted key.
    ``make(properties)`` gives a kernel (scalar shapes) or what the runtime needs.
    ``native``: whether every_row plans can be windows or column expressions.
    """

    name: str
    shape: str
    inputs: tuple[str, ...] | None
    make: Callable[[dict[str, Any]], Any] | None = None
    source: bool = False
    timed: bool = False
    cutoff: bool = False

    def check(self, node) -> None:
        """Errors of properties show when the graph is built."""
        if self.make is not None:
            self.make(node.properties)
        if self.cutoff:
            from .cutoffs import cutoff_of

            cutoff_of(node.properties)


class NodeProvider(Protocol):
    def register(self, registry: Registry) -> None: ...


class Registry:
    """Kinds by upper-case name. ``install`` lets providers add their own."""

    def __init__(self) -> None:
        self._kinds: dict[str, Kind] = {}

    def add(self, kind: Kind) -> Registry:
        if kind.name in self._kinds:
            raise RuntimeError(f"type {kind.name} is already registered")
        self._kinds[kind.name] = kind
        return self

    def kind(self, name: str) -> Kind:
        if str(name).upper() not in self._kinds:
            raise ValueError(f"unknown node type {name}")
        return self._kinds[str(name).upper()]

    def kinds(self) -> list[str]:
        return sorted(self._kinds)

    def ordered_inputs(self, node) -> list[tuple[str, str]]:
        """(key, parent) in the order that the kernel takes them; other keys only trigger."""
        kind = self.kind(node.type)
        if kind.inputs is None:
            return sorted(node.inputs.items())
        return [(k, node.inputs[k]) for k in kind.inputs]

    def register(self, name: str, inputs: tuple[str, ...] | None, factory: Callable[[dict[str, Any]], Callable], shape: str = "scalar") -> Registry:
        """A user's function: ``factory(properties)`` gives fn(*inputs) (or fn(list) -> list for vectors).

        Unlike built-in kinds, it sees NaN inputs. An exception gives NaN; see ``UserFunction`` for ``breakerMs``.
        """
        make = (lambda p: UserFunction(factory(p), _number(p, "breakerMs", 0.0))) if shape == "scalar" else factory
        return self.add(Kind(name.upper(), shape, inputs, make, cutoff=shape == "scalar"))

    def accumulator(self, name: str, factory: Callable[[dict[str, Any]], Any]) -> Registry:
        """A user's window: ``factory(properties)`` gives an accumulator with add, remove and result; ``window`` is its size."""
        return self.add(Kind(name.upper(), "scalar", ("input",), lambda p: K.Accumulated(_whole(p, "window", 10), factory(p)), cutoff=True))

    def install(self, provider: NodeProvider) -> Registry:
        provider.register(self)
        return self


class UserFunction(K.Kernel):
    """A user's function. An error makes the node NaN, is kept for listeners, and opens the breaker.

    While the breaker is open, for ``breaker_ms`` of the rows' time (of the clock where rows have none), the
    function isn't called and the node is NaN. 0 keeps it closed.
    """

    def __init__(self, fn: Callable, breaker_ms: float = 0.0):
        self.fn, self.breaker, self.until = fn, breaker_ms, None
        self.error: Exception | None = None

    def step(self, args, now=None):
        if self.breaker:
            now = time.monotonic() * 1000.0 if now is None else now
            if self.until is not None:
                if now < self.until:
                    return K.NAN
                self.until = None
        try:
            return float(self.fn(*args))
        except Exception as e:  # noqa: BLE001  whatever a user's function raises, the node is NaN and the rest goes on
            self.error = e
            if self.breaker:
                self.until = now + self.breaker
            return K.NAN

    def run(self, args, now=None):
        times = itertools.repeat(None) if now is None else now.tolist()
        return np.array([self.step(row, t) for row, t in zip(zip(*(a.tolist() for a in args), strict=True), times)], float)


def _number(p: dict, key: str, default: float) -> float:
    return default if p.get(key) is None else float(p[key])


def _whole(p: dict, key: str, default: int) -> int:
    return default if p.get(key) is None else int(float(p[key]))


def flag(p: dict, key: str) -> bool:
    """True, or the text of it: a template fills properties with strings."""
    given = str(p.get(key, False)).lower()
    if given not in ("true", "false"):
        raise ValueError(f"{key} must be true or false")
    return given == "true"


def _comparison(p: dict):
    operator, threshold = p.get("operator", ">"), p.get("threshold", 0.0)
    if callable(operator):
        return operator
    if operator not in COMPARISONS:
        raise ValueError(f"unknown operator {operator}")
    test, t = COMPARISONS[operator], float(threshold)
    return lambda x: test(x, t)


def _vector_size(p: dict) -> int:
    size = _whole(p, "size", -1)
    if size <= 0:
        raise ValueError("size must be positive")
    return size


def default_registry() -> Registry:
    r = Registry()
    one = ("input",)

    def scalar(name, inputs, make):
        r.add(Kind(name, "scalar", inputs, make, cutoff=True))

    r.add(Kind("SCALAR_SOURCE", "scalar", (), lambda p: _number(p, "value", K.NAN), source=True, cutoff=True))
    r.add(Kind("VECTOR_SOURCE", "vector", (), _vector_size, source=True))
    r.add(Kind("TIMER", "timer", (), lambda p: _number(p, "intervalMs", 1000.0), source=True))
    scalar("SPREAD", ("a", "b"), lambda p: K.spread())
    scalar("TRI_ARB_SPREAD", ("leg1", "leg2", "direct"), lambda p: K.tri_arb())
    scalar("AVERAGE", None, lambda p: K.average())
    scalar("WEIGHTED_AVG", None, lambda p: K.weighted_average(flag(p, "ieee")))
    scalar("HARMONIC_MEAN", None, lambda p: K.harmonic_mean(flag(p, "ieee")))
    for name, kernel in (("SMA", K.Sma), ("ROLLING_MAX", K.RollingMax), ("ROLLING_MIN", K.RollingMin), ("ROLLING_SUM", K.RollingSum), ("ROLLING_VARIANCE", K.RollingVariance)):
        scalar(name, one, lambda p, k=kernel: k(_whole(p, "window", 10)))
    scalar("HIST_VOL", ("logReturn",), lambda p: K.HistVol(_whole(p, "window", 10)))
    scalar("Z_SCORE", one, lambda p: K.ZScore(_whole(p, "window", 20)))
    scalar("BETA", ("x", "y"), lambda p: K.Beta(_whole(p, "window", 20)))
    scalar("CORRELATION", ("x", "y"), lambda p: K.Correlation(_whole(p, "window", 20)))
    scalar("DIFF", one, lambda p: K.Diff())
    scalar("LOG_RETURN", one, lambda p: K.LogReturn())
    scalar("EWMA", one, lambda p: K.Ewma(_number(p, "alpha", 0.1)))
    scalar("MACD", one, lambda p: K.Macd(_whole(p, "fast", 12), _whole(p, "slow", 26)))
    scalar("RSI", one, lambda p: K.Rsi(_whole(p, "window", 14)))
    r.add(Kind("THROTTLE", "scalar", one, lambda p: K.Throttle(_number(p, "windowMs", 100.0)), timed=True))
    r.add(Kind("TIME_DECAY", "scalar", one, lambda p: K.TimeDecay(_number(p, "halfLifeMs", 100.0)), timed=True))
    r.add(Kind("TIMER_EWMA", "scalar", None, lambda p: K.TimeDecay(_number(p, "halfLifeMs", 100.0)), timed=True))
    r.add(Kind("TIMER_TWAP", "scalar", None, lambda p: K.Twap(), timed=True))
    r.add(Kind("CONDITION", "boolean", one, _comparison))
    r.add(Kind("SWITCH", "switch", ("input", "condition")))
    r.add(Kind("SELECT", "select", ("condition", "ifTrue", "ifFalse")))
    r.add(Kind("VECTOR_ELEMENT", "element", None, lambda p: _whole(p, "index", 0)))
    r.add(Kind("COMPUTE_VECTOR", "copy", None, _vector_size))
    return r
