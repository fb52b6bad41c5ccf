"""A fluent front end to graph specs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..functions.registry import Kind, Registry, UserFunction, default_registry
from .spec import GraphSpec, NodeSpec, assemble


class GraphBuilder:
    """Adds nodes by method; each returns the node's name, to be passed on as an input."""

    def __init__(self, name: str = "graph", registry: Registry | None = None):
        self.name, self._registry = name, registry or default_registry()
        self._nodes: dict[str, NodeSpec] = {}
        self._built = False

    def node(self, name: str, type: str, inputs: dict[str, str] | None = None, **properties: Any) -> str:
        if self._built:
            raise RuntimeError("the graph is built")
        if name in self._nodes:
            raise ValueError(f"duplicate node name {name}")
        self._nodes[name] = NodeSpec(name, type, inputs or {}, {k: v for k, v in properties.items() if v is not None})
        return name

    def scalar_source(self, name: str, value: float = float("nan"), cutoff=None, tolerance: float | None = None) -> str:
        return self.node(name, "SCALAR_SOURCE", value=value, cutoff=cutoff, tolerance=tolerance)

    def vector_source(self, name: str, size: int, tolerance: float = 1e-15, headers: list[str] | None = None) -> str:
        return self.node(name, "VECTOR_SOURCE", size=size, tolerance=tolerance, headers=headers)

    def timer(self, name: str, interval_ms: int) -> str:
        return self.node(name, "TIMER", intervalMs=interval_ms)

    def _user(self, kind: str, shape: str, make: Callable) -> str:
        name = f"{kind}#{len(self._registry.kinds())}"
        self._registry.add(Kind(name.upper(), shape, None, make, cutoff=shape == "scalar"))
        return name

    def compute(self, name: str, fn: Callable[..., float], *inputs: str, cutoff=None, tolerance: float | None = None, breaker_ms: float = 0.0) -> str:
        """fn(*values) -> float; errors give NaN, and no calls for ``breaker_ms`` after one. It sees NaN inputs."""
        kind = self._user("COMPUTE", "scalar", lambda p: UserFunction(fn, breaker_ms))
        return self.node(name, kind, {f"{i:06d}": x for i, x in enumerate(inputs)}, cutoff=cutoff, tolerance=tolerance)

    def compute_vector(self, name: str, size: int, fn: Callable[[list[float]], list[float]], *inputs: str, tolerance: float = 1e-15) -> str:
        """fn(flattened inputs) -> list of ``size`` numbers; errors give NaN elements."""
        if size <= 0:
            raise ValueError("size must be positive")
        kind = self._user("VECTOR_MATH", "vector_math", lambda p: fn)
        return self.node(name, kind, {f"{i:06d}": x for i, x in enumerate(inputs)}, size=size, tolerance=tolerance)

    def vector_element(self, name: str, vector: str, index: int) -> str:
        return self.node(name, "VECTOR_ELEMENT", {"vector": vector}, index=index)

    def condition(self, name: str, source: str, test: Callable[[float], bool] | str, threshold: float = 0.0) -> str:
        return self.node(name, "CONDITION", {"input": source}, operator=test, threshold=threshold)

    def select(self, name: str, condition: str, if_true: str, if_false: str) -> str:
        return self.node(name, "SELECT", {"condition": condition, "ifTrue": if_true, "ifFalse": if_false})

    def switch(self, name: str, source: str, condition: str) -> str:
        return self.node(name, "SWITCH", {"input": source, "condition": condition}, true_branch=[], false_branch=[])

    def mark_branch(self, switch: str, node: str, side: bool) -> None:
        """Node is evaluated through the switch only when its condition is ``side``."""
        self._nodes[switch].properties["true_branch" if side else "false_branch"].append(node)

    def throttle(self, name: str, source: str, window_ms: float) -> str:
        return self.node(name, "THROTTLE", {"input": source}, windowMs=window_ms)

    def rolling(self, name: str, kind: str, source: str, size: int) -> str:
        return self.node(name, kind, {"input": source}, window=size)

    def windowed(self, name: str, source: str, size: int, accumulator: Callable[[], Any], cutoff=None, tolerance: float | None = None) -> str:
        """A window under a user's accumulator: anything with add(x), remove(x) and result(). NaN inputs aren't added."""
        kind = f"WINDOWED#{len(self._registry.kinds())}"
        self._registry.accumulator(kind, lambda p: accumulator())
        return self.node(name, kind, {"input": source}, window=size, cutoff=cutoff, tolerance=tolerance)

    def time_decay(self, name: str, source: str, half_life_ms: float) -> str:
        return self.node(name, "TIME_DECAY", {"input": source}, halfLifeMs=half_life_ms)

    def timer_ewma(self, name: str, source: str, timer: str | None, half_life_ms: float) -> str:
        return self.node(name, "TIMER_EWMA", {"a": source} | ({"b": timer} if timer else {}), halfLifeMs=half_life_ms)

    def timer_twap(self, name: str, source: str, timer: str | None = None) -> str:
        return self.node(name, "TIMER_TWAP", {"a": source} | ({"b": timer} if timer else {}))

    def template(self, prefix: str, factory: Callable[[GraphBuilder, str, Any], Any], config: Any = None) -> Any:
        return factory(self, prefix, config)

    def build(self) -> GraphSpec:
        if self._built:
            raise RuntimeError("the graph is built")
        self._built = True
        return assemble(self.name, "", list(self._nodes.values()), self._registry)
