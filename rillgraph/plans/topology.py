"""Directed acyclic order of named nodes (driver side)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class CycleError(RuntimeError):
    """The graph has a cycle, or a node waits for one that never comes."""


class Topology:
    """Nodes in dependency order; equal candidates keep the order they were added in."""

    def __init__(self, names: Iterable[str], edges: Iterable[tuple[str, str]], sources: Iterable[str] = ()):
        given = list(names)
        if len(set(given)) != len(given):
            raise ValueError("duplicate node name")
        known = set(given)
        children: dict[str, list[str]] = {n: [] for n in given}
        parents: dict[str, list[str]] = {n: [] for n in given}
        for a, b in edges:
            if a not in known or b not in known:
                raise ValueError(f"unknown node in edge {a} -> {b}")
            if a == b:
                raise ValueError(f"self edge on {a}")
            children[a].append(b)
            parents[b].append(a)
        for s in sources:
            if s not in known:
                raise ValueError(f"unknown source {s}")
        waiting = {n: len(parents[n]) for n in given}
        ready = deque(n for n in given if not waiting[n])
        order: list[str] = []
        while ready:
            n = ready.popleft()
            order.append(n)
            for c in children[n]:
                waiting[c] -= 1
                if not waiting[c]:
                    ready.append(c)
        if len(order) != len(given):
            raise CycleError("cycle among " + ", ".join(sorted(n for n in given if waiting[n] > 0)))
        self.order = order
        self._index = {n: i for i, n in enumerate(order)}
        self._children, self._parents, self._sources = children, parents, set(sources)

    @property
    def node_count(self) -> int:
        return len(self.order)

    def node(self, index: int) -> str:
        if not 0 <= index < len(self.order):
            raise IndexError(index)
        return self.order[index]

    def index(self, name: str) -> int:
        if name not in self._index:
            raise ValueError(f"unknown node {name}")
        return self._index[name]

    def is_source(self, name: str) -> bool:
        return name in self._sources

    def children(self, name: str) -> list[str]:
        return list(self._children[self.order[self.index(name)]])

    def parents(self, name: str) -> list[str]:
        return list(self._parents[self.order[self.index(name)]])

    def ancestors(self, names: Iterable[str]) -> set[str]:
        """The names and everything that they depend on."""
        seen: set[str] = set()
        todo = list(names)
        while todo:
            n = todo.pop()
            self.index(n)
            if n not in seen:
                seen.add(n)
                todo += self._parents[n]
        return seen

    def descendants(self, names: Iterable[str]) -> set[str]:
        seen: set[str] = set()
        todo = list(names)
        while todo:
            n = todo.pop()
            self.index(n)
            if n not in seen:
                seen.add(n)
                todo += self._children[n]
        return seen
