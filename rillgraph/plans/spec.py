"""Graph documents: nodes, templates, and how they expand to a flat graph."""

from __future__ import annotations

import json
import re
from collections import deque
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from ..functions.registry import Registry, default_registry
from .topology import CycleError, Topology

_SLOT = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")
#: Templates inside templates; deeper ones are taken to contain themselves.
MAX_DEPTH = 32


@dataclass(frozen=True)
class NodeSpec:
    name: str
    type: str
    inputs: dict[str, str] = field(default_factory=dict)
    properties: dict[str, Any] = field(default_factory=dict)
    description: str | None = None


@dataclass(frozen=True)
class GraphSpec:
    """A flat graph: expanded nodes in document order, their edges and order."""

    name: str
    version: str
    nodes: tuple[NodeSpec, ...]
    topology: Topology
    edge_labels: dict[tuple[str, str], list[str]]
    registry: Registry

    def node(self, name: str) -> NodeSpec:
        for n in self.nodes:
            if n.name == name:
                return n
        raise ValueError(f"unknown node {name}")

    def ordered(self) -> list[NodeSpec]:
        by = {n.name: n for n in self.nodes}
        return [by[n] for n in self.topology.order]

    def sources(self) -> list[NodeSpec]:
        return [n for n in self.ordered() if self.registry.kind(n.type).source]

    def restricted(self, outputs: list[str]) -> GraphSpec:
        """Only what the outputs depend on."""
        keep = self.topology.ancestors(outputs)
        return assemble(self.name, self.version, [n for n in self.nodes if n.name in keep], self.registry)


def as_float(value: Any, default: float) -> float:
    """Numbers and numeric strings; a template fills properties with strings."""
    if value is None:
        return default
    return float(value)


def as_int(value: Any, default: int) -> int:
    if value is None:
        return default
    return int(float(value))


def fill(text: str, values: dict[str, Any]) -> str:
    """Replace {{name}}; names without a value stay as written."""
    return _SLOT.sub(lambda m: str(values[m[1]]) if m[1] in values else m[0], text)


def expand(nodes: list[dict], templates: dict[str, list[dict]]) -> list[dict]:
    """Instances of templates become nodes, level by level."""
    out: list[dict] = []
    todo = deque((n, 0) for n in nodes)
    while todo:
        n, depth = todo.popleft()
        if str(n.get("type", "")).upper() != "TEMPLATE":
            out.append(n)
            continue
        values = n.get("properties") or {}
        wanted = values.get("template")
        if not wanted:
            raise ValueError("a template instance names no template")
        if wanted not in templates:
            raise ValueError(f"unknown template {wanted}")
        if depth >= MAX_DEPTH:
            raise ValueError(f"template {wanted} contains itself")
        for inner in templates[wanted]:
            made = dict(inner)
            if made.get("name") is not None:
                made["name"] = fill(made["name"], values)
            made["inputs"] = {k: fill(v, values) for k, v in (made.get("inputs") or {}).items()}
            made["properties"] = {k: fill(v, values) if isinstance(v, str) else v for k, v in (made.get("properties") or {}).items()}
            todo.append((made, depth + 1))
    return out


def auto_expand(nodes: list[dict]) -> list[dict]:
    """A vector that asks for it gets an element node per label."""
    out = []
    for n in nodes:
        out.append(n)
        p = n.get("properties") or {}
        if str(p.get("auto_expand", "")).lower() != "true" or "size" not in p:
            continue
        size = as_int(p["size"], 0)
        labels = p.get("auto_expand_labels") or p.get("headers") or [f"{p.get('auto_expand_prefix', 'Elem')}{i}" for i in range(size)]
        for i, label in enumerate(list(labels)[:size]):
            out.append({"name": f"{n['name']}.{label}", "type": "VECTOR_ELEMENT", "inputs": {"vector": n["name"]}, "properties": {"index": i}})
    return out


def assemble(name: str, version: str, nodes: list[NodeSpec], registry: Registry) -> GraphSpec:
    """Bind inputs, check them, and order the nodes."""
    edges: list[tuple[str, str]] = []
    labels: dict[tuple[str, str], list[str]] = {}
    names = [n.name for n in nodes]
    known = set(names)
    sources = []
    bound = []
    for n in nodes:
        kind = registry.kind(n.type)
        if kind.source:
            sources.append(n.name)
        for key in kind.inputs or ():
            if key not in n.inputs:
                raise ValueError(f"{n.name}: input {key} is missing")
        kind.check(n)
        ordered = registry.ordered_inputs(n)
        for key, parent in [*ordered, *((k, v) for k, v in n.inputs.items() if k not in {x for x, _ in ordered})]:
            if parent not in known:
                raise CycleError(f"cycle or missing dependency: {n.name} needs {parent}")
            if (parent, n.name) not in labels:
                edges.append((parent, n.name))
            labels.setdefault((parent, n.name), []).append(key)
        bound.append(replace(n, type=kind.name))
    return GraphSpec(name, version, tuple(bound), Topology(names, edges, sources), labels, registry)


def load_graph(document: str | Path | dict, registry: Registry | None = None) -> GraphSpec:
    """A graph from a JSON file, a JSON text or a parsed document."""
    if isinstance(document, dict):
        parsed = document
    else:
        text = str(document)
        try:
            parsed = json.loads(text if text.lstrip().startswith("{") else Path(text).read_text())
        except OSError as e:
            raise RuntimeError(f"can't read graph {document}") from e
    graph = parsed["graph"]
    registry = registry or default_registry()
    templates = {t["name"]: t.get("nodes") or [] for t in graph.get("templates") or []}
    flat = auto_expand(expand(graph.get("nodes") or [], templates))
    nodes = [NodeSpec(n["name"], n["type"], dict(n.get("inputs") or {}), dict(n.get("properties") or {}), n.get("description")) for n in flat]
    return assemble(graph.get("name", ""), str(graph.get("version", "")), nodes, registry)


def template_spec(document: dict, template: str, registry: Registry | None = None, **values: Any) -> GraphSpec:
    """One instance of a template as a graph of its own; instances become keys of rows."""
    graph = document["graph"]
    templates = {t["name"]: t.get("nodes") or [] for t in graph.get("templates") or []}
    return load_graph({"graph": {"name": template, "version": graph.get("version", ""), "templates": [{"name": k, "nodes": v} for k, v in templates.items()], "nodes": [{"type": "TEMPLATE", "properties": {"template": template, **values}}]}}, registry)
