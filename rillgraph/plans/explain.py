"""What a graph is and why a node has its value, as text and tables (driver side)."""

from __future__ import annotations

import inspect
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.engine import Engine
from .spec import GraphSpec


def dump(graph: GraphSpec) -> str:
    t = graph.topology
    return "\n".join(f"[{i}] {n} ({graph.node(n).type}) -> {', '.join(t.children(n)) or '-'}" for i, n in enumerate(t.order))


def mermaid(graph: GraphSpec) -> str:
    t = graph.topology
    lines = ["graph TD"]
    lines += [f'  n{i}["{n}<br/>{graph.node(n).type}"]' for i, n in enumerate(t.order)]
    for (a, b), keys in graph.edge_labels.items():
        lines.append(f"  n{t.index(a)} -->|{', '.join(keys)}| n{t.index(b)}")
    return "\n".join(lines)


def explain_node(engine: Engine, name: str) -> str:
    i = engine.at[name] if name in engine.at else None
    if i is None:
        raise ValueError(f"unknown node {name}")
    t = engine.graph.topology
    rows = [f"{name}: {engine.graph.node(name).type}, index {i}, value {engine.value(name)}, {'changed' if engine.changed[i] else 'unchanged'}"]
    rows += [f"  from {p} = {engine.value(p)}" for p in t.parents(name)]
    rows += [f"  to {c}" for c in t.children(name)]
    return "\n".join(rows)


def explain_last(engine: Engine) -> str:
    head = f"epoch {engine.epoch}: {engine.last_evaluated} of {len(engine.cells)} nodes evaluated"
    return "\n".join([head, *(f"  {n} = {engine.value(n)}{' *' if engine.changed[i] else ''}" for i, n in enumerate(engine.names) if engine.evaluated[i])])


def document(graph: GraphSpec) -> dict:
    """The flat graph as a document that load_graph reads again."""
    return {
        "graph": {
            "name": graph.name,
            "version": graph.version,
            "nodes": [{"name": n.name, "type": n.type, "inputs": n.inputs, "properties": {k: v for k, v in n.properties.items() if not k.startswith("auto_expand")}} | ({"description": n.description} if n.description else {}) for n in graph.nodes],
        }
    }


def edges(spark: SparkSession, graph: GraphSpec) -> DataFrame:
    rows = [(a, b, ",".join(k)) for (a, b), k in graph.edge_labels.items()]
    return spark.createDataFrame(rows, "parent string, child string, label string")


def kernel_source(graph: GraphSpec, name: str) -> str:
    """Source text of the function behind a node."""
    made = graph.registry.kind(graph.node(name).type).make(graph.node(name).properties)
    return inspect.getsource(made if inspect.isfunction(made) else type(made))


def init_payload(graph: GraphSpec) -> dict:
    """What a live page needs before its first tick: the drawing, who feeds whom, descriptions, edge labels and sources of functions."""
    t = graph.topology
    sources = {}
    for n in t.order:
        if not graph.registry.kind(graph.node(n).type).source:
            try:
                sources[n] = kernel_source(graph, n)
            except (OSError, TypeError, AttributeError):  # no text to be had, as of functions typed in
                sources[n] = ""
    return {
        "type": "init",
        "name": graph.name,
        "version": graph.version,
        "mermaid": mermaid(graph),
        "nodes": list(t.order),
        "routing": {n: list(t.children(n)) for n in t.order},
        "descriptions": {n: graph.node(n).description for n in t.order if graph.node(n).description},
        "edge_labels": [{"from": a, "to": b, "labels": list(names)} for (a, b), names in graph.edge_labels.items()],
        "sources": sources,
    }


def lineage(edge_table: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Transitive closure (ancestor, descendant) of an edge table, by recursive SQL."""
    view = f"edges_{uuid.uuid4().hex}"  # a name of its own, so that calls at once don't meet
    edge_table.createOrReplaceTempView(view)
    return edge_table.sparkSession.sql(
        f"WITH RECURSIVE r(ancestor, descendant) AS (SELECT `{parent}`, `{child}` FROM {view} UNION ALL SELECT r.ancestor, e.`{child}` FROM r JOIN {view} e ON r.descendant = e.`{parent}`) SELECT DISTINCT ancestor, descendant FROM r"
    )
