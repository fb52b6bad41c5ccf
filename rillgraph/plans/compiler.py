"""From a graph and an epoch table to a DataFrame of node values.

Two readings of the same graph:

* ``changed``: the incremental semantics. A node is evaluated when a parent
  changed; stateful nodes advance once an evaluation.
* ``every_row``: every row evaluates every node.

Physical plans, the cheapest that is exact being taken:

* ``columns``: column expressions and windows, nothing but Catalyst. For graphs of
  stateless nodes (either reading, if all cutoffs are exact), and for
  graphs with windows and lags when every row is an evaluation.
* ``flags``: the incremental reading of graphs of stateless nodes, windows, lags,
  conditions, selects and switches. Each node is three columns: value, evaluated, changed; values
  carry forward over rows that don't evaluate, windows run over those that do.
* ``stretches``: one ordered pass a key with array kernels; when ``changed``, each node runs over the rows that
  evaluate it. For all graphs without vectors.
* ``engine``: one ordered pass a key with the incremental engine, row by row. For vectors.

All need one shuffle by key. Only nodes that the outputs depend on are planned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions.cutoffs import changed_array, changed_column
from ..functions.kernels import NAN
from ..functions.registry import flag
from ..operators.engine import Engine
from ..operators.rolling import Rolling, log_return
from ..operators.scans import doubles, sorted_by_key, stretches
from ..sources.epochs import ordered
from .spec import GraphSpec, as_float, as_int

_STATELESS = {"SPREAD", "TRI_ARB_SPREAD", "AVERAGE", "WEIGHTED_AVG", "HARMONIC_MEAN"}
_LATER = {"CONDITION", "SELECT", "SWITCH"}
_WINDOWS = {"SMA": ("sma", 10), "ROLLING_MAX": ("rolling_max", 10), "ROLLING_MIN": ("rolling_min", 10), "ROLLING_SUM": ("rolling_sum", 10), "ROLLING_VARIANCE": ("rolling_variance", 10), "HIST_VOL": ("hist_vol", 10), "Z_SCORE": ("z_score", 20), "BETA": ("beta", 20), "CORRELATION": ("correlation", 20)}
_LAGS = {"DIFF", "LOG_RETURN"}
#: Nodes that a flagged plan may have: each level adds window operators, and the engine overtakes them.
MAX_FLAGGED = 16


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class CompiledPlan:
    graph: GraphSpec
    outputs: tuple[str, ...]
    evaluation: str
    strategy: str

    def run(self, epochs: DataFrame, *, key: Sequence[str] = (), ts: str = "ts", order: Sequence[str] | None = None, feed: bool = False) -> DataFrame:
        """Key, order and output columns; with ``feed`` (not from columns) also ``updated``, the changed nodes' indices.

        ``epochs`` has a column per source; sources without a column keep their initial value. A timer
        source's column is boolean: true where it ticks.
        """
        order = list(order or (ts, "seq"))
        strategy = next(s for s in strategies(self.graph, "changed") if s in ("stretches", "engine")) if feed and self.evaluation == "changed" else "engine" if feed else self.strategy
        return {"columns": _columns, "flags": _flags, "stretches": _stretches, "engine": _engine}[strategy](self, epochs, list(key), ts, order, feed)


def compile_graph(graph: GraphSpec, outputs: Sequence[str] | None = None, evaluation: str = "changed", strategy: str | None = None) -> CompiledPlan:
    if evaluation not in ("changed", "every_row"):
        raise ValueError(f"unknown evaluation {evaluation}")
    outputs = tuple(outputs or [n.name for n in graph.ordered()])
    graph = graph.restricted(list(outputs))
    possible = strategies(graph, evaluation)
    if strategy is not None and strategy not in possible:
        raise ValueError(f"{strategy} can't express this graph when {evaluation}; possible: {possible}")
    return CompiledPlan(graph, outputs, evaluation, strategy or possible[0])


def strategies(graph: GraphSpec, evaluation: str) -> list[str]:
    kinds = {n.type for n in graph.nodes}
    scalars = kinds - {"SCALAR_SOURCE"}
    exact = all(n.properties.get("cutoff", "exact") == "exact" for n in graph.nodes)
    shapes = {graph.registry.kind(n.type).shape for n in graph.nodes}
    out = []
    if evaluation == "every_row":
        if scalars <= _STATELESS | _LATER | set(_WINDOWS) | _LAGS:
            out.append("columns")
        if shapes <= {"scalar", "boolean", "switch", "select"}:
            out.append("stretches")
    else:
        if scalars <= _STATELESS and exact:
            out.append("columns")
        named = all(isinstance(n.properties.get("cutoff", "exact"), str) and not callable(n.properties.get("operator")) for n in graph.nodes)
        if scalars <= _STATELESS | _LATER | set(_WINDOWS) | _LAGS and named and len(graph.nodes) <= MAX_FLAGGED:
            out.append("flags")
        if shapes <= {"scalar", "boolean", "switch", "select", "timer"}:
            out.append("stretches")
    return [*out, "engine"]


def _source_columns(plan: CompiledPlan, epochs: DataFrame) -> list[str]:
    return [n.name for n in plan.graph.sources() if n.name in epochs.columns]


def _columns(plan: CompiledPlan, epochs: DataFrame, key: list[str], ts: str, order: list[str], feed: bool) -> DataFrame:
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    present = set(_source_columns(plan, epochs))
    df = epochs.select(*key, *order, *[F.col(quoted(n)).cast("double").alias(n) for n in present])
    df = df.withColumns({n.name: F.coalesce(F.last(F.col(quoted(n.name)), ignorenulls=True).over(w) if n.name in present else F.lit(None).cast("double"), F.lit(as_float(n.properties.get("value"), NAN))) for n in plan.graph.sources()})
    for level in _levels(plan.graph):
        # one projection a level, so that shared inputs are computed once
        df = df.withColumns({n.name: _expression(plan.graph, n, key, order) for n in level})
    return df.select(*key, *order, *[F.col(quoted(o)) for o in plan.outputs])


def _levels(graph: GraphSpec) -> list[list]:
    depth: dict[str, int] = {}
    levels: dict[int, list] = {}
    for n in graph.ordered():
        parents = graph.topology.parents(n.name)
        depth[n.name] = 1 + max((depth[p] for p in parents), default=-1)
        if not graph.registry.kind(n.type).source:
            levels.setdefault(depth[n.name], []).append(n)
    return [levels[d] for d in sorted(levels)]


def _flags(plan: CompiledPlan, epochs: DataFrame, key: list[str], ts: str, order: list[str], feed: bool) -> DataFrame:
    graph = plan.graph
    w = ordered(key, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    index = {n: i for i, n in enumerate(graph.topology.order)}
    # d: evaluated, c: changed, s: a switch's side; values are under v
    v, d, c, side = ({n: f"{p}{i}__" for n, i in index.items()} for p in "vdcs")
    present = set(_source_columns(plan, epochs))
    df = epochs.select(*key, *order, *[F.col(quoted(n)).cast("double").alias(f"u{index[n]}__") for n in present])
    df = df.withColumn("first__", F.row_number().over(w) == 1)
    made = {}
    for n in graph.sources():
        start = F.lit(as_float(n.properties.get("value"), NAN))
        update = F.col(f"u{index[n.name]}__") if n.name in present else F.lit(None).cast("double")
        made[v[n.name]] = F.coalesce(F.last(update, ignorenulls=True).over(upto), start)
        made[d[n.name]] = F.col("first__") | update.isNotNull()
    df = df.withColumns(made)
    made = {}
    for n in graph.sources():
        prev, cutoff = F.lag(v[n.name]).over(w), n.properties.get("cutoff", "exact")
        moved = F.lit(False) if cutoff == "never" else changed_column(cutoff, prev, F.col(v[n.name]), _tolerance(n))
        made[c[n.name]] = F.col(d[n.name]) & (prev.isNull() | F.isnan(prev) | moved)
    df = df.withColumns(made)
    for level in _levels(graph):
        df = df.withColumns({d[n.name]: _triggered(graph, n, c, side) for n in level})
        made = {}
        for n in level:
            inputs = [v[p] for _, p in graph.registry.ordered_inputs(n)]
            on = F.col(d[n.name])
            if n.type in _WINDOWS or n.type in _LAGS:
                made[f"r{index[n.name]}__"] = _expression(graph, n, key, order, inputs, on)
            else:
                made[f"r{index[n.name]}__"] = _expression(graph, n, key, order, inputs)
        df = df.withColumns(made)
        made = {}
        for n in level:
            default = F.lit(False) if n.type == "CONDITION" else F.lit(NAN)
            made[v[n.name]] = F.coalesce(F.last(F.when(F.col(d[n.name]), F.col(f"r{index[n.name]}__")), ignorenulls=True).over(upto), default)
            if n.type == "SWITCH":
                test = v[graph.registry.ordered_inputs(n)[1][1]]
                made[side[n.name]] = F.coalesce(F.last(F.when(F.col(d[n.name]), F.col(test)), ignorenulls=True).over(upto), F.lit(False))
            if n.type == "CONDITION":
                made[f"e{index[n.name]}__"] = F.count(F.when(F.col(d[n.name]), 1)).over(upto)
        df = df.withColumns(made)
        made = {}
        for n in level:
            value, prev = F.col(v[n.name]), F.lag(v[n.name]).over(w)
            if n.type == "SWITCH":
                moved = F.lit(True)
            elif n.type == "CONDITION":
                moved = (F.col(f"e{index[n.name]}__") == 1) | (value != F.coalesce(prev, F.lit(False)))
            else:
                moved = changed_column(n.properties.get("cutoff", "exact") if graph.registry.kind(n.type).cutoff else "exact", prev, value, _tolerance(n))
            made[c[n.name]] = F.col(d[n.name]) & moved
        df = df.withColumns(made)
    return df.select(*key, *order, *[F.col(v[o]).alias(o) for o in plan.outputs])


def _tolerance(n) -> float | None:
    return None if n.properties.get("tolerance") is None else float(n.properties["tolerance"])


def _triggered(graph: GraphSpec, n, c: dict[str, str], side: dict[str, str]):
    """Evaluated: any parent changed, over an edge that no switch cuts."""
    out = F.lit(False)
    for p in graph.topology.parents(n.name):
        edge = F.col(c[p])
        spec = graph.node(p)
        if spec.type == "SWITCH":
            yes, no = (n.name in ([b] if isinstance(b, str) else b or []) for b in (spec.properties.get("true_branch"), spec.properties.get("false_branch")))
            if yes != no:
                edge = edge & (F.col(side[p]) if yes else ~F.col(side[p]))
        out = out | edge
    return out


def _expression(graph: GraphSpec, n, key: list[str], order: list[str], columns: list[str] | None = None, also=None):
    names = columns or [quoted(p) for _, p in graph.registry.ordered_inputs(n)]
    inputs = [F.col(p) for p in names]
    p = n.properties
    if n.type in ("WEIGHTED_AVG", "HARMONIC_MEAN"):
        return {"WEIGHTED_AVG": C.weighted_average, "HARMONIC_MEAN": C.harmonic_mean}[n.type](*inputs, ieee=flag(p, "ieee"))
    if n.type in _STATELESS:
        return {"SPREAD": C.spread, "TRI_ARB_SPREAD": C.tri_arb_spread, "AVERAGE": C.average}[n.type](*inputs)
    if n.type == "CONDITION":
        return C.condition(inputs[0], p.get("operator", ">"), as_float(p.get("threshold"), 0.0))
    if n.type == "SELECT":
        return C.select(*inputs)
    if n.type == "SWITCH":
        return inputs[0]
    if n.type == "LOG_RETURN":
        return log_return(names[0], key, order, also)
    rolling = Rolling(names, key, order, also)
    if n.type == "DIFF":
        return rolling.diff()
    method, size = _WINDOWS[n.type]
    return getattr(rolling, method)(as_int(p.get("window"), size))


def _prepared(plan: CompiledPlan, epochs: DataFrame, key: list[str], ts: str, order: list[str]) -> tuple[DataFrame, list[str]]:
    """Sorted rows: keys, time in milliseconds, sources, then what is kept."""
    present = _source_columns(plan, epochs)
    rows = sorted_by_key(epochs.select(*key, *dict.fromkeys(order), *([ts] if ts not in order else []), *[F.col(quoted(c)) for c in present]), key, order)
    return rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], (F.unix_micros(ts) / 1000.0).alias("__now"), *[F.col(quoted(c)).alias(f"__s{i}") for i, c in enumerate(present)], *key, *order), present


def _out_schema(plan: CompiledPlan, rows: DataFrame, kept: list[str], feed: bool) -> T.StructType:
    def kind(n):
        shape = plan.graph.registry.kind(plan.graph.node(n).type).shape
        return T.BooleanType() if shape == "boolean" else T.ArrayType(T.DoubleType()) if shape in ("vector", "copy", "vector_math") else T.DoubleType()

    fields = [rows.schema[k] for k in kept] + [T.StructField(n, kind(n)) for n in plan.outputs]
    return T.StructType(fields + [T.StructField("updated", T.ArrayType(T.IntegerType()))] * feed)


def _stretches(plan: CompiledPlan, epochs: DataFrame, key: list[str], ts: str, order: list[str], feed: bool) -> DataFrame:
    rows, present = _prepared(plan, epochs, key, ts, order)
    graph, outputs, width = plan.graph, plan.outputs, len(key)
    every = plan.evaluation == "every_row"
    schema = _out_schema(plan, rows, [*key, *order], feed)
    skip = width + 1 + len(present)
    names = [*key, *order, *outputs, *(["updated"] if feed else [])]
    order_of = {n: i for i, n in enumerate(graph.topology.order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            n = batch.num_rows
            out: dict[str, np.ndarray] = {}
            moved = np.zeros((n if feed else 0, len(order_of)), bool)
            now = doubles(batch.column(width))
            given = {c: (batch.column(width + 1 + i).is_valid().to_numpy(zero_copy_only=False), doubles(batch.column(width + 1 + i))) for i, c in enumerate(present)}
            for k, a, b in stretches(batch, width):
                if current is None or k != current:
                    current, state = k, (Stretch if every else ChangedStretch)(graph)
                values = state.run({c: (v[a:b], x[a:b]) for c, (v, x) in given.items()}, now[a:b])
                for o in outputs:
                    if o not in out:
                        out[o] = np.empty(n, bool if values[o].dtype == bool else float)
                    out[o][a:b] = values[o]
                if feed:
                    for name, i in order_of.items():
                        moved[a:b, i] = state.changed[name]
            arrays = [pa.array(out.get(o, np.empty(0))) for o in outputs]
            if feed:
                at, which = np.nonzero(moved)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32)), pa.array(which.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*batch.columns[skip:], *arrays], names=names)

    return rows.mapInArrow(run, schema)


class Stretch:
    """Array evaluation of scalar graphs, every row of a key an evaluation of every node."""

    def __init__(self, graph: GraphSpec):
        self.nodes = []
        for n in graph.ordered():
            kind = graph.registry.kind(n.type)
            made = kind.make(n.properties) if kind.make else None
            parents = [p for _, p in graph.registry.ordered_inputs(n)]
            self.nodes.append((n, kind, made, parents[:1] if kind.timed else parents))
        self.held = {n.name: made for n, kind, made, _ in self.nodes if kind.source}

    def run(self, given: dict[str, tuple[np.ndarray, np.ndarray]], now: np.ndarray) -> dict[str, np.ndarray]:
        v: dict[str, np.ndarray] = {}
        for n, kind, made, parents in self.nodes:
            args = [v[p] for p in parents]
            if kind.source:
                if n.name in given:
                    ok, x = given[n.name]
                    at = np.maximum.accumulate(np.where(ok, np.arange(len(x)), -1))
                    v[n.name] = np.where(at >= 0, x[at], self.held[n.name])
                else:
                    v[n.name] = np.full(len(now), self.held[n.name])
                if len(now):
                    self.held[n.name] = float(v[n.name][-1])
            elif kind.shape == "boolean":
                v[n.name] = np.fromiter((bool(made(x)) for x in args[0].tolist()), bool, len(now))
            elif kind.shape == "switch":
                v[n.name] = args[0]
            elif kind.shape == "select":
                v[n.name] = np.where(args[0], args[1], args[2])
            else:
                v[n.name] = made.run([a.astype(float) for a in args], now)
        return v


class ChangedStretch:
    """Array evaluation with the incremental engine's results: a node runs over the rows in which a parent changed."""

    def __init__(self, graph: GraphSpec):
        self.graph, self.nodes, self.first = graph, [], True
        self.changed: dict[str, np.ndarray] = {}
        self.last: dict[str, float | bool] = {}  # of each node: the value, of switches also the side, and if it was evaluated
        self.side: dict[str, bool] = {}
        self.seen: set[str] = set()
        for n in graph.ordered():
            kind = graph.registry.kind(n.type)
            made = kind.make(n.properties) if kind.make else None
            parents = [p for _, p in graph.registry.ordered_inputs(n)]
            cutoff = changed_array(n.properties if kind.cutoff else {}, kind.source)
            self.nodes.append((n, kind, made, parents[:1] if kind.timed else parents, cutoff))
            self.last[n.name] = False if kind.shape == "boolean" else 0.0 if kind.shape == "timer" else NAN

    def run(self, given: dict[str, tuple[np.ndarray, np.ndarray]], now: np.ndarray) -> dict[str, np.ndarray]:
        v: dict[str, np.ndarray] = {}
        sides: dict[str, np.ndarray] = {}
        rows = len(now)
        for n, kind, made, parents, cutoff in self.nodes:
            name = n.name
            if kind.source:
                ok, x = given.get(name, (np.zeros(rows, bool), np.full(rows, NAN)))
                on = ok & (x != 0) if kind.shape == "timer" else ok.copy()
                if self.first and rows:
                    on[0] = True
            else:
                on = np.zeros(rows, bool)
                for p in self.graph.topology.parents(name):
                    on |= self.changed[p] & self._open(p, name, sides)
            at = np.flatnonzero(on)
            before = self.last[name]
            if not len(at):
                v[name], self.changed[name] = np.full(rows, before), on
                if kind.shape == "switch":
                    sides[name] = np.full(rows, self.side.get(name, False))
                continue
            if kind.shape == "timer":
                values = before + np.arange(1.0, len(at) + 1)
            elif kind.source:
                values = np.where(ok[at], x[at], made)  # without an update, the first row gives the initial value
            elif kind.shape == "boolean":
                args = v[parents[0]][at]
                values = np.fromiter((bool(made(a)) for a in args.tolist()), bool, len(at))
            elif kind.shape == "switch":
                values = v[parents[0]][at].astype(float)
            elif kind.shape == "select":
                values = np.where(v[parents[0]][at], v[parents[1]][at], v[parents[2]][at]).astype(float)
            else:
                values = made.run([v[p][at].astype(float) for p in parents], now[at])
            prev = np.concatenate([[before], values[:-1]])
            if kind.shape in ("timer", "switch"):
                moved = np.ones(len(at), bool)
            elif kind.shape == "boolean":
                moved = prev != values
                moved[0] |= name not in self.seen
            else:
                moved = cutoff(prev, values)
            self.seen.add(name)
            upto = np.cumsum(on) - 1
            v[name] = np.where(upto >= 0, values[np.maximum(upto, 0)], before)
            on[at] = moved
            self.changed[name] = on
            self.last[name] = values[-1]
            if kind.shape == "switch":
                taken = v[parents[1]][at].astype(bool)
                sides[name] = np.where(upto >= 0, taken[np.maximum(upto, 0)], self.side.get(name, False))
                self.side[name] = bool(taken[-1])
        self.first = self.first and not rows
        return v

    def _open(self, parent: str, child: str, sides: dict[str, np.ndarray]):
        """Rows in which no switch cuts the edge."""
        if parent not in sides:
            return True
        p = self.graph.node(parent).properties
        yes, no = (child in ([b] if isinstance(b, str) else b or []) for b in (p.get("true_branch"), p.get("false_branch")))
        return True if yes == no else sides[parent] if yes else ~sides[parent]


def _engine(plan: CompiledPlan, epochs: DataFrame, key: list[str], ts: str, order: list[str], feed: bool) -> DataFrame:
    rows, present = _prepared(plan, epochs, key, ts, order)
    graph, outputs, width, every = plan.graph, plan.outputs, len(key), plan.evaluation == "every_row"
    schema = _out_schema(plan, rows, [*key, *order], feed)
    skip = width + 1 + len(present)
    timers = {n.name for n in graph.sources() if graph.registry.kind(n.type).shape == "timer"}
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, engine = None, None
        for batch in batches:
            columns = [batch.column(width + 1 + i).to_pylist() for i in range(len(present))]
            now = batch.column(width).to_pylist()
            out: list[list] = [[] for _ in outputs]
            updated: list[list[int]] = []
            for k, a, b in stretches(batch, width):
                if current is None or k != current:
                    current, engine = k, Engine(graph, every=every)
                for r in range(a, b):
                    for name, column in zip(present, columns, strict=True):
                        x = column[r]
                        if x is None:
                            continue
                        if name in timers:
                            if x:
                                engine.mark(name)
                        elif isinstance(x, list):
                            _update_vector(engine, name, x)
                        else:
                            engine.update(name, x)
                    engine.stabilize(now[r])
                    for o, name in zip(out, outputs, strict=True):
                        o.append(engine.value(name))
                    if feed:
                        updated.append([i for i, c in enumerate(engine.changed) if c])
            arrays = [pa.array(o, arrow.field(n).type) for o, n in zip(out, outputs, strict=True)]
            if feed:
                arrays.append(pa.array(updated, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[skip:], *arrays], names=arrow.names)

    return rows.mapInArrow(run, schema)


def _update_vector(engine: Engine, name: str, x: list) -> None:
    """Null elements keep their pending value."""
    if any(e is None for e in x):
        for i, e in enumerate(x):
            if e is not None:
                engine.update(name, e, i)
    else:
        engine.update(name, x)
