"""A graph over a stream: one engine per key in the state store.

Rows of a micro-batch are sorted by (ts, seq) within their key, since the stream
gives no order. State is a checkpointed value, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.engine import Engine
from ..plans.compiler import CompiledPlan, quoted

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GraphProcessor(StatefulProcessor):
    def __init__(self, plan: CompiledPlan, key: Sequence[str], ts: str, order: Sequence[str], sources: Sequence[str]):
        self.plan, self.key, self.ts, self.order, self.sources = plan, list(key), ts, list(order), list(sources)

    def init(self, handle) -> None:
        self.state = handle.getValueState("engine", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        engine = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        fresh = Engine(self.plan.graph, every=self.plan.evaluation == "every_row")
        if engine is not None:
            restore(fresh, engine)
        timers = {n.name for n in self.plan.graph.sources() if n.type == "TIMER"}
        out: dict[str, list] = {n: [] for n in self.plan.outputs}
        names = [f"rg_s{i}" for i in range(len(self.sources))]
        for now, *values in batch[["rg_now", *names]].itertuples(index=False, name=None):
            for name, x in zip(self.sources, values, strict=True):
                if x is None:
                    continue
                if name in timers:
                    if x:
                        fresh.mark(name)
                elif hasattr(x, "__len__"):
                    fresh.update(name, list(x))
                else:
                    fresh.update(name, x)
            fresh.stabilize(now)
            for n in out:
                out[n].append(fresh.value(n))
        self.state.update((pickle.dumps(saved(fresh)),))
        yield pd.DataFrame({**{k: batch[k].to_numpy() for k in [*self.key, *self.order]}, **out})

    def close(self) -> None: ...


def saved(engine: Engine) -> dict[str, Any]:
    """State of an engine without its graph."""
    return {"epoch": engine.epoch, "events": engine.events, "dirty": engine._dirty, "cells": [(c.value, getattr(c, "pending", None), c.evaluations, getattr(c, "side", None), _kernel_state(c)) for c in engine.cells]}


def _kernel_state(cell):
    kernel = getattr(cell, "kernel", None)
    return vars(kernel) if hasattr(kernel, "step") and kernel is not cell and type(kernel).__name__ not in ("Plain", "UserFunction") else None


def restore(engine: Engine, state: dict[str, Any]) -> None:
    engine.epoch, engine.events, engine._dirty = state["epoch"], state["events"], state["dirty"]
    for cell, (value, pending, evaluations, side, kernel) in zip(engine.cells, state["cells"], strict=True):
        cell.value, cell.evaluations = value, evaluations
        if pending is not None:
            cell.pending = pending
        if hasattr(cell, "prev") and evaluations:
            cell.prev = value
        if side is not None:
            cell.side = side
        if kernel is not None:
            vars(cell.kernel).update(kernel)


def stream(plan: CompiledPlan, events: DataFrame, *, key: Sequence[str], ts: str = "ts", order: Sequence[str] | None = None) -> DataFrame:
    """Node values for each row of a streaming epoch table.

    The state is kept in RocksDB; set spark.sql.streaming.stateStore.providerClass to ROCKSDB.
    """
    order = list(order or (ts, "seq"))
    sources = [n.name for n in plan.graph.sources() if n.name in events.columns]
    timers = {n.name for n in plan.graph.sources() if n.type == "TIMER"}
    vectors = {n.name for n in plan.graph.sources() if n.type == "VECTOR_SOURCE"}
    cast = lambda c: "boolean" if c in timers else "array<double>" if c in vectors else "double"
    rows = events.select(*key, *order, (F.unix_micros(ts) / 1000.0).alias("rg_now"), *[F.when(F.col(quoted(c)).isNotNull(), F.col(quoted(c)).cast(cast(c))).alias(f"rg_s{i}") for i, c in enumerate(sources)])
    # pandas can't tell a missing double from NaN; arrays of none or one can
    rows = rows.select(*key, *order, "rg_now", *[F.col(f"rg_s{i}") if c in vectors or c in timers else F.when(F.col(f"rg_s{i}").isNotNull(), F.array(f"rg_s{i}")).alias(f"rg_s{i}") for i, c in enumerate(sources)])
    fields = [rows.schema[c] for c in [*key, *order]]
    shape = lambda n: plan.graph.registry.kind(plan.graph.node(n).type).shape
    kind = lambda n: T.BooleanType() if shape(n) == "boolean" else T.ArrayType(T.DoubleType()) if shape(n) in ("vector", "copy", "vector_math") else T.DoubleType()
    schema = T.StructType(fields + [T.StructField(n, kind(n)) for n in plan.outputs])
    scalars = [c not in vectors and c not in timers for c in sources]
    processor = _Unwrapping(plan, key, ts, order, sources)
    processor.scalars = scalars
    made = rows.groupBy(*key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")
    # pandas gave NaN away as null; a node's value is never null
    plain = {n: F.coalesce(F.col(quoted(n)), F.lit(float("nan"))) for n in plan.outputs if isinstance(kind(n), T.DoubleType)}
    return made.withColumns(plain) if plain else made


class _Unwrapping(GraphProcessor):
    """Scalars come as arrays of one, so that null and NaN stay apart."""

    scalars: list[bool] = []

    def handleInputRows(self, key, rows, timerValues):
        def plain(frames):
            for f in frames:
                f = f.copy()
                for i, scalar in enumerate(self.scalars):
                    if scalar:
                        f[f"rg_s{i}"] = pd.Series([None if x is None else float(x[0]) for x in f[f"rg_s{i}"]], index=f.index, dtype=object)
                yield f

        yield from super().handleInputRows(key, plain(rows), timerValues)


def to_sink(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """foreachBatch with a trigger; without an interval, all that is there and then stop."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class Throttled:
    """A sink that passes a micro-batch on only if ``interval_s`` has passed since the last one passed; others are dropped.

    For pages that show the present: a dropped batch isn't kept for later.
    """

    def __init__(self, write: Callable[[DataFrame, int], None], interval_s: float, clock: Callable[[], float] = time.monotonic):
        self.write, self.interval, self.clock = write, interval_s, clock
        self.last: float | None = None
        self.passed = self.dropped = 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.interval:
            self.dropped += 1
            return
        self.last = now
        self.passed += 1
        self.write(batch, number)


def backpressure(query) -> dict[str, float]:
    """How far a running query is behind its source, from its last progress: rows in and out a second, and the share of capacity used."""
    progress = query.lastProgress
    if progress is None:
        return {"input_per_s": 0.0, "processed_per_s": 0.0, "load": 0.0, "behind": 0.0}
    rate = lambda name: float(progress[name] or 0.0)
    came, done = rate("inputRowsPerSecond"), rate("processedRowsPerSecond")
    return {"input_per_s": came, "processed_per_s": done, "load": came / done if done else 0.0, "behind": max(0.0, came - done)}
