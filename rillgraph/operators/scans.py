"""Ordered passes: recurrences over the rows of each key, in bounded memory.

Rows are dealt by key and sorted inside partitions; a Python task then reads Arrow
batches as they come and keeps one key's kernel state between batches. No group is ever
gathered, so a key may be as long as it likes; its rows are one sequence and stay in one task, as a
recurrence demands. All recurrences of a call share the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    dealt = df.repartition(*key) if key else df.coalesce(1)
    return dealt.sortWithinPartitions(*key, *order)


def stretches(batch: pa.RecordBatch, width: int) -> list[tuple[tuple, int, int]]:
    """(key, from, to) of runs of one key; keys are the first ``width`` columns."""
    n = batch.num_rows
    if not n:
        return []
    cut = np.zeros(n, bool)
    cut[0] = True
    for k in range(width):
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cut[1:] |= codes[1:] != codes[:-1]
    begins = np.flatnonzero(cut)
    return [(tuple(batch.column(k)[int(a)].as_py() for k in range(width)), int(a), int(b)) for a, b in zip(begins, np.append(begins[1:], n), strict=True)]


def doubles(column: pa.Array) -> np.ndarray:
    """Doubles with NaN for null."""
    return column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(float)


def recur(df: DataFrame, made: dict[str, tuple[Callable, Sequence[str]]], key: Sequence[str], order: Sequence[str], ts: str | None = None) -> DataFrame:
    """Add a column per recurrence: name -> (function that makes a kernel, input columns).

    ``ts`` is a timestamp column for kernels that look at time, in milliseconds.
    """
    names, width = list(made), len(key)
    inputs = list(dict.fromkeys(c for _, columns in made.values() for c in columns))
    helper = [F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]
    helper.append((F.unix_micros(ts) / 1000.0 if ts else F.lit(0.0)).alias("__now"))
    helper += [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(inputs)]
    kept = [F.col(c) for c in df.columns if c not in names]
    rows = sorted_by_key(df, key, order).select(*helper, *kept)
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in names), *(T.StructField(n, T.DoubleType()) for n in names)])
    at = {n: [width + 1 + inputs.index(c) for c in columns] for n, (_, columns) in made.items()}
    factories = {n: f for n, (f, _) in made.items()}
    skip = width + 1 + len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, {}
        for batch in batches:
            out = {n: np.empty(batch.num_rows) for n in names}
            now = doubles(batch.column(width))
            columns = {i: doubles(batch.column(i)) for i in range(width + 1, skip)}
            for k, a, b in stretches(batch, width):
                if current is None or k != current:
                    current, state = k, {n: factories[n]() for n in names}
                for n in names:
                    out[n][a:b] = state[n].run([columns[i][a:b] for i in at[n]], now[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[skip:], *(pa.array(out[n]) for n in names)], names=[*batch.schema.names[skip:], *names])

    return rows.mapInArrow(run, schema)
