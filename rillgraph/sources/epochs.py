"""Epoch tables: one row per key and epoch, one column per source.

``ts`` orders epochs, ``seq`` breaks ties. A null in a source column means that
the epoch brought no update; NaN is a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(key: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*key).orderBy(*order)


def latest(df: DataFrame, columns: Sequence[str], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest-value semantics: each column keeps its last update (an as-of join of all inputs)."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def route(events: DataFrame, key_columns: Sequence[str], value_columns: Sequence[str], order: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """Wide events to long updates: order columns, node, value.

    The node's path is the keys and the value's name, joined by dots. All values are routed, NaN too.
    """
    names = names or {}
    path = lambda c: F.concat_ws(".", *[F.col(k).cast("string") for k in key_columns], F.lit(names.get(c, c)))
    pairs = F.array(*[F.struct(path(c).alias("node"), F.col(c).cast("double").alias("value")) for c in value_columns])
    return events.select(*order, F.explode(pairs).alias("u")).select(*order, "u.node", "u.value")


def pivot_updates(updates: DataFrame, sources: Sequence[str], key: Sequence[str], order: Sequence[str], node: str = "node", value: str = "value") -> DataFrame:
    """Long updates to an epoch table; each update is an epoch, no shuffle."""
    return updates.select(*key, *order, *[F.when(F.col(node) == s, F.col(value).cast("double")).alias(s) for s in sources])


def coalesced(epochs: DataFrame, sources: Sequence[str], key: Sequence[str], bucket: Column, order: Sequence[str]) -> DataFrame:
    """A burst becomes one epoch: the last update of each source in a bucket, with ``updates`` counted."""
    place = F.struct(*order)
    last = [F.max_by(F.col(s), F.when(F.col(s).isNotNull(), place)).alias(s) for s in sources]
    counted = [F.count(F.col(s)) for s in sources]
    total = counted[0]
    for c in counted[1:]:
        total = total + c
    return epochs.groupBy(*key, bucket.alias("bucket")).agg(*[F.max(o).alias(o) for o in order], *last, total.alias("updates"))


def element_updates(updates: DataFrame, size: int, key: Sequence[str], epoch: str, order: Sequence[str], index: str = "index", value: str = "value") -> DataFrame:
    """Updates of single vector elements to one vector per epoch; elements not updated are null."""
    place = F.struct(*order)
    columns = [F.max_by(F.when(F.col(index) == i, F.col(value)), F.when(F.col(index) == i, place)).alias(f"__{i}") for i in range(size)]
    return updates.groupBy(*key, epoch).agg(*columns).select(*key, epoch, F.array(*[F.col(f"__{i}") for i in range(size)]).alias("vector"))


def ticks(bounds: DataFrame, interval_ms: int, key: Sequence[str] = (), start: str = "first", stop: str = "last") -> DataFrame:
    """Timer ticks between two times: (key, ts, tick), ticks counted from 1 at ``start``.

    ``bounds`` has a row per key; ticks are generated where that row is.
    """
    us = F.lit(interval_ms * 1000)
    n = F.floor((F.unix_micros(stop) - F.unix_micros(start)) / us)
    return bounds.select(*key, start, F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("__n")).select(
        *key, F.timestamp_micros(F.unix_micros(start) + F.col("__n") * us).alias("ts"), (F.col("__n") + 1).alias("tick")
    )


def with_ticks(epochs: DataFrame, tick_rows: DataFrame, name: str) -> DataFrame:
    """Timer ticks among the epochs, as one queue; column ``name`` is true on ticks."""
    return epochs.withColumn(name, F.lit(False)).unionByName(tick_rows.withColumn(name, F.lit(True)), allowMissingColumns=True)
