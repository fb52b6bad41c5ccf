"""Change detection, gates, feeds and snapshots as DataFrame operations."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import number
from ..functions.cutoffs import changed_column


def evaluated_prev(value: Column, evaluated: Column, key: Sequence[str], order: Sequence[str]) -> Column:
    """The value at the last earlier evaluation; null before the first."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(evaluated, value), ignorenulls=True).over(w)


def source_changes(df: DataFrame, column: str, key: Sequence[str], order: Sequence[str], cutoff: str = "exact", tolerance: float | None = None, out: str = "changed") -> DataFrame:
    """Which updates of a source count as changes. Null rows bring no update; after NaN every update counts."""
    x = F.col(column)
    prev = evaluated_prev(x, x.isNotNull(), key, order)
    first = prev.isNull() | F.isnan(prev)
    both = ~F.isnan(x)
    plain = changed_column(cutoff, prev, x, tolerance) if cutoff != "never" else F.lit(False)
    return df.withColumn(out, x.isNotNull() & (first | F.when(both | F.lit(cutoff != "never"), plain).otherwise(F.lit(False))))


def calc_changes(df: DataFrame, column: str, evaluated: str, key: Sequence[str], order: Sequence[str], cutoff: str = "exact", tolerance: float | None = None, out: str = "changed") -> DataFrame:
    """Which evaluations of a computed node propagate; against the previous evaluation, not the last change."""
    x = number(F.col(column))
    return df.withColumn(out, F.col(evaluated) & changed_column(cutoff, evaluated_prev(x, F.col(evaluated), key, order), x, tolerance))


def flips(df: DataFrame, column: str, key: Sequence[str], order: Sequence[str], out: str = "flip") -> DataFrame:
    """A boolean node's changes: its first row, then each flip."""
    before = F.lag(column).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn(out, before.isNull() | (before != F.col(column)))


def gated(df: DataFrame, active: Column, value: Column, key: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """A branch behind a switch: computed while active, else its last value; NaN before."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(F.when(active, value), ignorenulls=True).over(w), F.lit(float("nan"))))


def change_feed(df: DataFrame, nodes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., node, topo_index, value) of changed scalar nodes, from an engine plan's ``updated``."""
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    items = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(i).alias("topo_index"), quoted(n).cast("double").alias("value")) for i, n in enumerate(nodes)])
    return df.select(*keep, F.explode(F.filter(items, lambda x: F.array_contains("updated", x["topo_index"]))).alias("c")).select(*keep, "c.*")


def snapshot(df: DataFrame, nodes: Sequence[str], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key and its values as JSON, NaN as null."""
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    last = df.groupBy(*key).agg(F.max_by(F.struct(*[quoted(n).alias(n) for n in nodes]), F.struct(*order)).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def clean(n: str) -> Column:
        v = F.col("v").getField(n)
        return F.when(~F.isnan(v), v).alias(n) if kinds[n] == "double" else F.transform(v, lambda x: F.when(~F.isnan(x), x)).alias(n) if kinds[n].startswith("array") else v.alias(n)

    return last.select(*key, F.to_json(F.struct(*[clean(n) for n in nodes]), {"ignoreNullFields": "false"}).alias("snapshot"))


def graph_snapshot(df: DataFrame, graph, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key as a document of the whole graph: nodes with type, inputs by edge label, headers and value.

    Values are those of the nodes that ``df`` has a column for; NaN and all that isn't finite is null.
    """
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    have = [n for n in graph.topology.order if n in kinds]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*[quoted(n).alias(n) for n in have], *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)]), F.struct(*order)).alias("v"))
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    def text(n: str) -> Column:
        v = F.col("v").getField(n)
        clean = finite(v) if kinds[n] == "double" else F.transform(v, finite) if kinds[n].startswith("array") else v
        return F.coalesce(F.get_json_object(F.to_json(F.struct(clean.alias("x"))), "$.x"), F.lit("null"))

    labels: dict[str, dict[str, str]] = {}
    for (parent, child), names in graph.edge_labels.items():
        for label in names:
            labels.setdefault(child, {})[label] = parent
    parts = []
    for n in graph.topology.order:
        spec = graph.node(n)
        fixed = {"name": n, "type": spec.type, "inputs": labels.get(n, {})}
        if spec.properties.get("headers"):
            fixed["headers"] = list(spec.properties["headers"])
        head = json.dumps(fixed)[:-1]
        parts.append(F.concat(F.lit(head + ', "value": '), text(n), F.lit("}")) if n in have else F.lit(head + "}"))
    head = json.dumps({"name": graph.name, "version": graph.version})[:-1] + ', "nodes": ['
    return last.select(*key, F.concat(F.lit(head), F.concat_ws(", ", *parts), F.lit("]}")).alias("snapshot"))


def replay(df: DataFrame, key: Sequence[str], order: Sequence[str], upto: Column) -> DataFrame:
    """The state as it was: each key's last row among those for which ``upto`` holds (an epoch or a time at most)."""
    w = Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order])
    return df.where(upto).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def tick_json(df: DataFrame, nodes: Sequence[str], epoch: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    """A message per row, as a live page reads it: scalars that aren't finite are named, vectors' are null.

    ``metrics`` adds numbers by name, such as evaluations or latencies.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def text(n: str) -> Column:
        c = F.col("`" + n.replace("`", "``") + "`")
        if kinds[n].startswith("array"):
            return F.to_json(F.transform(c, lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)), {"ignoreNullFields": "false"})
        if kinds[n] == "boolean":
            return F.when(c, F.lit("1.0")).otherwise(F.lit("0.0"))
        named = F.when(F.isnan(c), F.lit('"NaN"')).when(c == float("inf"), F.lit('"Infinity"')).when(c == float("-inf"), F.lit('"-Infinity"'))
        return F.coalesce(named, c.cast("string"))

    parts = [F.concat(F.lit(f'"{n}":'), text(n)) for n in nodes]
    numbers = [F.concat(F.lit(f'"{m}":'), F.coalesce(c.cast("string"), F.lit("null"))) for m, c in (metrics or {}).items()]
    measured = [F.lit(',"metrics":{'), F.concat_ws(",", *numbers), F.lit("}")] if numbers else []
    return df.withColumn("message", F.concat(F.lit('{"type":"tick","epoch":'), F.col(epoch).cast("string"), F.lit(',"values":{'), F.concat_ws(",", *parts), F.lit("}"), *measured, F.lit("}")))


def alerts(df: DataFrame, column: str, operator: str, threshold: float, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key that meets the test; an alert fires once, NaN never."""
    x = F.col(column)
    test = ~F.isnan(x) & {"<": x < threshold, ">": x > threshold, "=": x == threshold}[operator]
    return df.where(test).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
