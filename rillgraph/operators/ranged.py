"""Bounded row windows for keys that no single task should hold.

A plain window deals rows by key, so a key with a third of all rows is one task. Here
rows are dealt by ranges of (key, order), each range is a window of its own, and the rows that a
range's first windows look back on are carried over from the ranges before. A window of
``size`` evaluations needs ``size - 1`` of them, so what is carried is small:
ranges times ``size``. The result equals the plain window.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import number
from .rolling import Rolling


def ranged_rolling(df: DataFrame, inputs: Sequence[str], key: Sequence[str], order: Sequence[str], size: int, made: dict[str, Callable[[Rolling], Column]], partitions: int | None = None) -> DataFrame:
    """Add columns name -> function of a ``Rolling``, none looking back over more than ``size`` evaluations.

    ``order`` must be unique within a key. The ranged rows are checkpointed, so
    that ranges stay as they are (spark.checkpoint.dir).
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():  # a cluster names a shared folder; without one, this is a local session
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rillgraph-"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ok = ~F.isnan(number(F.col(inputs[0])))
    for c in inputs[1:]:
        ok = ok & ~F.isnan(number(F.col(c)))
    ranged = df.withColumn("fit__", ok).repartitionByRange(n, *key, *order).withColumn("range__", F.spark_partition_id()).checkpoint()

    same = [*key, "range__"]
    counts = ranged.where("fit__").groupBy(*same).agg(F.count(F.lit(1)).alias("n__"))
    before = Window.partitionBy(*key).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start__", F.coalesce(F.sum("n__").over(before), F.lit(0)))
    # the last evaluations of each range, numbered within the key
    tails = (
        ranged.where("fit__")
        .withColumn("back__", F.row_number().over(Window.partitionBy(*same).orderBy(*[F.col(c).desc() for c in order])))
        .where(F.col("back__") < size)
        .join(starts, same)
        .withColumn("at__", F.col("start__") + F.col("n__") - F.col("back__"))
        .drop("start__", "n__", "back__", "range__")
    )
    later = starts.where("start__ > 0").drop("n__")
    carried = tails.join(later, list(key)).where((F.col("at__") < F.col("start__")) & (F.col("at__") >= F.col("start__") - (size - 1))).drop("at__", "start__")
    rows = ranged.withColumn("carried__", F.lit(False)).unionByName(carried.withColumn("carried__", F.lit(True)))
    rolling = Rolling(inputs, same, order)
    return rows.withColumns({name: f(rolling) for name, f in made.items()}).where("NOT carried__").drop("carried__", "fit__", "range__")
