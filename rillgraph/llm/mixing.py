"""Mixing sources to target weights (operator 7).

Each source's documents stand in a shuffled order and form one stream of words,
cut into blocks of ``block_words`` words. The mix is a schedule of slots, one
block each. Slot i maps the golden-ratio point frac((i + 1/2) * phi) through the
sources' cumulative shares of slots; the r-th slot of a source takes its r-th
block, starting over when the stream ends. Low discrepancy keeps every stretch
of the schedule near the target mix. Where a source got a slot too many or too
few, its last slots are dropped or added at the end, and its last slot is cut,
so that a source's words meet its target to the word.

Targets: the mix is ``share`` times all words; sources weigh by a repeating
list in code point order (null last); none may exceed ``most`` times its size,
and what it cannot take goes to the others by weight (water filling).

Defined results. A null text has no words; a document without words takes none.
A null source is a source of its own. Documents that agree in source, id and
size are interchangeable. An empty table gives an empty result.

Scale: no driver loop and nothing collected. A source's stream is numbered by
running sums inside hash buckets plus offsets from bucket totals, so a source
with a third of all rows is spread like any other; slots are numbered per chunk
of the schedule in the same way. Broadcast: a row per source and grid cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, written

PHI = 0.6180339887498949
#: Slots numbered in one window, and cells that the unit interval is looked up by.
CHUNK, CELLS = 1 << 12, 1024
#: Rows, about, in one hash bucket of a source's shuffled stream.
BUCKET_ROWS = 2048


def word_count(column):
    return F.coalesce(F.regexp_count(column, F.lit(r"[^ \t-\r]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight and target (double) from sources' sizes.

    ``sizes`` has a row per source; the sort is over those alone.
    """
    every = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumns({"weight": F.element_at(listed, (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")), "cap": F.col("source_size") * F.lit(most)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    upto, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    # Were this source the first that isn't capped, each unit of weight would get `level`.
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("level", level)
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("level")))).over(every)
    return levelled.withColumn("open", open_level).select(
        "source", "source_size", "weight", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("open.level") * F.col("weight"))).alias("target")
    )


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """Slots of the mix: slot, source, block (of the source's stream), words.

    Slots dropped for discrepancy leave gaps; added ones follow the last.
    """
    spark = targets.sparkSession
    size, take = F.col("source_size"), F.round("target").cast("long")
    n_blocks = F.ceil(size / F.lit(float(block_words)))
    rest = take - F.floor(take / size).cast("long") * size
    needs = targets.where(F.col("source_size") > 0).select(
        "source",
        "source_size",
        take.alias("take"),
        n_blocks.cast("long").alias("n_blocks"),
        (F.floor(take / size) * n_blocks + F.ceil(rest / F.lit(float(block_words)))).cast("long").alias("need"),
    )
    every, before = Window.partitionBy(F.lit(1)), Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    shares = written(
        needs.withColumns({"upto": F.sum("need").over(before), "slots": F.sum("need").over(every)}).withColumns(
            {"low": F.try_divide(F.col("upto") - F.col("need"), F.col("slots")), "high": F.try_divide("upto", "slots")}
        )
    )
    found = shares.agg(F.max("slots")).first()[0] or 0
    cells = shares.where("need > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("high") * CELLS).cast("int")))))
    i = F.col("slot")
    # in two parts, so that large slot numbers keep their fractions
    point = F.pmod(F.floor(i / (1 << 20)) * F.lit((PHI * (1 << 20)) % 1.0) + F.pmod(i, F.lit(1 << 20)) * F.lit(PHI) + F.lit(PHI / 2), F.lit(1.0))
    slots = (
        spark.range(found)
        .withColumnRenamed("id", "slot")
        .withColumn("u", point)
        .withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
        .join(F.broadcast(cells), "cell")
        .where("u >= low AND u < high")
        .withColumn("chunk", F.floor(F.col("slot") / CHUNK))
        .select("slot", "chunk", "source", "source_size", "take", "n_blocks", "need")
    )
    counts = slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumnRenamed("source", "s").withColumnRenamed("chunk", "c").drop("n")
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = (
        slots.withColumn("nth", F.row_number().over(inside))
        .join(offsets, F.col("s").eqNullSafe(F.col("source")) & (F.col("c") == F.col("chunk")))
        .withColumn("rank", F.col("offset") + F.col("nth") - 1)
        .where("rank < need")
    )
    got = counts.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("got"))
    added = (
        shares.join(got, F.col("s").eqNullSafe(F.col("source")), "left")
        .where(F.coalesce(F.col("got"), F.lit(0)) < F.col("need"))
        .withColumn("rank", F.explode(F.sequence(F.coalesce(F.col("got"), F.lit(0)), F.col("need") - 1)))
        .withColumn("slot", F.lit(found) + F.col("rank") * F.lit(4096) + F.pmod(F.xxhash64("source"), F.lit(4096)))
    )
    columns = ["slot", "source", "source_size", "take", "n_blocks", "rank"]
    block, turn = F.pmod(F.col("rank"), F.col("n_blocks")), F.floor(F.col("rank") / F.col("n_blocks"))
    start = turn * F.col("source_size") + block * block_words
    full = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    return ranked.select(*columns).union(added.select(*columns)).select("slot", "source", block.alias("block"), F.least(full, F.col("take") - start).cast("long").alias("words"), full.cast("long").alias("block_size"))


def mix(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 256, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id_col, size, source, source_size, target, taken."""
    rows = written(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("place", F.xxhash64(F.lit(seed), "id", "source"))
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights=weights, share=share, most=most))

    # The shuffled stream of each source: where a document's words begin.
    bits = max(1, (rows.count() // BUCKET_ROWS).bit_length())
    dealt = rows.withColumn("bucket", F.shiftrightunsigned("place", 64 - bits))
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    stream = (
        dealt.withColumn("upto", F.sum("size").over(inside))
        .join(offsets, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("bucket")))
        .select("id", "source", "size", (F.col("offset") + F.col("upto") - F.col("size")).alias("begin"))
    )
    takes = schedule(targets, block_words).groupBy(F.col("source").alias("s"), "block").agg(
        F.sum(F.when(F.col("words") == F.col("block_size"), 1).otherwise(0)).alias("whole"), F.sum(F.when(F.col("words") < F.col("block_size"), F.col("words")).otherwise(0)).alias("cut")
    )
    pieces = stream.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("begin") / block_words).cast("long"), F.floor((F.col("begin") + F.col("size") - 1) / block_words).cast("long")))
    )
    base = pieces["block"] * block_words
    low, high = F.greatest(F.col("begin"), base) - base, F.least(F.col("begin") + F.col("size"), base + block_words) - base
    whole, cut = F.coalesce(F.col("whole"), F.lit(0)), F.coalesce(F.col("cut"), F.lit(0))  # none for blocks that the mix leaves out
    taken = (
        pieces.join(takes, F.col("s").eqNullSafe(F.col("source")) & (pieces["block"] == takes["block"]), "left")
        .select("id", "source", "size", "begin", (whole * (high - low) + F.greatest(F.lit(0), F.least(high, cut) - low)).alias("words"))
        .groupBy("id", "source", "size", "begin")
        .agg(F.sum("words").alias("taken"))
    )
    full = taken.select("id", "source", "size", "taken").union(stream.where("size = 0").select("id", "source", "size", F.lit(0).cast("long")))
    info = targets.select(F.col("source").alias("s"), "source_size", "target")
    return full.join(info, F.col("s").eqNullSafe(F.col("source"))).select(F.col("id").alias(id_col), "source", F.col("size"), "source_size", "target", "taken")


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it, rounded.

    A document without words stays once. Rows that agree in id, source and size
    share their takes evenly.
    """
    takes = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    times = written(
        takes.groupBy(F.col(id_col).alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__n"))
        .agg((F.sum("taken") / F.count(F.lit(1))).alias("__taken"))
        .select("__i", "__s", "__n", F.when(F.col("__n") == 0, 1).otherwise(F.floor(F.try_divide("__taken", "__n") + 0.5)).cast("int").alias("__times"))
        .where("__times <> 1")
    )
    changed = times.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    key = F.col("__i").eqNullSafe(F.col(id_col)) & F.col("__s").eqNullSafe(F.col(source_col)) & (F.col("__n") == word_count(F.col(text_col)))
    joined = docs.join(F.broadcast(times) if changed else times, key, "left").withColumn("__times", F.coalesce("__times", F.lit(1)))
    return joined.where("__times > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
