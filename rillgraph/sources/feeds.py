"""Synthetic feeds on executors: deterministic by seed and row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the row alone, so lost tasks give it again."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fx_ticks(spark: SparkSession, n: int, seed: int = 42, fault_every: int = 500, fault_length: int = 100) -> DataFrame:
    """Ticks of a currency triangle; a leg is NaN for a stretch of every period."""
    i = F.col("id")
    noise = lambda k, scale: (uniform(seed + k, i) - 0.5) * scale
    drift = F.sin(i / 997.0) * 0.01
    faulty = (i >= fault_every) & (F.pmod(i, F.lit(fault_every)) < fault_length)
    eurusd, usdjpy = 1.08 + drift + noise(0, 1e-3), 150.0 - drift * 100 + noise(1, 1e-1)
    return spark.range(n).select(
        F.timestamp_millis(i * 100).alias("ts"), i.alias("seq"),
        F.when(faulty, float("nan")).otherwise(eurusd).alias("EURUSD"), usdjpy.alias("USDJPY"), (eurusd * usdjpy + noise(2, 5e-2)).alias("EURJPY"),
    )


def stress_items(spark: SparkSession, n: int, items: int = 100, seed: int = 42) -> DataFrame:
    """Updates of one of three sources of an item each."""
    i = F.col("id")
    which, value = F.floor(uniform(seed + 1, i) * 3), 50 + uniform(seed + 2, i) * 100
    return spark.range(n).select(
        F.timestamp_millis(i).alias("ts"), i.alias("seq"), F.format_string("Item_%03d", F.floor(uniform(seed, i) * items).cast("int")).alias("item"),
        *[F.when(which == k, value).alias(f"source{k + 1}") for k in range(3)],
    )


def curve_shocks(spark: SparkSession, n: int, size: int = 5, seed: int = 42) -> DataFrame:
    """Updates of one to three elements of a curve: (ts, seq, index, value)."""
    i = F.col("id")
    hits = F.sequence(F.lit(1), (F.floor(uniform(seed, i) * 3) + 1).cast("int"))
    return spark.range(n).select(F.timestamp_millis(i * 100).alias("ts"), i.alias("seq"), F.explode(hits).alias("k")).select(
        "ts", "seq", F.floor(uniform(seed + 1, F.col("seq"), F.col("k")) * size).cast("int").alias("index"), (4.0 + uniform(seed + 2, F.col("seq"), F.col("k"))).alias("value")
    )


def bond_bursts(spark: SparkSession, n: int, tenors: tuple[str, ...] = ("2Y", "3Y", "5Y", "10Y", "30Y"), venues: tuple[str, ...] = ("Btec", "Fenics", "Dweb"), seed: int = 42) -> DataFrame:
    """Bursts of one to five quotes at one instant: (ts, seq, tenor, venue, field, value); fields are bid and ask and their sizes."""
    i = F.col("id")
    names = lambda given, u: F.element_at(F.array(*map(F.lit, given)), (F.floor(u * len(given)) + 1).cast("int"))
    burst = spark.range(n).select(F.timestamp_millis(i * 100).alias("ts"), i.alias("burst"), F.explode(F.sequence(F.lit(1), (F.floor(uniform(seed, i) * 5) + 1).cast("int"))).alias("k"))
    u = lambda s: uniform(seed + s, F.col("burst"), F.col("k"))
    rows = burst.select("ts", (F.col("burst") * 5 + F.col("k") - 1).alias("seq"), names(tenors, u(1)).alias("tenor"), names(venues, u(2)).alias("venue"), names(("bid", "bidQty", "ask", "askQty"), u(3)).alias("field"), u(4).alias("u"))
    price = F.when(F.col("field") == "bid", 99.0 + F.col("u")).when(F.col("field") == "ask", 100.0 + F.col("u")).otherwise(F.floor(F.col("u") * 50) * 1e6 + 1e6)
    return rows.withColumn("value", price).drop("u")


def regime_switch(spark: SparkSession, n: int, every: int = 200, calm: float = 0.2, wild: float = 3.0, seed: int = 42) -> DataFrame:
    """Prices whose noise turns from calm to wild and back every so many rows, with the volatility that says so."""
    i = F.col("id")
    rough = F.pmod(F.floor(i / every), F.lit(2)) == 1
    vol = F.when(rough, wild).otherwise(calm)
    return spark.range(n).select(F.timestamp_millis(i * 100).alias("ts"), i.alias("seq"), (100.0 + F.sin(i / 53.0) + (uniform(seed, i) - 0.5) * vol).alias("price"), vol.alias("volatility"))


def decay_shocks(spark: SparkSession, n: int, every: int = 50, shock: float = 10.0, seed: int = 42) -> DataFrame:
    """A flat signal with a shock every so many rows, at uneven times, for decays to run down from."""
    i = F.col("id")
    jitter = F.floor(uniform(seed, i) * 400).cast("long")
    return spark.range(n).select(F.timestamp_millis(i * 500 + jitter).alias("ts"), i.alias("seq"), F.when((i > 0) & (F.pmod(i, F.lit(every)) == 0), shock).otherwise(0.0).alias("signal"))


def rate_stream(spark: SparkSession, rows_per_second: int = 100, keys: int = 10, seed: int = 42) -> DataFrame:
    """A live feed of keyed values."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rows.select(F.col("timestamp").alias("ts"), F.col("value").alias("seq"), F.pmod("value", F.lit(keys)).alias("key"), (uniform(seed, F.col("value")) * 100).alias("x"))
