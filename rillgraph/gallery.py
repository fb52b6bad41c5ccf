"""Queries over the sample tables, and the SQL that each must equal.

Events are keyed by user and ordered by (ts, event_id); three event types stand
for the three sources of a graph. Doubles are rounded to six places, NaN is shown as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import columns as C
from .functions import kernels as K
from .functions.cutoffs import vector_changed_column
from .operators import changes, telemetry
from .operators.ranged import ranged_rolling
from .operators.rolling import Rolling, log_ratio, twap
from .operators.scans import recur
from .plans.builder import GraphBuilder
from .plans.compiler import compile_graph, quoted
from .plans.explain import lineage
from .plans.spec import load_graph, template_spec
from .sources import epochs as E

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

KEY, ORDER = ["user_id"], ["ts", "event_id"]
LEGS = {"leg1": "view", "leg2": "click", "direct": "purchase"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def rounded(c: Column, places: int) -> Column:
    """Rounded as the SQL here rounds doubles: the scaled number, halves away from zero. Spark's own goes by the decimal text, and halves differ."""
    power = F.lit(10.0**places)
    made = F.round(c * power) / power
    return F.when(F.abs(made) == float("inf"), c).otherwise(made)


def six(c: Column) -> Column:
    """Rounded, NaN as null."""
    return F.round(F.when(~F.isnan(c), c), 6)


def legs(spark: SparkSession, d: str, filled: bool = True) -> DataFrame:
    e = events(spark, d).select(*KEY, *ORDER, *[F.when(F.col("event_type") == t, F.col("value")).alias(n) for n, t in LEGS.items()])
    return E.latest(e, list(LEGS), KEY, ORDER) if filled else e


# SQL: events in order, and the three sources filled forward.
_W = "(PARTITION BY user_id ORDER BY ts, event_id"
_LEGS = "l AS (SELECT user_id, event_id, ts, " + ", ".join(f"last_value(CASE WHEN event_type = '{t}' THEN value END IGNORE NULLS) OVER {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}" for n, t in LEGS.items()) + " FROM events)"
_SEQ = f"e AS (SELECT user_id, event_id, ts, value, epoch_us(ts) / 1000.0 AS ms, row_number() OVER {_W}) AS rn FROM events)"


def _frame(n: int) -> str:
    return f"OVER {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rolling(name: str, size: int, expression: str):
    # eight places: quotients of cents have ties at fewer
    sql = f"SELECT event_id, round({expression}, 8) AS {name} FROM events"

    def run(spark, d):
        return events(spark, d).select("event_id", F.round(getattr(Rolling(["value"], KEY, ORDER), name)(size), 8).alias(name))

    run.__name__ = name
    query(sql)(run)


_rolling("sma", 10, f"avg(value) {_frame(10)}")
_rolling("rolling_sum", 10, f"sum(value) {_frame(10)}")
_rolling("rolling_min", 10, f"min(value) {_frame(10)}")
_rolling("rolling_max", 10, f"max(value) {_frame(10)}")
_rolling("rolling_variance", 10, f"coalesce(var_samp(value) {_frame(10)}, 0)")
_rolling("hist_vol", 10, f"stddev_pop(value) {_frame(10)}")
_rolling("z_score", 20, f"CASE WHEN var_pop(value) {_frame(20)} <= 1e-9 THEN 0 ELSE (value - avg(value) {_frame(20)}) / sqrt(var_pop(value) {_frame(20)}) END")



@query(f"SELECT event_id, round(avg(value) {_frame(10)}, 8) AS sma FROM events")
def sma_ranged(spark, d):
    """The same moving average, by ranges instead of keys."""
    return ranged_rolling(events(spark, d), ["value"], KEY, ORDER, 10, {"sma": lambda w: F.round(w.sma(10), 8)}).select("event_id", "sma")


_L_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_L_KEYS = "l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate"
_LW = f"OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_L_ORDER)} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def lineitem(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"), "l_extendedprice", "l_quantity", *more)


@query(f"SELECT {_L_KEYS}, round(CASE WHEN count(*) {_LW} < 2 OR var_pop(l_quantity) {_LW} <= 1e-9 THEN 0 ELSE covar_pop(l_extendedprice, l_quantity) {_LW} / var_pop(l_quantity) {_LW} END, 4) AS beta FROM lineitem")
def beta(spark, d):
    r = Rolling(["l_extendedprice", "l_quantity"], ["l_suppkey"], _L_ORDER)
    return lineitem(spark, d).select(*_L_KEYS.split(", "), F.round(r.beta(20), 4).alias("beta"))


@query(f"SELECT {_L_KEYS}, round(CASE WHEN count(*) {_LW} < 2 OR var_pop(l_extendedprice) {_LW} <= 1e-15 OR var_pop(l_quantity) {_LW} <= 1e-15 THEN 0 ELSE corr(l_extendedprice, l_quantity) {_LW} END, 6) AS correlation FROM lineitem")
def correlation(spark, d):
    r = Rolling(["l_extendedprice", "l_quantity"], ["l_suppkey"], _L_ORDER)
    return lineitem(spark, d).select(*_L_KEYS.split(", "), F.round(r.correlation(20), 6).alias("correlation"))


@query(f"SELECT event_id, round(coalesce(value - lag(value) OVER {_W}), 0), 6) AS diff FROM events")
def diff(spark, d):
    return events(spark, d).select("event_id", six(Rolling(["value"], KEY, ORDER).diff()).alias("diff"))


@query(f"SELECT event_id, round(coalesce(ln(value / lag(value) OVER {_W})), 0), 6) AS log_return FROM events")
def log_return_query(spark, d):
    """NaN, as of 0 / 0, stays NaN here: null never comes out of this SQL."""
    return events(spark, d).select("event_id", F.round(log_ratio("value", KEY, ORDER), 6).alias("log_return"))


QUERIES["log_return"], ORACLES["log_return"] = QUERIES.pop("log_return_query"), ORACLES.pop("log_return_query")


def _fold(name: str, make, sql_first: str, sql_next: str, sql_out: str, timed: bool = False):
    """A recurrence; the SQL steps through each key's rows with a struct of state."""
    sql = (
        f"WITH RECURSIVE {_SEQ}, r AS (SELECT user_id, event_id, rn, value, ms, {sql_first} AS s FROM e WHERE rn = 1 "
        f"UNION ALL SELECT e.user_id, e.event_id, e.rn, e.value, e.ms, {sql_next} FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT event_id, round({sql_out}, 6) AS {name} FROM r"
    )

    def run(spark, d):
        return recur(events(spark, d), {name: (make, ["value"])}, KEY, ORDER, ts="ts" if timed else None).select("event_id", six(F.col(name)).alias(name))

    run.__name__ = name
    query(sql)(run)


_fold("ewma", lambda: K.Ewma(0.1), "{'s': value}", "{'s': 0.1 * e.value + 0.9 * r.s.s}", "s.s")
_fold("macd", lambda: K.Macd(12, 26), "{'f': value, 'w': value}", "{'f': 2.0 / 13 * e.value + 11.0 / 13 * r.s.f, 'w': 2.0 / 27 * e.value + 25.0 / 27 * r.s.w}", "s.f - s.w")
_fold(
    "rsi", lambda: K.Rsi(14), "{'g': CAST(0 AS DOUBLE), 'l': CAST(0 AS DOUBLE), 'n': 0}",
    "{'g': greatest(e.value - r.value, 0) / 14.0 + r.s.g * 13.0 / 14, 'l': greatest(r.value - e.value, 0) / 14.0 + r.s.l * 13.0 / 14, 'n': 1}",
    "CASE WHEN s.n = 0 THEN 50 WHEN s.l = 0 THEN CASE WHEN s.g = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + s.g / s.l) END",
)
_fold(
    "time_decay", lambda: K.TimeDecay(12 * 3_600_000), "{'s': value, 't': ms}",
    "CASE WHEN e.ms > r.s.t THEN {'s': e.value * (1 - exp(-ln(2) * (e.ms - r.s.t) / 43200000)) + r.s.s * exp(-ln(2) * (e.ms - r.s.t) / 43200000), 't': e.ms} ELSE r.s END", "s.s", timed=True,
)
_fold("throttle", lambda: K.Throttle(6 * 3_600_000), "{'s': value, 't': ms}", "CASE WHEN e.ms - r.s.t >= 21600000 THEN {'s': e.value, 't': e.ms} ELSE r.s END", "s.s", timed=True)


@query(
    f"WITH {_SEQ}, d AS (SELECT *, value AS v, lag(value) OVER {_W}) * (ms - lag(ms) OVER {_W})) AS a, ms - lag(ms) OVER {_W}) AS b FROM e) "
    f"SELECT event_id, round(coalesce(sum(a) OVER {_W}) / nullif(sum(b) OVER {_W}), 0), v), 6) AS twap FROM d"
)
def twap_query(spark, d):
    return twap(events(spark, d), "value", KEY, "ts", ORDER, "twap").select("event_id", six(F.col("twap")).alias("twap"))


QUERIES["twap"], ORACLES["twap"] = QUERIES.pop("twap_query"), ORACLES.pop("twap_query")

_BOUNDS = "b AS (SELECT user_id, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id), t AS (SELECT user_id, unnest(generate_series(0, CAST(floor((epoch_us(last) - epoch_us(first)) / 86400000000.0) AS BIGINT))) AS n, first FROM b)"
_TICK = "make_timestamp(epoch_us(first) + n * 86400000000)"


def _ticks(spark, d) -> DataFrame:
    bounds = events(spark, d).groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return E.ticks(bounds, 86_400_000, KEY)


@query(f"WITH {_BOUNDS} SELECT user_id, {_TICK} AS ts, CAST(n + 1 AS BIGINT) AS tick FROM t")
def timer_ticks(spark, d):
    return _ticks(spark, d)


def _timed_queue(spark, d) -> DataFrame:
    """Events and daily ticks in one queue; a tick sees the latest value. Ticks follow events of the same time."""
    e = events(spark, d).select(*KEY, "ts", F.col("event_id").alias("seq"), "value")
    t = _ticks(spark, d).select(*KEY, "ts", (F.col("tick") + (1 << 40)).alias("seq"), F.lit(None).cast("double").alias("value"))
    return E.latest(e.union(t), ["value"], KEY, ["ts", "seq"])


_QUEUE = (
    f"{_BOUNDS}, q0 AS (SELECT user_id, ts, event_id AS seq, value FROM events UNION ALL SELECT user_id, {_TICK}, n + 1 + 1099511627776, NULL FROM t), "
    "q AS (SELECT user_id, ts, seq, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, "
    "epoch_us(ts) / 1000.0 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS rn FROM q0)"
)


@query(
    f"WITH RECURSIVE {_QUEUE}, r AS (SELECT user_id, seq, rn, value, ms, {{'s': value, 't': ms}} AS s FROM q WHERE rn = 1 UNION ALL SELECT q.user_id, q.seq, q.rn, q.value, q.ms, "
    "CASE WHEN q.ms > r.s.t THEN {'s': q.value * (1 - exp(-ln(2) * (q.ms - r.s.t) / 43200000)) + r.s.s * exp(-ln(2) * (q.ms - r.s.t) / 43200000), 't': q.ms} ELSE r.s END "
    "FROM r JOIN q ON q.user_id = r.user_id AND q.rn = r.rn + 1) SELECT user_id, seq, round(s.s, 6) AS timer_ewma FROM r"
)
def timer_ewma(spark, d):
    made = recur(_timed_queue(spark, d), {"timer_ewma": (lambda: K.TimeDecay(43_200_000), ["value"])}, KEY, ["ts", "seq"], ts="ts")
    return made.select("user_id", "seq", six(F.col("timer_ewma")).alias("timer_ewma"))


@query(
    f"WITH RECURSIVE {_QUEUE}, r AS (SELECT user_id, seq, rn, {{'h': value, 't': ms, 'a': CAST(0 AS DOUBLE), 'n': CAST(0 AS DOUBLE)}} AS s FROM q WHERE rn = 1 UNION ALL SELECT q.user_id, q.seq, q.rn, "
    "CASE WHEN q.ms > r.s.t THEN {'h': q.value, 't': q.ms, 'a': r.s.a + r.s.h * (q.ms - r.s.t), 'n': r.s.n + q.ms - r.s.t} ELSE r.s END "
    "FROM r JOIN q ON q.user_id = r.user_id AND q.rn = r.rn + 1) SELECT user_id, seq, round(CASE WHEN s.n = 0 THEN s.h ELSE s.a / s.n END, 6) AS timer_twap FROM r"
)
def timer_twap(spark, d):
    made = recur(_timed_queue(spark, d), {"timer_twap": (K.Twap, ["value"])}, KEY, ["ts", "seq"], ts="ts")
    return made.select("user_id", "seq", six(F.col("timer_twap")).alias("timer_twap"))


def _stateless(name: str, make, expression: str):
    def run(spark, d):
        x = {n: C.number(F.col(n)) for n in LEGS}
        return legs(spark, d).select("event_id", six(make(**x)).alias(name))

    run.__name__ = name
    query(f"WITH {_LEGS} SELECT event_id, round({expression}, 6) AS {name} FROM l")(run)


_stateless("spread", lambda leg1, leg2, direct: C.spread(leg1, leg2), "leg1 - leg2")
_stateless("tri_arb_spread", lambda leg1, leg2, direct: C.tri_arb_spread(leg1, leg2, direct), "direct - leg1 * leg2")
_stateless("average", lambda leg1, leg2, direct: C.average(leg1, leg2, direct), "(leg1 + leg2 + direct) / 3")
_stateless("weighted_average", lambda leg1, leg2, direct: C.weighted_average(leg1, leg2, direct, leg2), "CASE WHEN leg2 + leg2 = 0 THEN NULL ELSE (leg1 * leg2 + direct * leg2) / (leg2 + leg2) END")
_stateless("harmonic_mean", lambda leg1, leg2, direct: C.harmonic_mean(leg1, leg2, direct, ieee=True), "3 / (1 / leg1 + 1 / leg2 + 1 / direct)")
_stateless("select_mux", lambda leg1, leg2, direct: C.select(C.condition(leg1, ">", 60.0), leg2, direct), "CASE WHEN leg1 > 60 THEN leg2 ELSE direct END")


@query("SELECT l_returnflag, l_linestatus, date_trunc('month', l_shipdate) AS month, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY ALL")
def venue_weighted_average(spark, d):
    """The weighted average where inputs are rows, not columns."""
    g = lineitem(spark, d, "l_returnflag", "l_linestatus").groupBy("l_returnflag", "l_linestatus", F.date_trunc("month", "l_shipdate").cast("timestamp").alias("month"))
    return g.agg(F.round(F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), F.sum("l_quantity")), 4).alias("price"))


@query(f"WITH {_LEGS} SELECT event_id, leg1, leg2, direct FROM l")
def asof_latest(spark, d):
    return legs(spark, d).select("event_id", *LEGS)


@query(f"SELECT event_id, value > 60 AS high, coalesce((value > 60) <> lag(value > 60) OVER {_W}), true) AS flip FROM events")
def condition_flips(spark, d):
    e = events(spark, d).select(*KEY, *ORDER, C.condition(F.col("value"), ">", 60.0).alias("high"))
    return changes.flips(e, "high", KEY, ORDER).select("event_id", "high", "flip")


def _cutoff(name: str, tolerance: float | None, sql: str):
    """Over values in steps of 100, so that repeats and small moves occur."""

    def run(spark, d):
        stepped = F.round(F.col("value") / 100) * 100
        e = events(spark, d).select(*KEY, *ORDER, stepped.alias("x"), F.lit(True).alias("evaluated"))
        return changes.calc_changes(e, "x", "evaluated", KEY, ORDER, name, tolerance).select("event_id", "changed")

    run.__name__ = f"cutoff_{name}"
    query(f"WITH s AS (SELECT event_id, x, lag(x) OVER {_W}) AS p FROM (SELECT *, round(value / 100) * 100 AS x FROM events)) SELECT event_id, p IS NULL OR {sql} AS changed FROM s")(run)


_cutoff("exact", None, "x <> p")
_cutoff("always", None, "true")
_cutoff("never", None, "false")
_cutoff("absolute", 150.0, "abs(x - p) > 150")
_cutoff("relative", 0.4, "CASE WHEN greatest(abs(x), abs(p)) = 0 THEN false ELSE abs(x - p) / greatest(abs(x), abs(p)) > 0.4 END")


@query(
    f"WITH {_LEGS}, a AS (SELECT *, coalesce(leg1 > 60, false) AS high FROM l) SELECT event_id, round(last_value(CASE WHEN high THEN leg1 - leg2 END IGNORE NULLS) OVER w, 6) AS sell, "
    f"round(last_value(CASE WHEN NOT high THEN leg1 - direct END IGNORE NULLS) OVER w, 6) AS buy FROM a WINDOW w AS {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def switch_routing(spark, d):
    df = legs(spark, d)
    high = C.condition(C.number(F.col("leg1")), ">", 60.0)
    df = changes.gated(df, high, F.col("leg1") - F.col("leg2"), KEY, ORDER, "sell")
    return changes.gated(df, ~high, F.col("leg1") - F.col("direct"), KEY, ORDER, "buy").select("event_id", six(F.col("sell")).alias("sell"), six(F.col("buy")).alias("buy"))


@query(
    "SELECT user_id, date_trunc('day', ts) AS bucket, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (event_type = '{t}') AS {n}" for n, t in LEGS.items())
    + ", CAST(count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS BIGINT) AS updates FROM events GROUP BY ALL"
)
def batch_coalesce(spark, d):
    made = E.coalesced(legs(spark, d, filled=False), list(LEGS), KEY, F.date_trunc("day", "ts").cast("timestamp"), ORDER)
    return made.select("user_id", "bucket", *LEGS, "updates")


def _fx(**kinds):
    """The currency triangle over three event types."""
    return load_graph({"graph": {"name": "triangle", "nodes": [
        *[{"name": n, "type": "SCALAR_SOURCE", "properties": kinds} for n in LEGS],
        {"name": "spread", "type": "TRI_ARB_SPREAD", "inputs": {n: n for n in LEGS}},
        {"name": "ewma", "type": "EWMA", "inputs": {"input": "spread"}, "properties": {"alpha": 0.1}},
    ]}})


_FX_SQL = (
    f"{_LEGS}, s AS (SELECT *, direct - leg1 * leg2 AS x, lag(direct - leg1 * leg2) OVER {_W}) AS p FROM l), "
    f"c AS (SELECT user_id, event_id, ts, x, row_number() OVER {_W}) AS rn FROM s WHERE x IS NOT NULL AND (p IS NULL OR p <> x)), "
    "r AS (SELECT user_id, event_id, rn, x AS w FROM c WHERE rn = 1 UNION ALL SELECT c.user_id, c.event_id, c.rn, 0.1 * c.x + 0.9 * r.w FROM r JOIN c ON c.user_id = r.user_id AND c.rn = r.rn + 1), "
    f"f AS (SELECT s.user_id, s.event_id, s.ts, s.x, r.w FROM s LEFT JOIN r ON r.event_id = s.event_id)"
)


@query(f"WITH RECURSIVE {_FX_SQL} SELECT event_id, round(x, 6) AS spread, round(last_value(w IGNORE NULLS) OVER {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ewma FROM f")
def fx_arb_graph(spark, d):
    """Incremental reading: the average advances only when the spread changed."""
    plan = compile_graph(_fx(), ["spread", "ewma"])
    return plan.run(legs(spark, d, filled=False), key=KEY, order=ORDER).select("event_id", six(F.col("spread")).alias("spread"), six(F.col("ewma")).alias("ewma"))


@query(
    f"WITH {_LEGS}, s AS (SELECT *, direct - leg1 * leg2 AS x FROM l), v AS (SELECT event_id, unnest([{{'node': 'leg1', 'v': leg1, 'p': lag(leg1) OVER w}}, {{'node': 'leg2', 'v': leg2, 'p': lag(leg2) OVER w}}, "
    f"{{'node': 'direct', 'v': direct, 'p': lag(direct) OVER w}}, {{'node': 'spread', 'v': x, 'p': lag(x) OVER w}}]) AS u FROM s WINDOW w AS {_W})) "
    "SELECT event_id, u.node AS node, round(u.v, 6) AS value FROM v WHERE u.v IS NOT NULL AND (u.p IS NULL OR u.p <> u.v)"
)
def change_feed(spark, d):
    """Changed nodes of each epoch; sources that are still NaN in a key's first epoch are left out here."""
    graph = _fx()
    nodes = [n for n in graph.restricted(["spread"]).topology.order]
    plan = compile_graph(graph, ["spread", *LEGS])
    made = plan.run(legs(spark, d, filled=False), key=KEY, order=ORDER, feed=True)
    return changes.change_feed(made, nodes, ["event_id"]).where(~F.isnan("value")).select("event_id", "node", F.round("value", 6).alias("value"))


@query("SELECT event_id, user_id || '.' || event_type || '.' || n AS node, CASE n WHEN 'px' THEN value ELSE value * 2 END AS value FROM events, (SELECT unnest(['px', 'twice']) AS n)")
def router_unpivot(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", "value", (F.col("value") * 2).alias("twice"))
    return E.route(e, ["user_id", "event_type"], ["value", "twice"], ["event_id"], {"value": "px"})


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query("SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS third, CAST(embedding[1000] AS DOUBLE) AS beyond FROM embeddings")
def vector_element(spark, d):
    return vectors(spark, d).select("vec_id", C.element(F.col("v"), 2).alias("third"), F.when(~F.isnan(C.element(F.col("v"), 999)), C.element(F.col("v"), 999)).alias("beyond"))


@query("SELECT vec_id, CAST(unnest(range(0, 4)) AS INTEGER) AS position, 'curve.' || ['1M', '3M', '6M', '1Y'][unnest(range(1, 5))] AS node, CAST(unnest(embedding[1:4]) AS DOUBLE) AS value FROM embeddings")
def vector_expand(spark, d):
    labels = F.array(*[F.lit(x) for x in ("1M", "3M", "6M", "1Y")])
    return vectors(spark, d).select("vec_id", F.posexplode(C.copy_vector(F.col("v"), 4)).alias("position", "value")).select("vec_id", "position", F.concat(F.lit("curve."), F.get(labels, F.col("position"))).alias("node"), "value")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS squares, round(CAST(embedding[1] AS DOUBLE) * embedding[2] + vec_id, 6) AS mixed FROM embeddings")
def vector_math(spark, d):
    flat = C.flattened((F.slice("v", 1, 2), True), (F.col("vec_id").cast("double"), False))
    made = vectors(spark, d).withColumn("flat", flat)
    return made.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"), F.round(F.get("flat", F.lit(0)) * F.get("flat", F.lit(1)) + F.get("flat", F.lit(2)), 6).alias("mixed"))


@query(
    "WITH p AS (SELECT vec_id, label, embedding AS c, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) "
    "SELECT vec_id, p IS NULL OR list_max(list_transform(list_zip(c, p), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2]))) > 2.5 AS changed FROM p"
)
def vector_tolerance(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    prev = F.lag("v").over(Window.partitionBy("label").orderBy("vec_id"))
    return v.withColumn("p", prev).select("vec_id", F.coalesce(vector_changed_column(F.col("p"), F.col("v"), 2.5), F.lit(True)).alias("changed"))


@query(
    "SELECT user_id, date_trunc('day', ts) AS epoch, " + ", ".join(f"arg_max(value, event_id) FILTER (event_id % 3 = {i}) AS e{i}" for i in range(3)) + " FROM events GROUP BY ALL"
)
def vector_element_updates(spark, d):
    """Updates of single elements, gathered to one vector an epoch."""
    e = events(spark, d).select("user_id", F.date_trunc("day", "ts").cast("timestamp").alias("epoch"), "event_id", F.pmod("event_id", F.lit(3)).alias("index"), "value")
    made = E.element_updates(e, 3, ["user_id"], "epoch", ["event_id"])
    return made.select("user_id", "epoch", *[F.get("vector", F.lit(i)).alias(f"e{i}") for i in range(3)])


@query(
    "WITH RECURSIVE t AS (SELECT 'region' || n_regionkey AS a, 'nation' || n_nationkey AS b FROM nation UNION ALL SELECT 'nation' || s_nationkey, 'supplier' || s_suppkey FROM supplier), "
    "r AS (SELECT a AS ancestor, b AS descendant FROM t UNION SELECT r.ancestor, t.b FROM r JOIN t ON r.descendant = t.a) SELECT ancestor, descendant FROM r"
)
def lineage_closure(spark, d):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(text("region", "n_regionkey").alias("parent"), text("nation", "n_nationkey").alias("child"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select(text("nation", "s_nationkey").alias("parent"), text("supplier", "s_suppkey").alias("child"))
    return lineage(n.union(s))


@query(f"WITH {_LEGS} SELECT n AS node, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS nan_count FROM (SELECT unnest(['leg1', 'leg2', 'direct']) AS n, unnest([leg1, leg2, direct]) AS v FROM l) GROUP BY n")
def nan_counts(spark, d):
    df = legs(spark, d).select(*[C.number(F.col(n)).alias(n) for n in LEGS])
    return telemetry.nan_counts(df, list(LEGS))


@query("SELECT event_type || '.' || user_id AS node, CAST(count(*) AS BIGINT) AS changes, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY ALL ORDER BY changes DESC, node LIMIT 50")
def node_profile_topk(spark, d):
    return telemetry.profile(events(spark, d).select(F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("node"), "value"))


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{p}" for q, p in ((0.5, "50"), (0.75, "75"), (0.9, "90"), (0.99, "99"))) + " FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    found = telemetry.quantiles(events(spark, d), "value", ["event_type"], (0.5, 0.75, 0.9, 0.99), exact=True)
    return found.select("event_type", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("avg", "p50", "p75", "p90", "p99")])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value > 120) WHERE n = 1")
def alerts_first_hit(spark, d):
    return changes.alerts(events(spark, d), "value", ">", 120.0, KEY, ORDER).select("user_id", "event_id", "value")


@query("SELECT window_start, CAST(count(*) AS BIGINT) AS n FROM (SELECT date_trunc('hour', ts) AS window_start FROM events) GROUP BY ALL")
def events_per_window(spark, d):
    return events(spark, d).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n")


@query(f"WITH {_LEGS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM l) SELECT user_id, leg1, leg2, direct FROM n WHERE k = 1")
def snapshot_last(spark, d):
    """The snapshot's JSON, read again."""
    made = changes.snapshot(legs(spark, d).select(*KEY, *ORDER, *[C.number(F.col(n)).alias(n) for n in LEGS]), list(LEGS), KEY, ORDER)
    return made.select("user_id", F.from_json("snapshot", "leg1 double, leg2 double, direct double").alias("s")).select("user_id", "s.*")


_BOND = {"graph": {"name": "bond", "templates": [
    {"name": "venue", "nodes": [{"name": "{{prefix}}.bid", "type": "SCALAR_SOURCE"}, {"name": "{{prefix}}.qty", "type": "SCALAR_SOURCE"}]},
    {"name": "bond", "nodes": [
        {"type": "TEMPLATE", "properties": {"template": "venue", "prefix": "{{key}}.F"}},
        {"type": "TEMPLATE", "properties": {"template": "venue", "prefix": "{{key}}.O"}},
        {"name": "{{key}}.wBid", "type": "WEIGHTED_AVG", "inputs": {"i0": "{{key}}.F.bid", "i1": "{{key}}.F.qty", "i2": "{{key}}.O.bid", "i3": "{{key}}.O.qty"}},
        {"name": "{{key}}.top", "type": "AVERAGE", "inputs": {"i0": "{{key}}.F.bid", "i1": "{{key}}.O.bid"}},
        {"name": "{{key}}.mid", "type": "AVERAGE", "inputs": {"i0": "{{key}}.wBid", "i1": "{{key}}.top"}},
        {"name": "{{key}}.move", "type": "DIFF", "inputs": {"input": "{{key}}.mid"}},
    ]},
]}}


@query(
    "WITH v AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate, " + ", ".join(f"last_value(CASE WHEN l_linestatus = '{s}' THEN {c} END IGNORE NULLS) OVER w AS {s}{n}" for s in "FO" for c, n in (("l_extendedprice", "b"), ("l_quantity", "q")))
    + f" FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {', '.join(_L_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
    "m AS (SELECT *, ((Fb * Fq + Ob * Oq) / (Fq + Oq) + (Fb + Ob) / 2) / 2 AS mid FROM v) "
    f"SELECT {_L_KEYS}, round(mid + 1e-8, 6) AS mid, CASE WHEN mid IS NOT NULL THEN round(coalesce(mid - lag(mid) OVER (PARTITION BY l_suppkey, mid IS NULL ORDER BY {', '.join(_L_ORDER)}), 0) + 1e-8, 6) END AS move FROM m"
)
def bond_graph(spark, d):
    """Nested templates; a supplier is an instance, and instances are keys of rows. Nudged, as halves of cents make ties."""
    graph = template_spec(_BOND, "bond", key="B")
    rows = lineitem(spark, d, "l_linestatus")
    sources = [F.when(F.col("l_linestatus") == s, F.col(c)).alias(f"B.{s}.{n}") for s in "FO" for c, n in (("l_extendedprice", "bid"), ("l_quantity", "qty"))]
    plan = compile_graph(graph, ["B.mid", "B.move"], "every_row")
    made = plan.run(rows.select(*_L_KEYS.split(", "), *sources), key=["l_suppkey"], ts="l_shipdate", order=[c for c in _L_ORDER if c != "l_suppkey"])
    show = lambda n: F.round(F.when(~F.isnan(quoted(n)), F.col(quoted(n))) + 1e-8, 6)
    return made.select(*_L_KEYS.split(", "), show("B.mid").alias("mid"), show("B.move").alias("move"))


def stress_graph():
    """Thirteen nodes over three sources, an instance a key; divisions by zero as in SQL."""
    b = GraphBuilder("stress")
    s1, s2, s3 = (b.scalar_source(f"s{i}") for i in (1, 2, 3))
    mean = b.node("mean", "AVERAGE", {"1": s1, "2": s2, "3": s3})
    smooth = b.node("smooth", "EWMA", {"input": mean})
    move = b.node("move", "DIFF", {"input": smooth})
    sma = b.rolling("sma", "SMA", move, 10)
    trend = b.node("trend", "MACD", {"input": sma})
    gap = b.node("gap", "SPREAD", {"a": trend, "b": s1})
    harmonic = b.node("harmonic", "HARMONIC_MEAN", {"1": gap, "2": s2}, ieee=True)
    arb = b.node("arb", "TRI_ARB_SPREAD", {"leg1": harmonic, "leg2": smooth, "direct": sma})
    weighted = b.node("weighted", "WEIGHTED_AVG", {"0a": arb, "0b": s1, "1a": gap, "1b": s2}, ieee=True)
    b.node("final", "AVERAGE", {"1": weighted, "2": s1})
    return b.build()


def stress_rows(spark, d):
    return legs(spark, d, filled=False).withColumnsRenamed({n: f"s{i}" for i, n in enumerate(LEGS, start=1)})


def stress_shown(made: DataFrame) -> DataFrame:
    """Null before all sources are there; NaN after that is of 0 / 0 and stays."""
    six_places = lambda n: rounded(F.when(~F.isnan(n), F.col(n)), 6).alias(n)
    final = rounded(F.when(~F.isnan("smooth"), F.col("final")), 3) + 0.0
    return made.select("event_id", six_places("smooth"), six_places("trend"), final.alias("final"))


@query(
    f"WITH RECURSIVE {_LEGS}, c AS (SELECT user_id, event_id, leg1 AS s1, leg2 AS s2, direct AS s3, row_number() OVER {_W}) AS rn FROM l WHERE leg1 IS NOT NULL AND leg2 IS NOT NULL AND direct IS NOT NULL), "
    "r AS (SELECT user_id, event_id, rn, s1, s2, (s1 + s2 + s3) / 3 AS w, [CAST(0 AS DOUBLE)] AS ds, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS g FROM c WHERE rn = 1 UNION ALL "
    "SELECT user_id, event_id, rn, s1, s2, w, ds, 2.0 / 13 * list_avg(ds) + 11.0 / 13 * pf, 2.0 / 27 * list_avg(ds) + 25.0 / 27 * pg FROM ("
    "SELECT c.user_id, c.event_id, c.rn, c.s1, c.s2, 0.1 * ((c.s1 + c.s2 + c.s3) / 3) + 0.9 * r.w AS w, list_slice(list_append(r.ds, 0.1 * ((c.s1 + c.s2 + c.s3) / 3) + 0.9 * r.w - r.w), greatest(1, len(r.ds) - 8), len(r.ds) + 1) AS ds, r.f AS pf, r.g AS pg "
    "FROM r JOIN c ON c.user_id = r.user_id AND c.rn = r.rn + 1)), "
    "o AS (SELECT *, f - g - s1 AS gap FROM r), h AS (SELECT *, 2 / (1 / gap + 1 / s2) AS har FROM o), k AS (SELECT *, ((list_avg(ds) - har * w) * s1 + gap * s2) / (s1 + s2) AS wt FROM h) "
    "SELECT l.event_id, round(k.w, 6) AS smooth, round(k.f - k.g, 6) AS trend, round((k.wt + k.s1) / 2, 3) + 0.0 AS final FROM l LEFT JOIN k ON k.event_id = l.event_id"
)
def stress_template(spark, d):
    made = compile_graph(stress_graph(), ["smooth", "trend", "final"], "every_row").run(stress_rows(spark, d), key=KEY, order=ORDER)
    return stress_shown(made)


# The incremental reading step by step: a row says which nodes run (their inputs moved), and what is carried on else. Mean,
# move and window move with what feeds them; an average that comes out as it was stops there.
@query(
    f"WITH RECURSIVE {_LEGS}, c AS (SELECT user_id, event_id, leg1 AS s1, leg2 AS s2, direct AS s3, row_number() OVER {_W}) AS rn FROM l WHERE leg1 IS NOT NULL AND leg2 IS NOT NULL AND direct IS NOT NULL), "
    "r AS (SELECT user_id, event_id, rn, s1, s2, (s1 + s2 + s3) / 3 AS m, (s1 + s2 + s3) / 3 AS w, CAST(0 AS DOUBLE) AS mv, [CAST(0 AS DOUBLE)] AS ds, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS g, true AS aw FROM c WHERE rn = 1 UNION ALL "
    "SELECT user_id, event_id, rn, s1, s2, m, w, mv, ds, a, CASE WHEN a <> pa THEN 2.0 / 13 * a + 11.0 / 13 * pf ELSE pf END, CASE WHEN a <> pa THEN 2.0 / 27 * a + 25.0 / 27 * pg ELSE pg END, a <> pa FROM ("
    "SELECT *, CASE WHEN mv <> pmv THEN list_avg(ds) ELSE pa END AS a FROM ("
    "SELECT *, CASE WHEN mv <> pmv THEN list_slice(list_append(pds, mv), greatest(1, len(pds) - 8), len(pds) + 1) ELSE pds END AS ds FROM ("
    "SELECT *, CASE WHEN w <> pw THEN w - pw ELSE pmv END AS mv FROM ("
    "SELECT *, CASE WHEN m <> pm THEN 0.1 * m + 0.9 * pw ELSE pw END AS w FROM ("
    "SELECT c.user_id, c.event_id, c.rn, c.s1, c.s2, (c.s1 + c.s2 + c.s3) / 3 AS m, r.m AS pm, r.w AS pw, r.mv AS pmv, r.ds AS pds, r.a AS pa, r.f AS pf, r.g AS pg FROM r JOIN c ON c.user_id = r.user_id AND c.rn = r.rn + 1)))))), "
    "o AS (SELECT *, f - g - s1 AS gap FROM r), h AS (SELECT *, 2 / (1 / gap + 1 / s2) AS har FROM o), k AS (SELECT *, ((a - har * w) * s1 + gap * s2) / (s1 + s2) AS wt FROM h) "
    "SELECT l.event_id, round(k.w, 6) AS smooth, round(k.f - k.g, 6) AS trend, round((k.wt + k.s1) / 2, 3) + 0.0 AS final FROM l LEFT JOIN k ON k.event_id = l.event_id"
)
def stress_incremental(spark, d):
    """The same graph in its incremental reading."""
    made = compile_graph(stress_graph(), ["smooth", "trend", "final"]).run(stress_rows(spark, d), key=KEY, order=ORDER)
    return stress_shown(made)


@query(f"WITH {_LEGS} SELECT event_id, round(CASE WHEN leg1 IS NULL OR leg2 IS NULL THEN NULL ELSE greatest(leg1, leg2) * 2 END, 6) AS made FROM l")
def compute_function(spark, d):
    """A user's Python function as a node; it sees NaN before both inputs are there."""
    b = GraphBuilder()
    x, y = b.scalar_source("leg1"), b.scalar_source("leg2")
    b.compute("made", lambda p, q: max(p, q) * 2 if p == p and q == q else float("nan"), x, y)
    made = compile_graph(b.build(), ["made"]).run(legs(spark, d, filled=False), key=KEY, order=ORDER)
    return made.select("event_id", six(F.col("made")).alias("made"))


@query(f"SELECT event_id, round(max(value) {_frame(5)} - min(value) {_frame(5)}, 6) AS span FROM events")
def custom_window(spark, d):
    """Any aggregate over the row window."""
    r = Rolling(["value"], KEY, ORDER)
    return events(spark, d).select("event_id", six(r.custom(F.max("value"), 5) - r.custom(F.min("value"), 5)).alias("span"))


@query(f"WITH {_LEGS} SELECT event_id, '{{\"type\":\"tick\",\"epoch\":' || event_id || ',\"values\":{{\"high\":' || CASE WHEN coalesce(leg1 > 60, false) THEN '1.0' ELSE '0.0' END || '}}}}' AS message FROM l")
def tick_messages(spark, d):
    df = legs(spark, d).select("event_id", C.condition(C.number(F.col("leg1")), ">", 60.0).alias("high"))
    return changes.tick_json(df, ["high"], "event_id").select("event_id", "message")


@query(f"SELECT event_id, round(sqrt(sum(value * value) {_frame(4)} / count(value) {_frame(4)}), 6) AS rms FROM events")
def accumulated_window(spark, d):
    """A user's accumulator as a window node."""

    class MeanSquare:
        def __init__(self):
            self.n, self.sum = 0, 0.0

        def add(self, x):
            self.n, self.sum = self.n + 1, self.sum + x * x

        def remove(self, x):
            self.n, self.sum = self.n - 1, self.sum - x * x

        def result(self):
            return (self.sum / self.n) ** 0.5

    b = GraphBuilder()
    b.windowed("rms", b.scalar_source("value"), 4, MeanSquare)
    made = compile_graph(b.build(), ["rms"], "every_row").run(events(spark, d), key=KEY, order=ORDER)
    return made.select("event_id", six(F.col("rms")).alias("rms"))


@query(
    f"WITH RECURSIVE {_FX_SQL}, g AS (SELECT user_id, arg_max(x, (ts, event_id)) AS x FROM f GROUP BY user_id), "
    "h AS (SELECT user_id, arg_max(w, (ts, event_id)) FILTER (w IS NOT NULL) AS w FROM f GROUP BY user_id) "
    "SELECT g.user_id, CAST(5 AS BIGINT) AS n_nodes, 'TRI_ARB_SPREAD' AS kind, 'leg1' AS first_leg, round(g.x, 6) AS spread, round(h.w, 6) AS ewma FROM g JOIN h ON h.user_id = g.user_id"
)
def graph_snapshot(spark, d):
    """The whole graph as a document per key, read back from its JSON."""
    graph = _fx()
    made = compile_graph(graph, ["spread", "ewma"]).run(legs(spark, d, filled=False), key=KEY, order=ORDER)
    node = "struct<name:string,type:string,inputs:map<string,string>,value:double>"
    doc = changes.graph_snapshot(made, graph, KEY, ORDER).select("user_id", F.from_json("snapshot", f"name string, version string, nodes array<{node}>").alias("g"))
    named = lambda n: F.element_at(F.filter("g.nodes", lambda x: x["name"] == n), 1)
    return doc.select(
        "user_id", F.size("g.nodes").cast("long").alias("n_nodes"), named("spread")["type"].alias("kind"), named("spread")["inputs"]["leg1"].alias("first_leg"),
        F.round(named("spread")["value"], 6).alias("spread"), F.round(named("ewma")["value"], 6).alias("ewma"),
    )


@query(
    f"WITH {_LEGS} SELECT event_id, '{{\"type\":\"tick\",\"epoch\":' || event_id || ',\"values\":{{\"high\":' || CASE WHEN coalesce(leg1 > 60, false) THEN '1.0' ELSE '0.0' END || '}},\"metrics\":{{\"rows\":' "
    f"|| row_number() OVER {_W}) || ',\"missing\":' || (CASE WHEN leg2 IS NULL THEN 1 ELSE 0 END) || '}}}}' AS message FROM l"
)
def tick_metrics(spark, d):
    rows = F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER))
    df = legs(spark, d).select("event_id", "user_id", "ts", "leg2", C.condition(C.number(F.col("leg1")), ">", 60.0).alias("high")).withColumn("rows", rows)
    return changes.tick_json(df, ["high"], "event_id", {"rows": F.col("rows"), "missing": F.when(F.col("leg2").isNull() | F.isnan("leg2"), 1).otherwise(0)}).select("event_id", "message")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_id <= 5000) WHERE n = 1")
def replay_state(spark, d):
    """Each key's state at an earlier epoch."""
    return changes.replay(events(spark, d), KEY, ORDER, F.col("event_id") <= 5000).select("user_id", "event_id", "value")
