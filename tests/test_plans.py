"""Plans over DataFrames agree with the engine and with each other."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgraph.functions import columns as C
from rillgraph.functions import kernels as K
from rillgraph.functions.registry import default_registry
from rillgraph.gallery import stress_graph
from rillgraph.operators import changes, telemetry
from rillgraph.operators.engine import Engine, Listener
from rillgraph.operators.scans import recur
from rillgraph.plans.builder import GraphBuilder
from rillgraph.plans.compiler import ChangedStretch, compile_graph, strategies
from rillgraph.plans.explain import edges, init_payload, lineage
from rillgraph.sources import epochs, feeds
from rillgraph.streaming import live

NAN = float("nan")


def rows_of(seed, n, keys, sources, levels=6):
    """Sparse updates with repeats, zeros of both signs and NaN faults."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        u = [r.choice([None, None, NAN if r.random() < 0.2 else float(r.randrange(levels)) * r.choice([1.0, 1.0, -1.0])]) for _ in sources]
        out.append((r.randrange(keys), i * 1000, i, *u))
    return out


def frame(spark, rows, sources):
    kinds = "key int, ms long, seq long, " + ", ".join(f"{s} double" for s in sources)
    return spark.createDataFrame(rows, kinds).withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def simulated(graph, rows, sources, outputs, every=False):
    """Independent of Spark: rows in order, an engine a key."""
    engines, out = {}, {}
    for key, ms, seq, *values in rows:
        e = engines.setdefault(key, Engine(graph, every=every))
        for s, v in zip(sources, values, strict=True):
            if v is not None:
                e.update(s, v)
        e.stabilize(ms)
        out[seq] = tuple(e.value(o) for o in outputs)
    return out


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-9)
    return a == b


def agree(got, expected, outputs):
    assert len(got) == len(expected)
    for r in got:
        for o, x in zip(outputs, expected[r["seq"]], strict=True):
            assert same(r[o], x), (r, o, x)


def gates():
    b = GraphBuilder()
    x, y = b.scalar_source("x", cutoff="absolute", tolerance=0.5), b.scalar_source("y")
    s = b.switch("s", x, b.condition("c", x, ">", 2.0))
    yes, no = b.node("yes", "SPREAD", {"a": s, "b": y}), b.node("no", "SPREAD", {"a": s, "b": y})
    b.mark_branch("s", yes, True), b.mark_branch("s", no, False)
    b.rolling("sum", "ROLLING_SUM", yes, 3)
    b.node("diff", "DIFF", {"input": b.rolling("sma", "SMA", x, 3)})
    b.throttle("held", x, 3000), b.time_decay("decay", x, 2000.0)
    b.select("pick", "c", x, y)
    return b.build()


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_plan_is_the_engine(spark, seed):
    graph, sources = gates(), ["x", "y"]
    outputs = ["c", "s", "yes", "no", "sum", "diff", "held", "decay", "pick"]
    rows = rows_of(seed, 300, 7, sources)
    plan = compile_graph(graph, outputs)
    assert plan.strategy == "stretches"
    expected = simulated(graph, rows, sources, outputs)
    agree(plan.run(frame(spark, rows, sources), key=["key"]).collect(), expected, outputs)
    agree(compile_graph(graph, outputs, strategy="engine").run(frame(spark, rows, sources), key=["key"]).collect(), expected, outputs)


def span_class():
    class Span:  # local, so that it travels by value
        """Largest less smallest."""

        def __init__(self):
            self.held = []

        def add(self, x):
            self.held.append(x)

        def remove(self, x):
            self.held.remove(x)

        def result(self):
            return max(self.held) - min(self.held)

    return Span


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_changed_stretches_are_the_engine(seed):
    """Values and changes of every kind of node without vectors, however the rows are cut into stretches."""
    b = GraphBuilder()
    x, y, z = b.scalar_source("x", cutoff="relative", tolerance=0.3), b.scalar_source("y", 1.0), b.scalar_source("z", cutoff="never")
    tick, free = b.timer("tick", 1000), b.scalar_source("free", cutoff=lambda p, c: c > p)
    s = b.switch("s", x, b.condition("c", y, ">", 2.0))
    yes, no = b.node("yes", "AVERAGE", {"a": s, "b": y}, cutoff="absolute", tolerance=1.0), b.node("no", "SPREAD", {"a": s, "b": y}, cutoff="never")
    b.mark_branch("s", yes, True), b.mark_branch("s", no, False)
    for kind in ("EWMA", "MACD", "RSI", "SMA", "ROLLING_VARIANCE", "Z_SCORE", "DIFF", "LOG_RETURN"):
        b.node(f"{kind}_y", kind, {"input": y}, cutoff="relative" if kind == "SMA" else None, tolerance=0.1 if kind == "SMA" else None)
    b.node("later", "EWMA", {"input": "SMA_y"}), b.node("both", "BETA", {"x": yes, "y": no}, window=4)
    b.throttle("held", x, 3000), b.time_decay("decay", yes, 2000.0), b.timer_ewma("te", z, tick, 1500.0), b.timer_twap("tw", free, tick)
    b.select("pick", "c", "decay", "EWMA_y"), b.condition("odd", "yes", lambda v: v > 1 or v != v)
    b.compute("user", lambda p, q: 1 / p + q, y, "held", cutoff=lambda p, c: abs(c - p) > 0.2), b.windowed("span", y, 4, span_class())
    graph = b.build()
    names = list(graph.topology.order)
    rows = rows_of(seed, 200, 1, ["x", "y", "z", "free", "tick"])
    engine, state = Engine(graph), ChangedStretch(graph)
    r, i = random.Random(seed), 0
    while i < len(rows):
        part = rows[i : i + r.randrange(0, 30)]
        i += len(part)
        given = {n: (np.array([q[3 + k] is not None for q in part], bool), np.array([NAN if q[3 + k] is None else q[3 + k] == q[3 + k] if n == "tick" else q[3 + k] for q in part], float)) for k, n in enumerate(["x", "y", "z", "free", "tick"])}
        got = state.run(given, np.array([q[1] for q in part], float))
        for j, (_, ms, _, *values) in enumerate(part):
            for n, v in zip(["x", "y", "z", "free"], values):
                if v is not None:
                    engine.update(n, v)
            if values[4] is not None and values[4] == values[4]:
                engine.mark("tick")
            engine.stabilize(float(ms))
            for n in names:
                assert same(float(engine.value(n)), float(got[n][j])), (i, j, n)
                assert engine.changed[engine.at[n]] == bool(state.changed[n][j]), (i, j, n)


def test_signed_zeros_are_changes(spark):
    """The exact cutoff goes by bits, whichever plan reads it."""
    b = GraphBuilder()
    b.rolling("mean", "SMA", b.scalar_source("x"), 10)
    graph = b.build()
    rows = [(0, i * 1000, i, v) for i, v in enumerate([6.0, 0.0, -0.0, 0.0, 0.0])]
    for strategy in ("flags", "stretches", "engine"):
        got = compile_graph(graph, ["mean"], strategy=strategy).run(frame(spark, rows, ["x"]), key=["key"]).orderBy("seq").collect()
        assert [r["mean"] for r in got] == [6.0, 3.0, 2.0, 1.5, 1.5], strategy
    df = frame(spark, rows, ["x"]).withColumn("on", F.lit(True))
    assert [r.changed for r in changes.source_changes(df, "x", ["key"], ["seq"]).orderBy("seq").collect()] == [True, True, True, True, False]
    assert [r.changed for r in changes.calc_changes(df, "x", "on", ["key"], ["seq"]).orderBy("seq").collect()] == [True, True, True, True, False]


def test_errors_of_user_functions_are_heard():
    """A failing function makes its node NaN, listeners hear of it, and an open breaker spares the calls."""
    calls, heard = [], []

    def shaky(x):
        calls.append(x)
        if x < 0:
            raise KeyError("below")
        return x * 2

    class Ear(Listener):
        def on_error(self, epoch, node, error):
            heard.append((epoch, node, type(error)))

    b = GraphBuilder()
    x = b.scalar_source("x")
    b.compute("open", shaky, x, breaker_ms=1000.0), b.compute_vector("pair", 2, lambda v: [v[0]], x)
    engine = Engine(b.build(), listeners=(Ear(),))
    out = []
    for ms, v in [(0, 1.0), (100, -1.0), (600, 2.0), (1099, 3.0), (1100, 4.0)]:
        engine.update("x", v)
        engine.stabilize(float(ms))
        out.append(engine.value("open"))
    assert [o if o == o else None for o in out] == [2.0, None, None, None, 8.0] and calls == [1.0, -1.0, 4.0]
    assert (2, "open", KeyError) in heard and sum(h[1] == "pair" for h in heard) == 5 and len(heard) == 6


def test_accumulators_are_windows(spark):
    """A user's accumulator by builder and by registry, in every plan."""
    b = GraphBuilder()
    Span = span_class()
    b.windowed("span", b.scalar_source("x"), 3, Span)
    graph = b.build()
    named = GraphBuilder(registry=default_registry().accumulator("span", lambda p: Span()))
    named.node("span", "SPAN", {"input": named.scalar_source("x")}, window=3)
    rows = rows_of(5, 120, 3, ["x"])
    for evaluation in ("changed", "every_row"):
        expected = simulated(named.build() if evaluation == "changed" else graph, rows, ["x"], ["span"], every=evaluation == "every_row")
        assert strategies(graph, evaluation) == ["stretches", "engine"]
        for strategy in strategies(graph, evaluation):
            agree(compile_graph(graph, ["span"], evaluation, strategy).run(frame(spark, rows, ["x"]), key=["key"]).collect(), expected, ["span"])

def gates_without_time():
    b = GraphBuilder()
    x, y = b.scalar_source("x", cutoff="absolute", tolerance=0.5), b.scalar_source("y", 1.0)
    s = b.switch("s", x, b.condition("c", x, ">", 2.0))
    yes, no = b.node("yes", "SPREAD", {"a": s, "b": y}), b.node("no", "SPREAD", {"a": s, "b": y})
    b.mark_branch("s", yes, True), b.mark_branch("s", no, False)
    b.rolling("sum", "ROLLING_SUM", yes, 3)
    b.node("diff", "DIFF", {"input": b.node("sma", "SMA", {"input": x, "trigger": y}, window=3, cutoff="relative", tolerance=0.2)})
    b.node("log", "LOG_RETURN", {"input": y}), b.node("still", "AVERAGE", {"a": b.node("off", "SPREAD", {"a": x, "b": y}, cutoff="never")})
    b.select("pick", "c", x, y), b.condition("other", "yes", "!=", 0.0)
    return b.build()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flagged_columns_are_the_engine(spark, seed):
    """All of the incremental reading as window expressions."""
    graph, sources = gates_without_time(), ["x", "y"]
    outputs = ["c", "s", "yes", "no", "sum", "diff", "sma", "log", "off", "still", "pick", "other"]
    rows = rows_of(seed, 300, 7, sources)
    plan = compile_graph(graph, outputs)
    assert plan.strategy == "flags"
    df = plan.run(frame(spark, rows, sources), key=["key"])
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text and "Arrow" not in text
    agree(df.collect(), simulated(graph, rows, sources, outputs), outputs)


def test_every_row_plans_agree(spark):
    sources = ["s1", "s2", "s3"]
    rows = rows_of(3, 400, 3, sources)
    outputs = ["mean", "smooth", "move", "sma", "trend", "final"]
    graph = stress_graph()
    expected = simulated(graph, rows, sources, outputs, every=True)
    for strategy in ("stretches", "engine"):
        agree(compile_graph(graph, outputs, "every_row", strategy).run(frame(spark, rows, sources), key=["key"]).collect(), expected, outputs)


def test_window_columns_agree(spark):
    b = GraphBuilder()
    x, y = b.scalar_source("x"), b.scalar_source("y", 2.0)
    for kind in ("SMA", "ROLLING_MAX", "ROLLING_MIN", "ROLLING_SUM", "ROLLING_VARIANCE", "Z_SCORE"):
        b.rolling(kind.lower(), kind, x, 4)
    b.node("vol", "HIST_VOL", {"logReturn": x}, window=4)
    b.node("beta", "BETA", {"x": x, "y": y}, window=4), b.node("corr", "CORRELATION", {"x": x, "y": y}, window=4)
    b.node("diff", "DIFF", {"input": x}), b.node("log", "LOG_RETURN", {"input": x})
    b.node("hm", "HARMONIC_MEAN", {"a": x, "b": y}), b.node("wa", "WEIGHTED_AVG", {"a": x, "b": y}), b.node("odd", "WEIGHTED_AVG", {"a": x, "b": y, "c": x})
    graph = b.build()
    outputs = [n for n in graph.topology.order if n not in ("x", "y")]
    rows = rows_of(5, 300, 4, ["x", "y"])
    plan = compile_graph(graph, outputs, "every_row")
    assert plan.strategy == "columns"
    expected = simulated(graph, rows, ["x", "y"], outputs, every=True)
    agree(plan.run(frame(spark, rows, ["x", "y"]), key=["key"]).collect(), expected, outputs)
    agree(compile_graph(graph, outputs, "every_row", "stretches").run(frame(spark, rows, ["x", "y"]), key=["key"]).collect(), expected, outputs)


def test_stateless_incremental_graph_needs_no_python(spark):
    b = GraphBuilder()
    b.node("s", "SPREAD", {"a": b.scalar_source("x"), "b": b.scalar_source("y")})
    graph = b.build()
    plan = compile_graph(graph, ["s"])
    assert plan.strategy == "columns"
    rows = rows_of(9, 120, 3, ["x", "y"])
    df = plan.run(frame(spark, rows, ["x", "y"]), key=["key"])
    text = df._jdf.queryExecution().executedPlan().toString()
    agree(df.collect(), simulated(graph, rows, ["x", "y"], ["s"]), ["s"])
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text and "Arrow" not in text


def test_vector_and_timer_sources_in_plans(spark):
    b = GraphBuilder()
    v, t = b.vector_source("v", 2), b.timer("t", 1000)
    b.vector_element("e", v, 1), b.node("copy", "COMPUTE_VECTOR", {"i": v}, size=3)
    b.timer_twap("w", b.scalar_source("x"), t)
    graph = b.build()
    df = spark.createDataFrame(
        [(1, 0, 0, [1.0, 2.0], None, 1.0), (1, 1000, 1, [None, 5.0], True, None), (1, 2000, 2, None, True, 3.0), (1, 4000, 3, None, True, None)],
        "key int, ms long, seq long, v array<double>, t boolean, x double",
    ).withColumn("ts", F.timestamp_millis("ms"))
    got = {r["seq"]: r for r in compile_graph(graph, ["v", "e", "copy", "t", "w"]).run(df, key=["key"]).collect()}
    assert got[1]["v"] == [1.0, 5.0] and got[1]["e"] == 5.0 and got[1]["copy"] == [1.0, 5.0, 0.0]
    assert [got[i]["t"] for i in range(4)] == [1, 2, 3, 4] and got[3]["w"] == pytest.approx((1 + 1 + 3 + 3) / 4)


def test_change_feed_snapshot_and_messages(spark):
    b = GraphBuilder()
    b.node("s", "SPREAD", {"a": b.scalar_source("x", 1.0), "b": b.scalar_source("y", 1.0)})
    graph = b.build()
    df = spark.createDataFrame([(1, 0, 0, 2.0), (1, 1, 1, None), (1, 2, 2, NAN)], "key int, ms long, seq long, x double").withColumn("ts", F.timestamp_millis("ms"))
    made = compile_graph(graph, ["x", "y", "s"]).run(df, key=["key"], feed=True)
    got = {(r["seq"], r["node"]): r["value"] for r in changes.change_feed(made, graph.topology.order, ["seq"]).collect()}
    assert set(got) == {(0, "x"), (0, "y"), (0, "s"), (2, "x"), (2, "s")}
    snap = json.loads(changes.snapshot(made, ["x", "s"], ["key"], ["seq"]).first()["snapshot"])
    assert snap == {"x": None, "s": None}
    message = changes.tick_json(made.where("seq = 2"), ["x", "y"], "seq").first()["message"]
    assert json.loads(message) == {"type": "tick", "epoch": 2, "values": {"x": "NaN", "y": 1.0}}
    assert {r["node"]: r["nan_count"] for r in telemetry.nan_counts(made, ["x", "s"]).collect()} == {"x": 1, "s": 1}


def test_cut_stretches_carry_state(spark):
    """Arrow batches smaller than a key's rows change nothing."""
    df = spark.range(0, 500, 1, 1).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.sin("id") * 10).alias("x"))
    made = {"e": (lambda: K.Ewma(0.2), ["x"]), "r": (lambda: K.Rsi(5), ["x"]), "m": (lambda: K.Macd(3, 6), ["x"]), "s": (lambda: K.Sma(7), ["x"]), "v": (lambda: K.RollingVariance(4), ["x"])}
    whole = recur(df, made, ["k"], ["seq"]).orderBy("seq").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        cut = recur(df, made, ["k"], ["seq"]).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for a, b in zip(whole, cut, strict=True):
        assert all(same(a[c], b[c]) for c in made)


def test_comparisons_with_nan(spark):
    row = spark.range(1).select(*[C.condition(F.lit(NAN), o, 1.0).alias(n) for n, o in (("gt", ">"), ("lt", "<"), ("eq", "=="), ("ne", "!="))]).first()
    assert row.asDict() == {"gt": False, "lt": False, "eq": False, "ne": True}
    assert spark.range(1).select(C.harmonic_mean(F.lit(1.0), F.lit(-1.0)).alias("h")).first()["h"] == math.inf


def test_source_rules(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, None), (3, NAN), (4, NAN), (5, 2.0)], "seq int, x double").withColumn("k", F.lit(1))
    exact = [r["changed"] for r in changes.source_changes(df, "x", ["k"], ["seq"]).orderBy("seq").collect()]
    assert exact == [True, False, False, True, True, True]
    never = [r["changed"] for r in changes.source_changes(df, "x", ["k"], ["seq"], "never").orderBy("seq").collect()]
    assert never == [True, False, False, False, True, True]


def test_feeds_and_epochs(spark):
    fx = feeds.fx_ticks(spark, 1200)
    assert fx.where(F.isnan("EURUSD")).count() == 200 and fx.exceptAll(feeds.fx_ticks(spark, 1200)).count() == 0
    items = feeds.stress_items(spark, 500, items=10)
    assert items.select("item").distinct().count() == 10
    curve = feeds.curve_shocks(spark, 50)
    assert curve.groupBy("seq").count().agg(F.max("count")).first()[0] <= 3
    routed = epochs.route(items, ["item"], ["source1", "source2"], ["ts", "seq"])
    assert routed.count() == 1000
    wide = epochs.pivot_updates(routed, ["Item_001.source1"], [], ["ts", "seq"])
    assert wide.where(F.col("`Item_001.source1`").isNotNull()).count() == items.where("item = 'Item_001' AND source1 IS NOT NULL").count()
    bounds = items.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    t = epochs.ticks(bounds, 100)
    assert t.count() == 5 and epochs.with_ticks(items, t, "tick").where("tick").count() == 5


def test_lineage(spark):
    graph = stress_graph()
    got = {(r[0], r[1]) for r in lineage(edges(spark, graph)).collect()}
    assert {a for a, d in got if d == "final"} == graph.topology.ancestors(["final"]) - {"final"}


def test_stream_equals_batch(spark, tmp_path):
    graph, sources, outputs = gates(), ["x", "y"], ["c", "yes", "sum", "diff", "held", "decay"]
    rows = rows_of(11, 120, 4, sources)
    parts = [rows[:50], rows[50:]]
    for i, part in enumerate(parts):
        frame(spark, part, sources).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plan = compile_graph(graph, outputs)
    got = []

    def run():
        events = spark.readStream.schema(frame(spark, rows[:1], sources).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = live.to_sink(live.stream(plan, events, key=["key"]), lambda df, i: got.extend(df.collect()), str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    # files may come in either order; what comes later must continue the state
    expected = [simulated(graph, p, sources, outputs) for p in (parts[0] + parts[1], parts[1] + parts[0])]
    assert len(got) == len(rows)

    def fits(e):
        return all(all(same(r[o], x) for o, x in zip(outputs, e[r["seq"]], strict=True)) for r in got)

    assert any(fits(e) for e in expected)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_ranged_windows_equal_plain_ones(spark, partitions):
    """A hot key spans many ranges; small ranges make windows look back over several."""
    from rillgraph.operators.ranged import ranged_rolling
    from rillgraph.operators.rolling import Rolling

    r = random.Random(7)
    rows = [("hot" if r.random() < 0.6 else f"k{r.randrange(9)}", i, None if r.random() < 0.1 else NAN if r.random() < 0.1 else r.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, seq int, x double")
    made = {"sma": lambda w: w.sma(9), "low": lambda w: w.rolling_min(3), "diff": lambda w: w.diff()}
    plain = Rolling(["x"], ["k"], ["seq"])
    expected = {(row["k"], row["seq"]): row for row in df.withColumns({n: f(plain) for n, f in made.items()}).collect()}
    got = ranged_rolling(df, ["x"], ["k"], ["seq"], 9, made, partitions).collect()
    assert len(got) == len(rows)
    for row in got:
        assert all(same(row[n], expected[row["k"], row["seq"]][n]) for n in made)


def test_profiles_latencies_and_reports():
    """Rolling latencies forget what is older than a window; reports sort as asked."""
    now = [0.0]
    rolling = telemetry.RollingLatency(10.0, clock=lambda: now[0])
    for t, ns in [(0, 1000), (4, 1000), (5, 64_000), (9, 64_000), (14, 64_000), (14.9, 64_000)]:
        now[0] = t
        rolling.record(ns)
    assert rolling.summary()["min"] == 64_000 and rolling.summary()["count"] == 4
    now[0] = 100.0
    rolling.record(7)
    assert rolling.summary()["count"] == 1 and rolling.since[1] == 95.0
    b = GraphBuilder()
    b.rolling("mean", "SMA", b.scalar_source("x"), 3), b.compute("bad", lambda v: 1 / 0, "x")
    said = []
    wired = telemetry.Wired(write=said.append)
    engine = Engine(b.build(), listeners=(wired,))
    for i in range(5):
        engine.update("x", float(i))
        engine.stabilize(float(i))
    report = wired.report("count")
    assert report["errors"] == {"bad": 5} and len(said) == 1 and report["latency"]["count"] == report["rolling"]["count"] == 5
    assert [r["node"] for r in report["profile"]][0] in ("bad", "mean", "x") and [r["node"] for r in wired.nodes.dump("node")] == ["bad", "mean", "x"]


def test_quantiles_and_profile_orders(spark):
    df = spark.createDataFrame([(k, float(i)) for k in range(2) for i in range(1, 101)], "k int, x double")
    for exact in (False, True):
        rows = telemetry.quantiles(df, "x", ["k"], (0.5, 0.99), exact).orderBy("k").collect()
        assert [(r.n, r.min, r.max, r.avg) for r in rows] == [(100, 1.0, 100.0, 50.5)] * 2
        assert rows[0].p50 == (50.5 if exact else 50.0) and rows[0].p99 == pytest.approx(99.01 if exact else 99.0)
    feed = spark.createDataFrame([("b", 1.0), ("a", 5.0), ("b", 2.0)], "node string, value double")
    order = lambda by: [r.node for r in telemetry.profile(feed, by=by).collect()]
    assert order("changes") == ["b", "a"] and order("node") == order("max_value") == ["a", "b"]


def test_init_payload_and_snapshot(spark):
    b = GraphBuilder("page")
    v = b.vector_source("v", 2, headers=["bid", "ask"])
    b.vector_element("bid", v, 0), b.compute("twice", lambda x: x * 2, "bid")
    graph = b.build()
    payload = init_payload(graph)
    assert json.loads(json.dumps(payload)) == payload
    assert payload["routing"] == {"v": ["bid"], "bid": ["twice"], "twice": []} and payload["mermaid"].startswith("graph TD")
    assert payload["edge_labels"][0] == {"from": "v", "to": "bid", "labels": ["vector"]} and set(payload["sources"]) == {"bid", "twice"}
    rows = spark.createDataFrame([(1, 1, [1.0, NAN], 1.0, float("inf")), (1, 2, [2.0, 3.0], NAN, 4.0), (2, 1, None, None, 8.5)], "k int, seq int, v array<double>, bid double, twice double")
    docs = {r.k: json.loads(r.snapshot) for r in changes.graph_snapshot(rows, graph, ["k"], ["seq"]).collect()}
    nodes = {n["name"]: n for n in docs[1]["nodes"]}
    assert docs[1]["name"] == "page" and nodes["v"]["headers"] == ["bid", "ask"] and nodes["v"]["value"] == [2.0, 3.0]
    assert nodes["bid"]["value"] is None and nodes["bid"]["inputs"] == {"vector": "v"} and nodes["twice"]["value"] == 4.0
    assert {n["name"]: n["value"] for n in docs[2]["nodes"]} == {"v": None, "bid": None, "twice": 8.5}
    then = changes.replay(rows, ["k"], ["seq"], F.col("seq") <= 1).orderBy("k").collect()
    assert [(r.k, r.seq) for r in then] == [(1, 1), (2, 1)]


def test_throttled_sinks_and_backpressure():
    now, seen = [0.0], []
    sink = live.Throttled(lambda batch, n: seen.append(n), 1.0, clock=lambda: now[0])
    for n, t in enumerate([0.0, 0.5, 0.99, 1.0, 1.5, 5.0]):
        now[0] = t
        sink(None, n)
    assert seen == [0, 3, 5] and (sink.passed, sink.dropped) == (3, 3)

    class Query:
        lastProgress = {"inputRowsPerSecond": 200.0, "processedRowsPerSecond": 100.0}

    assert live.backpressure(Query()) == {"input_per_s": 200.0, "processed_per_s": 100.0, "load": 2.0, "behind": 100.0}
    Query.lastProgress = None
    assert live.backpressure(Query())["load"] == 0.0


def test_more_feeds(spark):
    bonds = feeds.bond_bursts(spark, 50).collect()
    per = {}
    for r in bonds:
        per.setdefault(r.ts, []).append(r.seq)
    assert all(1 <= len(s) <= 5 and len(set(s)) == len(s) for s in per.values()) and {r.field for r in bonds} == {"bid", "ask", "bidQty", "askQty"}
    regimes = feeds.regime_switch(spark, 800).collect()
    spread = lambda part: max(r.price for r in part) - min(r.price for r in part)
    assert {r.volatility for r in regimes[:200]} == {0.2} and {r.volatility for r in regimes[200:400]} == {3.0} and spread(regimes[200:400]) > spread(regimes[:200])
    shocks = feeds.decay_shocks(spark, 200).collect()
    assert [r.seq for r in shocks if r.signal] == [50, 100, 150] and all(a.ts < b.ts for a, b in zip(shocks, shocks[1:]))
    assert feeds.decay_shocks(spark, 200).collect() == shocks


def test_builder_templates(spark):
    """A template adds a part of the graph per prefix, through the builder."""

    def leg(b, prefix, config):
        x = b.scalar_source(f"{prefix}.x")
        return b.rolling(f"{prefix}.mean", "SMA", x, config["window"])

    class Doubles:
        def register(self, registry):
            registry.register("DOUBLED", ("input",), lambda p: lambda x: 2 * x)

    b = GraphBuilder(registry=default_registry().install(Doubles()))
    a, c = b.template("a", leg, {"window": 2}), b.template("c", leg, {"window": 3})
    b.node("gap", "SPREAD", {"a": a, "b": b.node("twice", "DOUBLED", {"input": c})})
    graph = b.build()
    rows = rows_of(8, 80, 2, ["a.x", "c.x"])
    df = frame(spark, rows, ["ax", "cx"]).withColumnsRenamed({"ax": "a.x", "cx": "c.x"})
    agree(compile_graph(graph, ["gap"]).run(df, key=["key"]).collect(), simulated(graph, rows, ["a.x", "c.x"], ["gap"]), ["gap"])


def test_floating_point_division_agrees(spark):
    """Means that divide by zeros of both signs, in every plan."""
    b = GraphBuilder()
    x, y = b.scalar_source("x"), b.scalar_source("y")
    b.node("hm", "HARMONIC_MEAN", {"a": x, "b": y}, ieee=True), b.node("wa", "WEIGHTED_AVG", {"a": x, "b": y, "c": y, "d": x}, ieee="true")
    graph, rows = b.build(), rows_of(11, 300, 4, ["x", "y"], levels=3)
    for evaluation, plans in (("every_row", ["columns", "stretches", "engine"]), ("changed", ["columns", "flags", "stretches", "engine"])):
        expected = simulated(graph, rows, ["x", "y"], ["hm", "wa"], every=evaluation == "every_row")
        assert {0.0, math.inf, -math.inf} <= {v for pair in expected.values() for v in pair}
        assert strategies(graph, evaluation) == plans
        for strategy in plans:
            agree(compile_graph(graph, ["hm", "wa"], evaluation, strategy).run(frame(spark, rows, ["x", "y"]), key=["key"]).collect(), expected, ["hm", "wa"])
    b = GraphBuilder()
    b.node("hm", "HARMONIC_MEAN", {"a": b.scalar_source("x")}, ieee="perhaps")
    with pytest.raises(ValueError):
        b.build()


def test_smoothing_by_arrays_is_by_rows_to_the_bit():
    r = random.Random(4)
    for _ in range(200):
        x = [v for _ in range(6) for v in [r.randrange(30000) / 100 / 3] * r.randrange(1, 4)]
        for make in (lambda: K.Ewma(0.1), lambda: K.Ewma(0.3), lambda: K.Macd(12, 26)):
            rows, arrays = make(), make()
            assert [rows.value(v) for v in x] == [*arrays.values(np.array(x[:4])), *arrays.values(np.array(x[4:]))]
