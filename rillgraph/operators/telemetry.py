"""Listeners and summaries: latencies, node profiles, NaN counts."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Listener

QUANTILES = (0.5, 0.75, 0.9, 0.99, 0.999, 0.9999, 0.99999)


class Composite(Listener):
    def __init__(self, *listeners: Listener):
        self.listeners = listeners

    def on_start(self, epoch):
        for x in self.listeners:
            x.on_start(epoch)

    def on_node(self, epoch, node, changed):
        for x in self.listeners:
            x.on_node(epoch, node, changed)

    def on_error(self, epoch, node, error):
        for x in self.listeners:
            x.on_error(epoch, node, error)

    def on_end(self, epoch, evaluated, events):
        for x in self.listeners:
            x.on_end(epoch, evaluated, events)


class NodeProfile(Listener):
    """Per node: evaluations, changes, errors and time since the callback before."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.rows: dict[str, list[float]] = {}
        self.errors: dict[str, int] = {}
        self._t = time.perf_counter_ns()

    def on_start(self, epoch):
        self._t = time.perf_counter_ns()

    def on_node(self, epoch, node, changed):
        t = time.perf_counter_ns()
        took, self._t = t - self._t, t
        r = self.rows.setdefault(node, [0, 0, 0, float("inf"), 0, 0])
        r[0] += 1
        r[1] += took
        r[2], r[3], r[4] = took, min(r[3], took), max(r[4], took)
        r[5] += changed

    def on_error(self, epoch, node, error):
        self.errors[node] = self.errors.get(node, 0) + 1

    def dump(self, by: str = "total_ns") -> list[dict]:
        """By total time or another figure, the largest first; by ``node``, in order of names."""
        rows = [{"node": n, "count": int(r[0]), "total_ns": int(r[1]), "last_ns": int(r[2]), "min_ns": int(r[3]), "max_ns": int(r[4]), "avg_ns": r[1] / r[0], "changes": int(r[5])} for n, r in self.rows.items()]
        return sorted(rows, key=lambda r: (0 if by == "node" else -r[by], r["node"]))


class Latency(Listener):
    """Epoch durations after a warm-up: all of them in powers of 2^(1/8), bounded in memory."""

    def __init__(self, warmup_epochs: int = 0):
        self.warmup, self.buckets, self.count, self.total = warmup_epochs, {}, 0, 0
        self.least, self.most = None, None

    def on_start(self, epoch):
        self._t = time.perf_counter_ns()

    def on_end(self, epoch, evaluated, events):
        if epoch <= self.warmup:
            return
        self.record(time.perf_counter_ns() - self._t)

    def record(self, ns: int) -> None:
        b = (max(1, ns) ** 8).bit_length()
        self.buckets[b] = self.buckets.get(b, 0) + 1
        self.count, self.total = self.count + 1, self.total + ns
        self.least = ns if self.least is None else min(self.least, ns)
        self.most = ns if self.most is None else max(self.most, ns)

    def summary(self) -> dict[str, float]:
        out = {"count": self.count, "min": self.least, "max": self.most, "avg": self.total / self.count if self.count else None}
        for q in QUANTILES:
            seen = 0
            for b in sorted(self.buckets):
                seen += self.buckets[b]
                if seen >= q * self.count:
                    out[f"p{q * 100:g}"] = min(2 ** (b / 8), self.most)
                    break
        return out


class RollingLatency(Listener):
    """Latencies of about the last ``window_s`` seconds: two phases that start half a window apart; the older one is read.

    A phase that is a window old starts anew, so what is read covers between half a window and a whole one.
    """

    def __init__(self, window_s: float = 3600.0, clock=time.monotonic):
        self.window, self.clock = window_s, clock
        now = clock()
        self.phases, self.since = [Latency(), Latency()], [now, now - window_s / 2]

    def on_start(self, epoch):
        self._t = time.perf_counter_ns()

    def on_end(self, epoch, evaluated, events):
        self.record(time.perf_counter_ns() - self._t)

    def record(self, ns: int) -> None:
        now = self.clock()
        old = [now - t >= self.window for t in self.since]
        for i in (0, 1):
            if old[i]:
                self.phases[i], self.since[i] = Latency(), now
        if all(old):
            self.since[1] = now - self.window / 2
        for phase in self.phases:
            phase.record(ns)

    def summary(self) -> dict[str, float]:
        return self.phases[0 if self.since[0] <= self.since[1] else 1].summary()


class Wired(Composite):
    """What a dashboard listens with: all-time and rolling latencies, node profile and errors, and one report of them."""

    def __init__(self, *more: Listener, warmup_epochs: int = 0, window_s: float = 3600.0, write=print):
        self.latency, self.rolling, self.nodes, self.errors = Latency(warmup_epochs), RollingLatency(window_s), NodeProfile(), ErrorLog(write)
        super().__init__(self.latency, self.rolling, self.nodes, self.errors, *more)

    def report(self, by: str = "total_ns") -> dict:
        return {"latency": self.latency.summary(), "rolling": self.rolling.summary(), "profile": self.nodes.dump(by), "errors": dict(self.errors.counts)}


def nan_counts(df: DataFrame, nodes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., node, nan_count), one aggregation for all nodes."""
    q = lambda n: F.col("`" + n.replace("`", "``") + "`")
    wide = df.groupBy(*keep).agg(*[F.sum(F.isnan(q(n)).cast("long")).alias(f"__{i}") for i, n in enumerate(nodes)])
    return wide.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.col(f"__{i}").alias("nan_count")) for i, n in enumerate(nodes)])).alias("r")).select(*keep, "r.*")


def profile(feed: DataFrame, top: int = 50, by: str = "changes") -> DataFrame:
    """Changes per node from a change feed, the most frequent first, or by another of the columns (``node`` ascending)."""
    return feed.groupBy("node").agg(F.count(F.lit(1)).alias("changes"), F.min("value").alias("min_value"), F.max("value").alias("max_value")).orderBy(F.col(by).asc() if by == "node" else F.col(by).desc(), "node").limit(top)


def quantiles(df: DataFrame, column: str, keep: Sequence[str] = (), qs: Sequence[float] = QUANTILES[:5], exact: bool = False) -> DataFrame:
    """Percentiles per group: approximate in bounded memory, or exact and interpolated, with every distinct value held."""
    point = (lambda q: F.percentile(column, q)) if exact else (lambda q: F.percentile_approx(column, q, 10_000))
    return df.groupBy(*keep).agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("avg"), *[point(q).alias(f"p{q * 100:g}".replace(".", "_")) for q in qs])


class ErrorLog(Listener):
    """Counts errors by node and hands the first of each interval to ``write``."""

    def __init__(self, write=print, interval_s: float = 1.0):
        self.write, self.interval, self.counts, self._next = write, interval_s, {}, {}

    def on_error(self, epoch, node, error):
        self.counts[node] = self.counts.get(node, 0) + 1
        now = time.monotonic()
        if now >= self._next.get(node, 0.0):
            self._next[node] = now + self.interval
            self.write(f"epoch {epoch}, {node}: {error!r} ({self.counts[node]} so far)")
