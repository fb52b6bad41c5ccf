"""A driver-side scheduler of timer sources, for engines that live in this process."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from ..plans.spec import GraphSpec


class TimerScheduler:
    """Calls back (name, tick) for each timer of a graph, with a fixed delay between ticks.

    One daemon thread serves all timers; without timers there is none. Over streams, use a
    trigger interval or tick rows instead.
    """

    def __init__(self, graph: GraphSpec):
        self._intervals = {n.name: graph.registry.kind(n.type).make(n.properties) / 1000.0 for n in graph.sources() if n.type == "TIMER"}
        self._thread: threading.Thread | None = None
        self._stopped = threading.Event()

    @property
    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def start(self, callback: Callable[[str, int], None]) -> None:
        if callback is None:
            raise ValueError("a callback is needed")
        if self.running:
            raise RuntimeError("the scheduler is running")
        self._stopped.clear()
        if self._intervals:
            self._thread = threading.Thread(target=self._loop, args=(callback,), name="timers", daemon=True)
            self._thread.start()

    def _loop(self, callback: Callable[[str, int], None]) -> None:
        due = {n: time.monotonic() + s for n, s in self._intervals.items()}
        ticks = dict.fromkeys(due, 0)
        while True:
            name = min(due, key=due.get)
            if self._stopped.wait(max(0.0, due[name] - time.monotonic())):
                return
            ticks[name] += 1
            callback(name, ticks[name])
            due[name] = time.monotonic() + self._intervals[name]

    def stop(self) -> None:
        self._stopped.set()
        if self._thread is not None:
            self._thread.join(5)
            self._thread = None

    def __enter__(self) -> TimerScheduler:
        return self

    def __exit__(self, *_) -> None:
        self.stop()
