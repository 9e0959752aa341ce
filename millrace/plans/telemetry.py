"""Metrics of steps and of dispatch for a meter, and spans for a tracer. Meter and tracer are the caller's: anything with the calls of the
public OpenTelemetry API. Without one nothing is measured beyond the executor's own rows."""

from __future__ import annotations

import contextlib
import random
import threading
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class MetricsConfig:
    """enabled; sampling: the share of operations that is measured; timing: seconds too, not only counts; slow: seconds from which an operation is
    reported as slow."""

    enabled: bool = True
    sampling: float = 1.0
    timing: bool = True
    slow: float = 0.1

    def __post_init__(self):
        if not 0 <= self.sampling <= 1 or self.slow < 0:
            raise ValueError(f"sampling must be from 0 to 1, slow 0 or more: {self}")

    def with_(self, **changes) -> MetricsConfig:
        return replace(self, **changes)


DISABLED = MetricsConfig(enabled=False, sampling=0.0, timing=False)
PRODUCTION = MetricsConfig(sampling=0.01, slow=0.5)


@dataclass(frozen=True)
class StateConfig:
    """How a run's state is set up: expected sizes, beyond which a run is reported as large, and its metrics."""

    nodes: int = 16
    data: int = 32
    metrics: MetricsConfig = field(default_factory=MetricsConfig)


def default_state() -> StateConfig:
    return StateConfig()


def small_state(nodes: int) -> StateConfig:
    """As few as the run has; nothing is measured."""
    return StateConfig(nodes, 2 * nodes, DISABLED)


def large_state(nodes: int, data: int) -> StateConfig:
    return StateConfig(nodes, data, PRODUCTION)


class Collector:
    """Counts, seconds and operations under way, by name. Under sampling all figures are those of the sample."""

    def __init__(self, config: MetricsConfig | None = None, draw: Callable[[], float] = random.random):
        self.config, self.draw, self._lock = config or MetricsConfig(), draw, threading.Lock()
        self.reset()

    def reset(self) -> None:
        self.count, self.total, self.active = defaultdict(int), defaultdict(int), defaultdict(int)
        self.least, self.most = {}, {}

    @contextlib.contextmanager
    def measured(self, name: str, clock: Callable[[], int]) -> Iterator[None]:
        if not self.config.enabled or self.draw() >= self.config.sampling:
            yield
            return
        began = clock()
        with self._lock:
            self.active[name] += 1
        try:
            yield
        finally:
            nanos = clock() - began if self.config.timing else 0
            with self._lock:
                self.active[name] -= 1
                self.count[name] += 1
                self.total[name] += nanos
                self.least[name] = min(self.least.get(name, nanos), nanos)
                self.most[name] = max(self.most.get(name, nanos), nanos)

    def rows(self) -> list[tuple[str, int, int, int, int, int, int]]:
        """(operation, n, total, least, most, average, active), slowest on average first."""
        with self._lock:
            out = [(k, n, self.total[k], self.least[k], self.most[k], self.total[k] // n, self.active[k]) for k, n in self.count.items()]
        return sorted(out, key=lambda r: (-r[5], r[0]))

    def slow(self) -> list[tuple[str, int]]:
        """Operations whose longest run took the threshold or more, slowest first."""
        return sorted(((r[0], r[4]) for r in self.rows() if r[4] >= self.config.slow * 1e9), key=lambda r: (-r[1], r[0]))

    def frame(self, spark):
        return spark.createDataFrame(self.rows(), "operation string, n long, total long, least long, most long, average long, active long")


def bridge_operations(meter, collector: Collector, observation: Callable, prefix: str = "millrace") -> list:
    """Six instruments that read the collector when the meter asks: count, total, active, average, longest and shortest seconds by operation.
    ``observation(value, attributes)`` makes what a callback gives."""

    def of(index: int, scale: float = 1):
        return lambda _options=None: [observation(r[index] * scale if scale != 1 else r[index], {"operation": r[0]}) for r in collector.rows()]

    return [
        meter.create_observable_counter(f"{prefix}.operation.count", [of(1)], unit="{operation}"),
        meter.create_observable_counter(f"{prefix}.operation.duration.total", [of(2, 1e-9)], unit="s"),
        meter.create_observable_up_down_counter(f"{prefix}.operation.active", [of(6)], unit="{operation}"),
        meter.create_observable_gauge(f"{prefix}.operation.duration.avg", [of(5, 1e-9)], unit="s"),
        meter.create_observable_gauge(f"{prefix}.operation.duration.max", [of(4, 1e-9)], unit="s"),
        meter.create_observable_gauge(f"{prefix}.operation.duration.min", [of(3, 1e-9)], unit="s"),
    ]


def bridge_dispatch(meter, stores: list, observation: Callable, prefix: str = "millrace") -> list:
    """The queue's depth by state, items in flight, and the six dispatch counters, summed over ``stores`` (the table is that of the first)."""
    from millrace.operators.readmodel import in_flight, queue_counts
    from millrace.operators.reports import COUNTERS

    def depth(_options=None):
        return [observation(r["n"], {"state": r["state"]}) for r in queue_counts(stores[0].table("work_queue")).collect()]

    def flying(_options=None):
        t = stores[0].snapshot("work_queue", "leases")
        return [observation(in_flight(t["work_queue"], t["leases"], 0).count(), {})]

    def counter(name: str):
        return lambda _options=None: [observation(sum(s.counters[name] for s in stores), {})]

    out = [meter.create_observable_gauge(f"{prefix}.queue.depth", [depth], unit="{item}"), meter.create_observable_gauge(f"{prefix}.queue.in_flight", [flying], unit="{item}")]
    return out + [meter.create_observable_counter(f"{prefix}.dispatch.{c}", [counter(c)], unit="{event}") for c in COUNTERS]


def spans(tracer, collector: Collector | None = None, clock: Callable[[], int] | None = None) -> Callable:
    """What an executor takes as ``traced``: a span around the run, and one, named like it, around each step that runs; none for steps that do not.
    Attributes are of a closed set and hold no data of the run."""
    import time

    clock = clock or time.perf_counter_ns

    @contextlib.contextmanager
    def traced(name: str, attributes: dict) -> Iterator[None]:
        title = "pipeline.run" if name == "run" else attributes["step"]
        known = {k: v for k, v in attributes.items() if k in ("run_id", "steps", "step")}
        with contextlib.ExitStack() as stack:
            if tracer is not None:
                stack.enter_context(tracer.start_as_current_span(title, attributes=known))
            if collector is not None:
                stack.enter_context(collector.measured(title, clock))
            yield

    return traced
