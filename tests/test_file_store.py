"""Stores of one file a run, their codecs, telemetry and the helpers for tests."""

import contextlib
import itertools

import pytest

from millrace import testing
from millrace.operators.readmodel import STATUSES
from millrace.plans import telemetry
from millrace.plans.executor import Executor, RunError
from millrace.plans.graph import PipelineBuilder
from millrace.plans.state import RunState
from millrace.sources import file_store as fs
from millrace.sources.store import Missing


def example(spark=None):
    s = RunState("a/b".replace("/", ":") + " ü", {"n": 1 << 60, "x": -0.0, "t": "", "b": False, "j": [1, {"k": None}]})
    s.statuses = {f"s{i}": v for i, v in enumerate(STATUSES)}
    s.outputs, s.waits, s.cause, s.depth = {"s2": {"a": [1]}}, {"s5": 99}, "deadline", 3
    return s


@pytest.mark.parametrize("codec", [fs.JsonCodec(), fs.ArrowCodec()])
def test_round_trip(spark, tmp_path, codec):
    store, s = fs.FileStore(spark, f"file://{tmp_path}", codec), example()
    store.save(s)
    store.save(s)
    assert store.load(s.run_id).to_json() == s.to_json() and store.list() == [s.run_id]
    assert [p.name for p in (tmp_path / "runs").iterdir() if not p.name.endswith(".crc")] == [store._file(s.run_id).rsplit("/", 1)[1]]
    with pytest.raises(Missing):
        store.load("none")
    with pytest.raises(ValueError):
        store.load("../x")
    store.deliver("r", "2", "go", '{"n": 9007199254740993}'), store.deliver("r", "1", "go", ""), store.deliver("r", "1", "go", '"x"')
    assert store.signals("r") == [("1", "go", '"x"'), ("2", "go", '{"n": 9007199254740993}')]
    store.acknowledge("r", "1", "absent")
    assert [x[0] for x in store.signals("r")] == ["2"] and store.signals("q") == []
    for damaged in (b"", b"\0" * 40, b"{", codec.signal("1", "n", "")[:-9]):
        with pytest.raises(fs.Corrupt):
            codec.run_of(damaged)
        with pytest.raises(fs.Corrupt):
            codec.signal_of(damaged)
    store.delete(s.run_id), store.delete(s.run_id)
    assert store.list() == []


def test_runs_on_files(spark, tmp_path):
    b = PipelineBuilder()
    b.step("a", lambda s: s.data.update(rows=spark.range(4)))
    b.wait_signal("w", "go").depends_on("a")
    b.step("c", lambda s: s.data["rows"].count()).depends_on("w")
    g = b.build()
    for codec in (fs.JsonCodec(), fs.ArrowCodec()):
        store = fs.FileStore(spark, f"file://{tmp_path}/{codec.suffix}", codec)
        Executor(store).run(g, RunState("r"))
        assert Executor(store).deliver_and_resume(g, "r", "1", "go", "p").outputs == {"w": "p", "c": 4}


def test_migration(spark, tmp_path):
    store = fs.FileStore(spark, f"file://{tmp_path}", fs.JsonCodec())
    for i in range(3):
        s = example()
        s.run_id = f"r{i}"
        store.save(s)
    assert fs.migrate(spark, f"file://{tmp_path}") == 3 and len(store.list()) == 3
    assert fs.migrate(spark, f"file://{tmp_path}", clean_up=True) == 3 and store.list() == []
    assert fs.FileStore(spark, f"file://{tmp_path}", fs.ArrowCodec()).load("r1").waits == {"s5": 99}


def test_codes():
    assert [fs.status_of(fs.status_code(s)) for s in ("", *STATUSES)] == ["", *STATUSES]
    with pytest.raises(fs.Corrupt):
        fs.status_of(10)
    assert fs.payload_of(fs.payload_text(None)) is None and fs.payload_of(fs.payload_text({"a": 1 << 62})) == {"a": 1 << 62}


class Meter:
    def __init__(self):
        self.read = {}

    def __getattr__(self, kind):
        return lambda name, callbacks, unit: self.read.__setitem__(name, lambda: [o for c in callbacks for o in c()])


def test_metrics_and_spans(spark):
    ticks, seen = itertools.count(0, 1_000_000_000), []

    class Tracer:
        @contextlib.contextmanager
        def start_as_current_span(self, name, attributes):
            seen.append((name, sorted(attributes)))
            yield

    c = telemetry.Collector(telemetry.MetricsConfig(slow=2))
    b = PipelineBuilder()
    b.step("a", lambda s: None)
    b.step("b", lambda s: None).depends_on("a")
    Executor(workers=1, traced=telemetry.spans(Tracer(), c, lambda: next(ticks))).run(b.build(), RunState("r"))
    assert seen == [("pipeline.run", ["run_id", "steps"]), ("a", ["run_id", "step"]), ("b", ["run_id", "step"])]
    assert c.rows()[0] == ("pipeline.run", 1, 5 * 10**9, 5 * 10**9, 5 * 10**9, 5 * 10**9, 0) and c.slow() == [("pipeline.run", 5 * 10**9)]
    assert c.frame(spark).count() == 3
    meter = Meter()
    telemetry.bridge_operations(meter, c, lambda v, a: (v, a["operation"]))
    assert len(meter.read) == 6 and (1, "a") in meter.read["millrace.operation.count"]() and (1.0, "b") in meter.read["millrace.operation.duration.max"]()
    off = telemetry.Collector(telemetry.DISABLED)
    with off.measured("x", lambda: 1):
        pass
    assert off.rows() == []
    half = telemetry.Collector(telemetry.MetricsConfig().with_(sampling=0.5), iter([0.4, 0.6] * 5).__next__)
    for _ in range(10):
        with half.measured("x", lambda: 1):
            pass
    assert half.count["x"] == 5  # the sample's count, not scaled up
    with pytest.raises(ValueError):
        telemetry.MetricsConfig(sampling=2)
    assert telemetry.small_state(4).metrics is telemetry.DISABLED and telemetry.large_state(9, 9).metrics.sampling == 0.01 and telemetry.default_state().nodes == 16


def test_dispatch_bridge(spark, tmp_path):
    from millrace.sources.queue_store import QueueStore

    store, meter = QueueStore(spark, f"file://{tmp_path}/store"), Meter()
    store.enqueue("r", "t", 1)
    store.counters["retries"] += 2
    telemetry.bridge_dispatch(meter, [store, store], lambda v, a: (v, a))
    assert len(meter.read) == 8 and meter.read["millrace.queue.depth"]() == [(1, {"state": "pending"})]
    assert meter.read["millrace.queue.in_flight"]() == [(0, {})] and meter.read["millrace.dispatch.retries"]() == [(4, {})]


def test_test_helpers():
    b = PipelineBuilder()
    b.step("a", lambda s: s.data.update(n=1))
    g, store = b.build(), testing.RecordingStore().fail("save", OSError("away"))
    with pytest.raises(OSError):
        Executor(store).run(g, RunState("r"))
    state = Executor(store).run(g, RunState("r"))
    assert store.calls["save"] == 2
    testing.assert_complete(state), testing.assert_ran(state, ["a"]), testing.assert_statuses(state, a="completed"), testing.assert_data(state, n=1)
    for broken in (lambda: testing.assert_ran(state, []), lambda: testing.assert_statuses(state, a="failed"), lambda: testing.assert_data(state, n=2), lambda: testing.assert_complete(RunState("q"))):
        with pytest.raises(AssertionError):
            broken()
    b = PipelineBuilder()
    b.step("a", lambda s: 1 // 0)
    with pytest.raises(RunError):
        Executor(store).run(b.build(), RunState("s"))


def test_kinds_of_errors(spark, tmp_path):
    from millrace.sources.store import Busy, Fenced, kind_of

    pairs = [(Busy(), "busy"), (Fenced(), "fenced"), (Missing("r"), "missing"), (FileNotFoundError(), "missing"), (OSError(), "io"), (fs.Corrupt(), "corrupt"), (ValueError(), "validation"), (RuntimeError(), "other")]
    assert [kind_of(e) for e, _ in pairs] == [k for _, k in pairs]
    store = fs.FileStore(spark, f"file://{tmp_path}")
    with pytest.raises(Exception) as e:
        store._fs.open(store._path(f"{tmp_path}/none"))
    assert kind_of(e.value) == "missing"
