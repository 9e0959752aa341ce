"""Helpers for tests of pipelines: a store that records and fails on demand, and assertions on runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from millrace.plans.state import RunState
from millrace.sources.store import MemoryStore


class RecordingStore(MemoryStore):
    """Counts its calls. ``fail`` names a call whose next uses raise the error given, ``times`` of them."""

    def __init__(self):
        super().__init__()
        self.calls: Counter[str] = Counter()
        self._fails: dict[str, list] = {}

    def fail(self, call: str, error: Exception, times: int = 1) -> RecordingStore:
        self._fails.setdefault(call, []).extend([error] * times)
        return self

    def _noted(self, call: str) -> None:
        self.calls[call] += 1
        if self._fails.get(call):
            raise self._fails[call].pop(0)

    def save(self, state: RunState, now: int = 0, token: int | None = None) -> None:
        self._noted("save")
        super().save(state, now, token)

    def load(self, run_id: str) -> RunState:
        self._noted("load")
        return super().load(run_id)

    def delete(self, run_id: str) -> None:
        self._noted("delete")
        super().delete(run_id)

    def deliver(self, run_id: str, sig_id: str, name: str, payload: str, now: int = 0) -> None:
        self._noted("deliver")
        super().deliver(run_id, sig_id, name, payload, now)


def assert_statuses(state: RunState, **want: str) -> None:
    """The named steps have these statuses."""
    got = {n: state.statuses.get(n) for n in want}
    if got != want:
        raise AssertionError(f"{state.run_id}: {got}, not {want}")


def assert_ran(state: RunState, names: Iterable[str]) -> None:
    """These steps are completed, and no others are."""
    got, want = {n for n, s in state.statuses.items() if s == "completed"}, set(names)
    if got != want:
        raise AssertionError(f"{state.run_id}: also completed {sorted(got - want)}, not completed {sorted(want - got)}")


def assert_complete(state: RunState) -> None:
    if not state.complete():
        raise AssertionError(f"{state.run_id} is not complete: {state.statuses}")


def assert_data(state: RunState, **want) -> None:
    for k, v in want.items():
        if k not in state.data or state.data[k] != v:
            raise AssertionError(f"{state.run_id}: {k} is {state.data.get(k)!r}, not {v!r}")
