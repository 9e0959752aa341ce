"""What a step may be made of: actions, and wrappers around them. An action is ``f(state) -> output``; large data stay DataFrames,
which actions build and hand on lazily."""

from __future__ import annotations

import logging
import random
import threading
import time
import uuid
from collections.abc import Callable

Action = Callable
log = logging.getLogger("millrace")


class StepError(RuntimeError):
    """An action that failed; ``index`` is its place in a sequence."""

    index: int | None = None


class Rejected(StepError):
    """An approval that was refused."""


class TimedOut(StepError):
    """An action that took too long."""


def sequence(*actions: Action) -> Action:
    """One after another; the error tells which one failed."""

    def run(state):
        out = None
        for i, a in enumerate(actions):
            try:
                out = a(state)
            except Exception as e:
                failed = StepError(f"action {i}: {e}")
                failed.index = i
                raise failed from e
        return out

    return run


def mapped(source: str, target: str, f: Callable) -> Action:
    """``data[target] = f(data[source])``; a missing source is an error. With DataFrames as values this is ``transform``."""

    def run(state):
        if source not in state.data:
            raise StepError(f"no data under {source!r}")
        state.data[target] = out = f(state.data[source])
        return out

    return run


def validated(source: str, check: Callable, target: str, error: str | None = None) -> Action:
    """Stores whether ``check(value)`` holds, and the text of what it raised; a missing value is an error."""

    def run(state):
        if source not in state.data:
            raise StepError(f"no data under {source!r}")
        said = ""
        try:
            ok = bool(check(state.data[source]))
        except Exception as e:
            ok, said = False, str(e)
        state.data[target] = ok
        if error is not None:
            state.data[error] = said
        if not ok:
            raise StepError(said or f"{source!r} is not valid")
        return ok

    return run


def retried(a: Action, n: int, delay: float = 0.0, factor: float = 2.0, jitter: float = 0.0, linear: bool = False, again: Callable | None = None, sleep: Callable = time.sleep) -> Action:
    """At most ``n`` more tries. Waits delay * factor ** k (or delay * k if linear), and up to ``jitter`` of it more; ``again(error)`` may end it."""

    def run(state):
        for k in range(max(0, n) + 1):
            try:
                return a(state)
            except Exception as e:
                if k >= n or (again is not None and not again(e)):
                    raise
                wait = delay * (k + 1) if linear else delay * factor**k
                if wait:
                    sleep(wait * (1 + random.random() * jitter))

    return run


def with_timeout(a: Action, seconds: float, spark=None) -> Action:
    """Asks the action to end after ``seconds``, waits until it has, then fails. Spark jobs of the action are tagged and cancelled;
    other code sees ``state.cancelled``, which is the action's own: its neighbours and later tries are not asked to end."""

    def run(state):
        state = state.scoped() if hasattr(state, "scoped") else state
        tag, late = f"millrace-{uuid.uuid4().hex}", threading.Event()

        def stop():
            late.set()
            state.cancelled.set()
            if spark is not None:
                spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        timer.daemon = True
        if spark is not None:
            spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            out = a(state)
        except Exception as e:
            if late.is_set():
                raise TimedOut(f"took more than {seconds} s") from e
            raise
        finally:
            timer.cancel()
            if spark is not None:
                spark.sparkContext.removeJobTag(tag)
        if late.is_set():
            raise TimedOut(f"took more than {seconds} s")
        return out

    return run


def logged(name: str) -> Callable[[Action], Action]:
    def wrap(a: Action) -> Action:
        def run(state):
            began = time.monotonic()
            log.info("%s: starts", name)
            try:
                out = a(state)
            except Exception:
                log.exception("%s: failed after %.3f s", name, time.monotonic() - began)
                raise
            log.info("%s: done after %.3f s", name, time.monotonic() - began)
            return out

        return run

    return wrap


def checked(check: Callable) -> Callable[[Action], Action]:
    """Runs ``check(state)``, which may raise, before the action."""

    def wrap(a: Action) -> Action:
        def run(state):
            check(state)
            return a(state)

        return run

    return wrap


class Stack:
    """Wrappers in order of use: the first is the outermost."""

    def __init__(self, *wrappers: Callable[[Action], Action]):
        self.wrappers = list(wrappers)

    def use(self, wrapper: Callable[[Action], Action]) -> Stack:
        self.wrappers.append(wrapper)
        return self

    def apply(self, a: Action) -> Action:
        for w in reversed(self.wrappers):
            a = w(a)
        return a
