"""The state of one run: data by key, statuses, outputs and waits of its steps. The same as rows of the state tables."""

from __future__ import annotations

import copy
import json
import threading
from typing import Any

from millrace.operators.readmodel import TERMINAL

KINDS = {"integer": 0, "boolean": 1, "double": 2, "string": 3, "json": 4}
#: Marks the stored path of a DataFrame.
FRAME = "__frame__"
CAUSES = ("none", "failure", "canceled", "deadline")


_NOTHING = object()


class _Linked(threading.Event):
    """An event that is also set once its parent is."""

    def __init__(self, parent: threading.Event | None = None):
        super().__init__()
        self.parent = parent

    def is_set(self) -> bool:
        return super().is_set() or (self.parent is not None and self.parent.is_set())


class RunState:
    """``data`` may hold DataFrames while a run lasts; only plain values (numbers, text, booleans, JSON) outlive it."""

    def __init__(self, run_id: str, data: dict[str, Any] | None = None):
        if not valid_id(run_id):
            raise ValueError(f"not a run id: {run_id!r}")
        self.run_id, self.data = run_id, dict(data or {})
        self.statuses: dict[str, str] = {}
        self.outputs: dict[str, Any] = {}
        self.waits: dict[str, int] = {}
        self.rolling_back, self.cause, self.depth = False, "none", 0
        #: ("data" or "outputs", key) -> path of a DataFrame that is stored
        self.frames: dict[tuple[str, str], str] = {}
        self.cancelled = _Linked()

    def scoped(self) -> RunState:
        """The same state with a cancellation of its own, for one step."""
        out = copy.copy(self)
        out.cancelled = _Linked(self.cancelled)
        return out

    def clone(self) -> RunState:
        out = copy.copy(self)
        out.data, out.statuses, out.outputs, out.waits, out.frames = (dict(x) for x in (self.data, self.statuses, self.outputs, self.waits, self.frames))
        out.cancelled = _Linked()
        return out

    def get(self, key: str, kind: type, default: Any = None) -> Any:
        """The value if it is of the kind, else the default. An integer also reads as a float; a boolean is no number."""
        v = self.data.get(key)
        if kind is float and isinstance(v, int) and not isinstance(v, bool):
            return float(v)
        return v if isinstance(v, kind) and (kind is bool or not isinstance(v, bool)) else default

    def put_new(self, key: str, value: Any) -> None:
        """Stores a value under a key that is free or holds the same one; a foreign value is never replaced."""
        if key in self.data and self.data[key] != value:
            raise ValueError(f"{key!r} already holds another value")
        self.data[key] = value

    def value(self, key: str, default: Any = None) -> Any:
        return self.data.get(key, default)

    def put(self, key: str, value: Any) -> None:
        """Stores a value. A stored DataFrame under the key is no longer the run's."""
        self.frames.pop(("data", key), None)
        self.data[key] = value

    def drop(self, key: str) -> bool:
        self.frames.pop(("data", key), None)
        return self.data.pop(key, _NOTHING) is not _NOTHING

    def has(self, key: str) -> bool:
        return key in self.data

    def keys(self) -> list[str]:
        return sorted(self.data)

    def each(self, where: str, f) -> None:
        """Calls ``f(key, value)`` for what ``where`` (data, statuses, outputs or waits) holds now, in order of the keys; f may change it."""
        for k, v in sorted(dict(getattr(self, where)).items()):
            f(k, v)

    def rows(self, updated_at: int = 0) -> dict[tuple[str, str, str], dict]:
        """(table, run, key) -> columns, for the state tables."""
        out: dict[tuple[str, str, str], dict] = {("workflows", self.run_id, ""): {"rolling_back": self.rolling_back, "trigger_cause": CAUSES.index(self.cause), "updated_at": updated_at, "depth": self.depth}}
        data, statuses, outputs = (dict(x) for x in (self.data, self.statuses, self.outputs))  # other steps may be writing
        for where, key in list(self.frames):
            (data if where == "data" else outputs)[key] = {FRAME: self.frames[where, key]}
        for n in {*statuses, *outputs}:
            has = n in outputs and plain(outputs[n])
            out["nodes", self.run_id, n] = {"status": statuses.get(n, ""), "has_output": has, "output": json.dumps(outputs[n]) if has else None}
        for k, v in data.items():
            if plain(v):
                out["data_kv", self.run_id, k] = encode(v)
        for n, at in dict(self.waits).items():
            out["waits", self.run_id, n] = {"fire_at": at}
        return out

    @classmethod
    def from_rows(cls, run_id: str, rows) -> RunState:
        """rows: mappings with tbl, key and the columns of that table."""
        out = cls(run_id)
        for r in rows:
            if r["tbl"] == "workflows":
                out.rolling_back, out.cause, out.depth = r["rolling_back"], CAUSES[r["trigger_cause"]], r["depth"] or 0
            elif r["tbl"] == "nodes":
                if r["status"]:
                    out.statuses[r["key"]] = r["status"]
                if r["has_output"]:
                    out.outputs[r["key"]] = json.loads(r["output"])
            elif r["tbl"] == "data_kv":
                out.data[r["key"]] = decode(r)
            elif r["tbl"] == "waits":
                out.waits[r["key"]] = r["fire_at"]
        return out

    def restore(self, read) -> None:
        """Puts ``read(path)`` where a stored DataFrame was."""
        for where in ("data", "outputs"):
            values = getattr(self, where)
            for k, v in values.items():
                if isinstance(v, dict) and set(v) == {FRAME}:
                    self.frames[where, k] = v[FRAME]
                    values[k] = read(v[FRAME])

    def to_json(self) -> str:
        def keep(where: str) -> dict:
            values = dict(getattr(self, where))
            values |= {k: {FRAME: path} for (w, k), path in self.frames.items() if w == where}
            return {k: v for k, v in values.items() if plain(v)}

        return json.dumps({"id": self.run_id, "data": keep("data"), "statuses": self.statuses, "outputs": keep("outputs"), "waits": self.waits, "rolling_back": self.rolling_back, "cause": self.cause, "depth": self.depth}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RunState:
        d = json.loads(text)
        out = cls(d["id"], d["data"])
        out.statuses, out.outputs, out.waits = d["statuses"], d["outputs"], d["waits"]
        out.rolling_back, out.cause, out.depth = d["rolling_back"], d["cause"], d["depth"]
        return out

    def failed(self) -> list[str]:
        return sorted(n for n, s in self.statuses.items() if s in ("failed", "compensation_failed"))

    def complete(self) -> bool:
        return bool(self.statuses) and all(s in TERMINAL and s not in ("failed", "compensation_failed") for s in self.statuses.values())


class Capture:
    """What a run has changed since the last look, as change rows."""

    def __init__(self, state: RunState):
        self.state, self.image = state, state.rows()

    def drain(self, updated_at: int = 0) -> list[tuple[str, str, str, dict | None]]:
        """The changes, which the next look starts from; None instead of columns is a row that went."""
        now = self.state.rows(updated_at)
        out = [(*k, c) for k, c in now.items() if k not in self.image or not same_row(self.image[k], c)]
        out += [(*k, None) for k in self.image if k not in now]
        self.image = now
        return out


def same_row(a: dict | None, b: dict) -> bool:
    """Equal but for the time of writing; -0.0 differs from 0.0, and True from 1."""
    return a is not None and all(a.get(k) == v and str(a.get(k)) == str(v) for k, v in b.items() if k != "updated_at")


def valid_id(text: str) -> bool:
    """One path segment that can't leave its folder."""
    return bool(text) and text not in (".", "..") and not any(c in text for c in "/\\\0")


def plain(v: Any) -> bool:
    """Whether a value can be stored."""
    if v is None or isinstance(v, (bool, int, float, str)):
        return True
    if isinstance(v, (list, tuple)):
        return all(map(plain, v))
    return isinstance(v, dict) and all(isinstance(k, str) and plain(x) for k, x in v.items())


def encode(v: Any) -> dict:
    if isinstance(v, bool):
        return {"kind": KINDS["boolean"], "i_val": int(v)}
    if isinstance(v, int) and -(1 << 63) <= v < 1 << 63:
        return {"kind": KINDS["integer"], "i_val": v}
    if isinstance(v, float):
        return {"kind": KINDS["double"], "f_val": v}
    if isinstance(v, str):
        return {"kind": KINDS["string"], "s_val": v}
    return {"kind": KINDS["json"], "s_val": json.dumps(v)}


def decode(r) -> Any:
    kind = r["kind"]
    return (r["i_val"], bool(r["i_val"]), r["f_val"], r["s_val"], json.loads(r["s_val"]) if kind == KINDS["json"] else None)[kind]
