"""One file a run in a folder that is shared: readable (JSON) or compact (an Arrow stream of the run's rows), with a mailbox beside it.

A file is written whole under another name and then renamed over the old one, so a reader sees the old run or the new one. Damaged
files raise ``Corrupt``; they are never read as an empty run. For many runs at once see ``read_json_runs`` and the table store.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.readmodel import STATUSES
from millrace.plans.state import RunState, valid_id
from millrace.sources.store import Missing

#: Signals that a mailbox may hold; a fuller one is refused, not cut.
MAILBOX = 1 << 16


class Corrupt(ValueError):
    """A file that is not what it should be."""


def status_code(status: str) -> int:
    """A status as a number from 1 on, in the order of STATUSES; 0 is no status."""
    return STATUSES.index(status) + 1 if status else 0


def status_of(code: int) -> str:
    if not 0 <= code <= len(STATUSES):
        raise Corrupt(f"no status has the code {code}")
    return STATUSES[code - 1] if code else ""


def payload_text(payload: Any) -> str:
    """A signal's payload as text: JSON, and nothing for None."""
    return "" if payload is None else json.dumps(payload)


def payload_of(text: str) -> Any:
    try:
        return None if text == "" else json.loads(text)
    except ValueError as e:
        raise Corrupt(f"a payload that can't be read: {e}") from e


class JsonCodec:
    """Runs and signals as JSON objects."""

    suffix = "json"

    def run(self, state: RunState) -> bytes:
        return state.to_json().encode()

    def run_of(self, data: bytes) -> RunState:
        try:
            return RunState.from_json(data.decode())
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise Corrupt(f"a run that can't be read: {e}") from e

    def signal(self, sig_id: str, name: str, payload: str) -> bytes:
        return json.dumps({"id": sig_id, "name": name, "payload": payload}).encode()

    def signal_of(self, data: bytes) -> tuple[str, str, str]:
        try:
            d = json.loads(data)
            return d["id"], d["name"], d["payload"]
        except (ValueError, KeyError, TypeError) as e:
            raise Corrupt(f"a signal that can't be read: {e}") from e


class ArrowCodec:
    """Runs as rows (table, key, status code, JSON of the other columns), signals as one row."""

    suffix = "arrows"
    RUN = pa.schema([("run", pa.string()), ("tbl", pa.string()), ("key", pa.string()), ("status", pa.uint8()), ("rest", pa.string())])
    SIGNAL = pa.schema([("id", pa.string()), ("name", pa.string()), ("payload", pa.string())])

    @staticmethod
    def _bytes(rows: list[tuple], schema: pa.Schema) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def _rows(data: bytes, schema: pa.Schema) -> list[dict]:
        try:
            table = pa.ipc.open_stream(data).read_all()
            table.validate(full=True)
        except (pa.ArrowInvalid, OSError, EOFError) as e:
            raise Corrupt(f"not an Arrow stream: {e}") from e
        if not table.schema.equals(schema):
            raise Corrupt("the stream has other columns")
        return table.to_pylist()

    def run(self, state: RunState) -> bytes:
        rows = []
        for (tbl, run, key), columns in state.rows().items():
            status = status_code(columns.get("status", "")) if tbl == "nodes" else None
            rows.append((run, tbl, key, status, json.dumps({k: v for k, v in columns.items() if k != "status"})))
        return self._bytes(rows, self.RUN)

    def run_of(self, data: bytes) -> RunState:
        rows = self._rows(data, self.RUN)
        if len({r["run"] for r in rows}) != 1:
            raise Corrupt("not the rows of one run")
        try:
            full = [{"tbl": r["tbl"], "key": r["key"], **json.loads(r["rest"]), **({"status": status_of(r["status"])} if r["tbl"] == "nodes" else {})} for r in rows]
            for r in full:
                if r["tbl"] == "data_kv":
                    r.update({k: r.get(k) for k in ("i_val", "f_val", "s_val")})
            return RunState.from_rows(rows[0]["run"], full)
        except (ValueError, KeyError, TypeError) as e:
            raise Corrupt(f"a run that can't be read: {e}") from e

    def signal(self, sig_id: str, name: str, payload: str) -> bytes:
        return self._bytes([(sig_id, name, payload)], self.SIGNAL)

    def signal_of(self, data: bytes) -> tuple[str, str, str]:
        rows = self._rows(data, self.SIGNAL)
        if len(rows) != 1 or not rows[0]["id"]:
            raise Corrupt("not one signal")
        return rows[0]["id"], rows[0]["name"] or "", rows[0]["payload"] or ""


class FileStore:
    """Runs by id in a folder. No leases: one process drives a run at a time."""

    def __init__(self, spark: SparkSession, folder: str, codec: JsonCodec | ArrowCodec | None = None):
        self.spark, self.folder, self.codec = spark, folder.rstrip("/"), codec or JsonCodec()
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"
        self._fs.mkdirs(self._path(f"{self.folder}/runs"))

    # ---- files ------------------------------------------------------------------------------------------------------

    def _file(self, run_id: str) -> str:
        if not valid_id(run_id):
            raise ValueError(f"not a run id: {run_id!r}")
        return f"{self.folder}/runs/{quote(run_id, safe='')}.{self.codec.suffix}"

    def _box(self, run_id: str) -> str:
        if not valid_id(run_id):
            raise ValueError(f"not a run id: {run_id!r}")
        return f"{self.folder}/signals/{quote(run_id, safe='')}"

    def _write(self, path: str, data: bytes) -> None:
        temporary = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(temporary), True)
        stream.write(bytearray(data))
        if hasattr(stream, "hsync"):
            stream.hsync()
        stream.close()
        if self._local:
            os.replace(*(self._path(p).toUri().getPath() for p in (temporary, path)))
            return
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri()).rename(self._path(temporary), self._path(path), options)

    def _read(self, path: str) -> bytes | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        found = (f.getPath().getName() for f in self._fs.listStatus(self._path(folder)))
        return sorted(n for n in found if not n.startswith("."))

    # ---- runs and signals -------------------------------------------------------------------------------------------

    def save(self, state: RunState, now: int = 0, token: int | None = None) -> None:
        self._write(self._file(state.run_id), self.codec.run(state))

    def load(self, run_id: str) -> RunState:
        data = self._read(self._file(run_id))
        if data is None:
            raise Missing(run_id)
        state = self.codec.run_of(data)
        if state.run_id != run_id:
            raise Corrupt(f"the file of {run_id!r} holds {state.run_id!r}")
        state.restore(self.spark.read.parquet)
        return state

    def keep(self, run_id: str, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.folder}/frames/{quote(run_id, safe='')}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def list(self) -> list[str]:
        end = f".{self.codec.suffix}"
        return sorted(unquote(n.removesuffix(end)) for n in self._names(f"{self.folder}/runs") if n.endswith(end))

    def delete(self, run_id: str) -> None:
        """The run, its mailbox and its stored DataFrames; deleting what is not there is no error."""
        for p in (self._file(run_id), self._box(run_id), f"{self.folder}/frames/{quote(run_id, safe='')}"):
            self._fs.delete(self._path(p), True)

    def deliver(self, run_id: str, sig_id: str, name: str, payload: str, now: int = 0) -> None:
        if not valid_id(sig_id):
            raise ValueError(f"not a signal id: {sig_id!r}")
        self._write(f"{self._box(run_id)}/{quote(sig_id, safe='')}", self.codec.signal(sig_id, name, payload))

    def signals(self, run_id: str) -> list[tuple[str, str, str]]:
        names = self._names(self._box(run_id))
        if len(names) > MAILBOX:
            raise Corrupt(f"{len(names)} signals wait for {run_id!r}")
        return sorted(self.codec.signal_of(self._read(f"{self._box(run_id)}/{n}") or b"") for n in names)

    def acknowledge(self, run_id: str, *sig_ids: str) -> None:
        for s in sig_ids:
            self._fs.delete(self._path(f"{self._box(run_id)}/{quote(s, safe='')}"), False)


def migrate(spark: SparkSession, folder: str, clean_up: bool = False) -> int:
    """Rewrites the JSON runs of a folder as Arrow streams; with ``clean_up`` the JSON files go, each after its stream is written and reads
    back the same. The number of runs."""
    old, new, n = FileStore(spark, folder, JsonCodec()), FileStore(spark, folder, ArrowCodec()), 0
    for run_id in old.list():
        state = old.codec.run_of(old._read(old._file(run_id)))
        new.save(state)
        if new.codec.run_of(new._read(new._file(run_id))).to_json() != state.to_json():
            raise Corrupt(f"{run_id!r} reads back otherwise")
        if clean_up:
            old._fs.delete(old._path(old._file(run_id)), False)
        n += 1
    return n
