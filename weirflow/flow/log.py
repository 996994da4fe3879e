"""Checkpoint logs: in memory, as files in a folder that all machines share, or as a table of a database."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from weirflow.flow.errors import CheckpointConflict
from weirflow.operators.recovery import COMPLETION, CURSOR, ENTRY  # noqa: F401


@dataclass(frozen=True)
class Row:
    sequence: int
    state: str
    task_id: str
    kind: int = ENTRY
    blob: str | None = None
    workflow_version: int = 0


class MemoryLog:
    def __init__(self) -> None:
        self.runs: dict[str, dict[int, Row]] = {}
        self._lock = threading.Lock()

    def append(self, run: str, row: Row) -> None:
        with self._lock:
            rows = self.runs.setdefault(run, {})
            if row.sequence in rows:
                raise CheckpointConflict(f"{run} already has row {row.sequence}")
            rows[row.sequence] = row

    def load(self, run: str) -> list[Row]:
        with self._lock:
            return [r for _, r in sorted(self.runs.get(run, {}).items())]

    def clear(self, run: str) -> None:
        with self._lock:
            self.runs.pop(run, None)


class FileLog:
    """One small file a row, named by its sequence number, in a folder for each run, in any store that Spark reaches.

    A row is written by creating its file, which fails if it is there, so of two writers of one
    sequence number one succeeds: in a mounted folder by a link to a whole file, elsewhere by the store's own
    creation without overwriting. A run's folder is dropped when it succeeds.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, run: str, name: str = ""):
        quoted = "".join(c if c.isalnum() or c in "-_." else f"%{ord(c):x}" for c in run)
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={quoted}" + (f"/{name}" if name else ""))
        return p, p.getFileSystem(self._conf)

    def append(self, run: str, row: Row) -> None:
        p, fs = self._at(run, f"{row.sequence:019d}.json")
        data = json.dumps(asdict(row)).encode()
        if fs.getScheme() == "file":
            return self._link(p.toUri().getPath(), data, run, row)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise CheckpointConflict(f"{run} already has row {row.sequence}") from e
            raise
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    @staticmethod
    def _link(path: str, data: bytes, run: str, row: Row) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        whole = f"{path}.{uuid.uuid4().hex}"
        with open(whole, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(whole, path)
        except FileExistsError as e:
            raise CheckpointConflict(f"{run} already has row {row.sequence}") from e
        finally:
            os.unlink(whole)

    def load(self, run: str) -> list[Row]:
        p, fs = self._at(run)
        if not fs.exists(p):
            return []
        rows = []
        for status in fs.listStatus(p):
            if not status.getPath().getName().endswith(".json") or not status.getLen():
                continue
            stream = fs.open(status.getPath())
            try:
                rows.append(Row(**json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))))
            finally:
                stream.close()
        return sorted(rows, key=lambda r: r.sequence)

    def clear(self, run: str) -> None:
        p, fs = self._at(run)
        fs.delete(p, True)

    def frame(self) -> DataFrame:
        """All runs' rows as a table, for the recovery queries."""
        schema = "sequence long, state string, task_id string, kind int, blob string, workflow_version long"
        return self.spark.read.schema(schema).json(f"{self.path}/*/*.json").selectExpr("regexp_extract(input_file_name(), 'run=([^/]+)', 1) as workflow_id", "*")


ParquetLog = FileLog


class SqlLog:
    """A table of a database reached by a Python driver (DB-API); its key (workflow_id, sequence) refuses a taken number."""

    def __init__(self, connect: Callable, table: str = "checkpoints", mark: str = "?") -> None:
        self.connect, self.table, self.mark = connect, table, mark

    def create(self) -> SqlLog:
        self._do(
            f"CREATE TABLE IF NOT EXISTS {self.table} (workflow_id VARCHAR(512) NOT NULL, sequence BIGINT NOT NULL, state VARCHAR(512) NOT NULL, task_id VARCHAR(512) NOT NULL, "
            "kind SMALLINT NOT NULL, output_blob TEXT, workflow_version BIGINT NOT NULL, PRIMARY KEY (workflow_id, sequence))"
        )
        return self

    def _do(self, sql: str, *values) -> list[tuple]:
        con = self.connect()
        try:
            cur = con.cursor()
            cur.execute(sql.replace("?", self.mark), values)
            rows = cur.fetchall() if cur.description else []
            con.commit()
            return rows
        except Exception:
            con.rollback()
            raise
        finally:
            con.close()

    def append(self, run: str, row: Row) -> None:
        try:
            self._do(f"INSERT INTO {self.table} VALUES (?, ?, ?, ?, ?, ?, ?)", run, row.sequence, row.state, row.task_id, row.kind, row.blob, row.workflow_version)
        except Exception as e:
            if self._do(f"SELECT 1 FROM {self.table} WHERE workflow_id = ? AND sequence = ?", run, row.sequence):
                raise CheckpointConflict(f"{run} already has row {row.sequence}") from e
            raise

    def load(self, run: str) -> list[Row]:
        return [Row(*r) for r in self._do(f"SELECT sequence, state, task_id, kind, output_blob, workflow_version FROM {self.table} WHERE workflow_id = ? ORDER BY sequence", run)]

    def clear(self, run: str) -> None:
        self._do(f"DELETE FROM {self.table} WHERE workflow_id = ?", run)
