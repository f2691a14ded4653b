"""A folder as a streaming source whose offsets are its listings, and files that have come to rest by timers."""

from __future__ import annotations

import fnmatch
import hashlib
import time
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "name string, seq long, size long, fingerprint string"
FILES_A_TASK = 256
BLOCK = 1 << 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Files(InputPartition):
    def __init__(self, seq: int, files: list[tuple[str, int]]):
        self.seq, self.files = seq, files


class _Listings(DataSourceStreamReader):
    """Each poll is an offset: its time and what the folder listed, as name to size and time of change.

    A listing that equals the last one is a poll too, since rest is seen by looking again. Contents are read by the tasks
    alone. A batch that runs again after a restart has the files of its own listing; one that has gone since gives no row.
    """

    def __init__(self, path: str, glob: str, every: float):
        self.path, self.glob, self.every = path, glob, every
        self.last: dict | None = None

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": 0, "files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        now = time.time_ns() // 1_000_000
        if self.last is None or now - self.last["seq"] >= self.every * 1000:
            store, root = self._store()
            found = store.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
            files = {f.base_name: [f.size, f.mtime_ns] for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, self.glob)}
            self.last = {"seq": now, "files": dict(sorted(files.items()))}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["seq"] == start["seq"]:
            return []
        files = [(name, size) for name, (size, _) in end["files"].items()]
        return [_Files(end["seq"], files[k : k + FILES_A_TASK]) for k in range(0, len(files), FILES_A_TASK)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, root = self._store()
        for name, _ in partition.files:
            digest, size = hashlib.sha256(), 0
            try:
                with store.open_input_stream(f"{root.rstrip('/')}/{name}") as f:
                    while block := f.read(BLOCK):
                        digest.update(block)
                        size += len(block)
            except FileNotFoundError:
                continue
            yield name, partition.seq, size, digest.hexdigest()

    def commit(self, end: dict) -> None:
        """Offsets hold all there is to keep."""


class FolderSource(DataSource):
    """``folder``: options path (a folder, or the URI of one), glob, and poll, the seconds between two looks at it."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Listings(self.options["path"], self.options.get("glob", "*"), float(self.options.get("poll", "1")))


def observations(spark: SparkSession, path: str, glob: str = "*", poll: float = 1.0) -> DataFrame:
    """A stream of (name, seq, size, fingerprint): every file of the folder at every poll, with the hash of its content."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder").option("path", path).option("glob", glob).option("poll", str(poll)).load()


class _Rest(StatefulProcessor):
    """Tells a file once when it has not changed for a while; a change, or a new file of the same name, starts anew."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seq long, size long, fingerprint string, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = pd.concat(list(rows)).sort_values("seq")
        last = self.seen.get() if self.seen.exists() else None
        for row in seen.itertuples():
            if last is None or last[2] != row.fingerprint:
                last = (int(row.seq), int(row.size), row.fingerprint, False)
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        self.seen.update(last)
        yield pd.DataFrame(columns=["name", "seq", "size", "fingerprint"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, size, fingerprint, told = self.seen.get()
        if not told:
            self.seen.update((seq, size, fingerprint, True))
            yield pd.DataFrame([(key[0], seq, size, fingerprint)], columns=["name", "seq", "size", "fingerprint"])

    def close(self) -> None:
        """Nothing is open."""


def at_rest(observed: DataFrame, quiet_ms: int = 60_000) -> DataFrame:
    """From ``observations``: (name, seq, size, fingerprint) of each content once nothing about it has changed for ``quiet_ms``;
    ``seq`` is the poll that first saw it.

    One state a name, in a store on disk; a timer fires even when the file gives no new row. The session's state stores
    must be RocksDB (``ROCKSDB``), which timers need.
    """
    return observed.groupBy("name").transformWithStateInPandas(_Rest(quiet_ms), SCHEMA, "append", "processingTime")
