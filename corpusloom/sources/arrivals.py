"""Files as they appear below a directory that driver and executors mount, as a streaming Python data source.

Paths are dealt into slices by a hash. A task has one slice: it lists names, takes away those that its slice's log of the batch before
has, writes the log of this batch, and reads what is left. So neither paths nor the list of what was seen come to the driver, which
only sums up the names, to tell whether there are other ones than before. A batch that runs again gives what its log says.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpusloom.sources.tree import _shown

NAME = "file_arrivals"
SCHEMA = "path string, size long, mtime_ns long, content binary"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("content", pa.binary())])
#: Files of a batch of rows, and their bytes, about.
FILES, BYTES = 256, 4 << 20


def _hidden(name: str) -> bool:
    """What Spark's file sources don't see."""
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def names(directory: str, above: tuple = ()) -> Iterator[bytes]:
    """The paths of the files below a directory, through links too, but not in circles."""
    try:
        st = os.stat(directory)
        with os.scandir(directory) as entries:
            if (me := (st.st_dev, st.st_ino)) in above:
                return
            for entry in entries:
                if _hidden(entry.name):
                    continue
                if entry.is_dir():
                    yield from names(entry.path, (*above, me))
                elif entry.is_file():
                    yield os.fsencode(entry.path)
    except FileNotFoundError:
        if not above:
            raise


def _read(path: bytes) -> tuple | None:
    """None for what is gone, and for files without bytes. These are left out, and times told in milliseconds, as by Spark's file sources."""
    try:
        with open(path, "rb") as f:
            st, content = os.fstat(f.fileno()), f.read()
    except FileNotFoundError:
        return None
    return (_shown(os.fsdecode(path)), len(content), st.st_mtime_ns // 1_000_000 * 1_000_000, content) if content else None


def _rows(paths: list[bytes]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for path in paths:
        if (row := _read(path)) is None:
            continue
        held.append(row)
        size += row[1]
        if len(held) == FILES or size >= BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _logged(path: str) -> set[bytes]:
    with open(path, "rb") as f:
        return set(f.read().split(b"\0")) - {b""}


class Slice(InputPartition):
    def __init__(self, number: int, slices: int, before: str | None, now: str):
        self.number, self.slices, self.before, self.now = number, slices, before, now


class ArrivalsReader(DataSourceStreamReader):
    """Offsets: the log of a batch (a folder with a file for each slice), how many slices it has, and what the names summed up to."""

    def __init__(self, options: dict[str, str]):
        self.directory, self.log, self.slices = options["directory"].rstrip("/") or "/", options["log"], int(options["slices"])
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"log": None}

    def latestOffset(self) -> dict:
        n = total = 0
        for path in names(self.directory):
            n, total = n + 1, (total + (zlib.crc32(path) << 32 | zlib.adler32(path))) % (1 << 63)
        if self.last is None or self.last["names"] != [n, total]:
            self.last = {"log": f"{self.log}/{uuid.uuid4().hex}", "slices": self.slices, "names": [n, total]}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = start["log"], end["log"]
        if before == now:  # asked for when a stream goes on
            return []
        if before is not None and not os.path.isdir(before):
            raise RuntimeError(f"{before}, which says what has come so far, is gone")
        slices = end["slices"]
        if before is not None:
            with open(f"{before}/about") as f:
                slices = json.load(f)["slices"]  # those of the first batch
        os.makedirs(now, exist_ok=True)
        with open(f"{now}/about", "w") as f:
            json.dump({"slices": slices, "before": before}, f)
        return [Slice(k, slices, before, now) for k in range(slices)]

    def commit(self, end: dict) -> None:
        """The log before the last but one is needed no more."""
        older = [end["log"]]
        while len(older) < 3 and older[-1] is not None and os.path.exists(f"{older[-1]}/about"):
            with open(f"{older[-1]}/about") as f:
                older.append(json.load(f)["before"])
        if len(older) == 3 and older[2] is not None:
            shutil.rmtree(older[2], ignore_errors=True)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        seen = _logged(f"{partition.before}/{partition.number}") if partition.before else set()
        log = f"{partition.now}/{partition.number}"
        if not os.path.exists(log):
            listed = {p for p in names(self.directory) if zlib.crc32(p) % partition.slices == partition.number}
            mine = f"{log}.{uuid.uuid4().hex}.new"
            with open(mine, "wb") as f:
                f.write(b"\0".join(sorted(listed | seen)))
            try:
                os.link(mine, log)  # of two tasks the first one's holds
            except FileExistsError:
                pass
            os.unlink(mine)
        yield from _rows(sorted(_logged(log) - seen))


class Arrivals(DataSource):
    """spark.readStream.format("file_arrivals") with options directory, log (a mounted folder that outlives the stream's runs) and
    slices (those of a checkpoint's first batch stay)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ArrivalsReader:
        return ArrivalsReader({k.lower(): v for k, v in self.options.items()})
