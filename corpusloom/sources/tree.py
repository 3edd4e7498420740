"""Directory trees of a file system that all executors mount, as a Python data source.

A task lists directories breadth first and gives one row for each file and link, those without bytes and those that lead nowhere
included. After `budget` entries it stops going down and gives the directories that it has not listed as pending; these are dealt
out anew to all tasks, until none is left. So a subtree that holds most of a tree is no task of its own, the number of rounds
grows with the logarithm of a tree's size and not with its depth, and no list of directories comes to the driver.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import stat
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from corpusloom.sources.corpus import written

NAME = "file_tree"
#: kind: file, link, directory (if asked for), absent (a root that isn't there), error (a directory that can't be listed, and why).
#: size of a link: the bytes of its target. created_ns: where the file system tells no birth time, the time of the last change.
TREE = "path string, kind string, size long, mode int, inode long, n_links long, mtime_ns long, changed_ns long, created_ns long, target string, error string"
#: Entries after which a task gives the rest of its directories back; rows of a batch.
BUDGET, BATCH = 50_000, 8192
_ARROW = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for c, t in (f.split() for f in TREE.split(", "))])


def _shown(path: str) -> str:
    """Names are bytes; what is not UTF-8 is shown as U+FFFD."""
    return os.fsencode(path).decode("utf-8", "replace")


def _entry(path: str, kind: str, st: os.stat_result) -> tuple:
    born = getattr(st, "st_birthtime", None)
    created = st.st_ctime_ns if not born else int(born * 1_000_000_000)
    target = _shown(os.readlink(path)) if kind == "link" else None
    return (_shown(path), kind, st.st_size, stat.S_IMODE(st.st_mode), st.st_ino, st.st_nlink, st.st_mtime_ns, st.st_ctime_ns, created, target, None)


def _bare(path: str, kind: str, error: str | None = None) -> tuple:
    return (_shown(path), kind, *[None] * 8, error)


def _kind(st: os.stat_result) -> str | None:
    """Sockets, pipes and devices have none, and are left out."""
    return "link" if stat.S_ISLNK(st.st_mode) else "directory" if stat.S_ISDIR(st.st_mode) else "file" if stat.S_ISREG(st.st_mode) else None


def walk(tops: Iterable[str], prune: frozenset[str], directories: bool, one_file_system: bool, budget: int) -> Iterator[tuple]:
    """Rows below directories, breadth first; those that `budget` leaves out are pending. Links are not followed, and neither are
    mounts of other file systems if one_file_system. What goes away meanwhile has no row."""
    left = budget
    queue: deque[str] = deque()
    for top in tops:
        queue.append(top)
        if left <= 0:
            yield _bare(queue.popleft(), "pending")
            continue
        while queue and left > 0:
            home = queue.popleft()
            try:
                device = os.lstat(home).st_dev
                with os.scandir(home) as entries:
                    for entry in entries:
                        left -= 1
                        try:
                            st = entry.stat(follow_symlinks=False)
                            kind = _kind(st)
                            if kind == "directory":
                                if entry.path in prune or one_file_system and st.st_dev != device:
                                    continue
                                queue.append(entry.path)
                            if kind and (directories or kind != "directory"):
                                yield _entry(entry.path, kind, st)
                        except FileNotFoundError:
                            continue
            except FileNotFoundError:
                if "\ufffd" in home:  # a name that was shown otherwise than it is
                    yield _bare(home, "error", "the name is not UTF-8")
            except OSError as e:
                yield _bare(home, "error", e.strerror)
        for rest in queue:
            yield _bare(rest, "pending")
        queue.clear()


def _root(path: str, prune: frozenset[str], directories: bool, *how) -> Iterator[tuple]:
    try:
        st = os.lstat(path)
    except OSError:
        yield _bare(path, "absent")
        return
    kind = _kind(st)
    if kind == "directory":
        if directories:
            yield _entry(path, kind, st)
        yield from walk([path], prune, directories, *how)
    elif kind:
        yield _entry(path, kind, st)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class Root(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [r.rstrip("/") or "/" for r in json.loads(options["roots"])]
        self.how = (frozenset(json.loads(options.get("prune", "[]"))), options.get("directories", "false").lower() == "true", options.get("onefilesystem", "true").lower() == "true", int(options.get("budget", BUDGET)))

    def partitions(self) -> list[InputPartition]:
        """A task for each root that lies below no other."""
        distinct = sorted(set(self.roots))
        return [Root(r) for r in distinct if not any(r != a and r.startswith(a.rstrip("/") + "/") for a in distinct)]

    def read(self, partition: Root) -> Iterator[pa.RecordBatch]:
        return _batches(_root(partition.path, *self.how))


class TreeSource(DataSource):
    """spark.read.format("file_tree") with options roots (a JSON list), prune (a JSON list of directories that are not entered),
    directories, oneFileSystem and budget: one round of a scan, with its pending directories. scan_tree() makes all rounds."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def scan_tree(spark: SparkSession, roots: list[str], prune: list[str] = (), directories: bool = False, one_file_system: bool = True, budget: int = BUDGET) -> DataFrame:
    """A row (TREE) for each file and link below the roots, and for roots that are files, links or absent.

    prune: absolute directories that are not entered. The roots must be mounted at the same place on all executors. An empty
    directory gives no rows. Rows of a round are written once, since listing again could give other ones.
    """
    spark.dataSource.register(TreeSource)
    options = {"roots": json.dumps(list(roots)), "prune": json.dumps(list(prune)), "directories": str(directories), "oneFileSystem": str(one_file_system), "budget": str(budget)}
    how = TreeReader({k.lower(): v for k, v in options.items()}).how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(walk((p for b in batches for p in b.column(0).to_pylist()), *how))

    now = written(spark.read.format(NAME).options(**options).load())
    rounds = []
    while True:
        rounds.append(now.filter("kind <> 'pending'"))
        pending = now.filter("kind = 'pending'").select("path")
        waiting = pending.count()
        if not waiting:
            break
        tasks = min(waiting, 4 * spark.sparkContext.defaultParallelism)
        now = written(pending.repartition(tasks, "path").mapInArrow(run, TREE))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def read_bytes(files: DataFrame, most: int | None = None) -> DataFrame:
    """files (path, kind, ...) with content: the bytes of files, the target of links; null for what is gone, or above most bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, kinds = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "kind"))
            for low in range(0, len(paths), 256):  # contents of so many files are held at once
                found = [_bytes(p, k, most) for p, k in zip(paths[low : low + 256], kinds[low : low + 256])]
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "content"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def _bytes(path: str, kind: str, most: int | None) -> bytes | None:
    try:
        if kind == "link":
            return os.fsencode(os.readlink(path))
        if kind != "file" or most is not None and os.stat(path).st_size > most:
            return None
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def write_tree(entries: DataFrame) -> int:
    """Makes entries (path, kind, content, target, mode, mtime_ns) on a file system that all executors mount; how many there are.

    kind: file (content, null for none), link (to target), or hard (another name of the file at target, which must exist). A
    task that runs again makes the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, content, target, mode, mtime in zip(*(c.to_pylist() for c in batch.columns)):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                new = f"{path}.{os.getpid()}.new"
                if kind == "link":
                    os.symlink(target, new)
                elif kind == "hard":
                    os.link(target, new)
                else:
                    with open(new, "wb") as f:
                        f.write(content or b"")
                if mode is not None and kind == "file":
                    os.chmod(new, mode)
                if mtime is not None and kind != "hard":
                    os.utime(new, ns=(mtime, mtime), follow_symlinks=False)
                os.replace(new, path)
                if kind == "hard" and os.path.lexists(new):  # replacing a name of the same file does nothing
                    os.unlink(new)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    made = entries.select("path", "kind", F.col("content").cast("binary"), "target", F.col("mode").cast("int"), F.col("mtime_ns").cast("long")).mapInArrow(run, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def remove_tree(spark: SparkSession, root: str) -> None:
    """Removes a mounted directory and all below it. Directories are dealt to tasks by a hash, since those who remove from the same one
    wait for each other; the driver removes what is left, which is directories alone."""
    slices = 4 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                for home, _, names in os.walk(root):
                    if zlib.crc32(os.fsencode(home)) % slices == number:
                        for name in names:
                            with contextlib.suppress(FileNotFoundError):
                                os.unlink(os.path.join(home, name))
            yield batch

    spark.range(0, slices, 1, slices).mapInArrow(run, "id long").count()
    shutil.rmtree(root, ignore_errors=True)
