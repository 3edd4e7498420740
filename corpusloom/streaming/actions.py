"""Streams of actions: parsing lines, and emitting results in order."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import identity
from corpusloom.sources import arrivals, corpus

LINE = r"^[\x00-\x20]*\[([^\]]*)\](.)(.*)$"
ACTIONS = ("clone", "copy", "move", "hardlink", "symlink", "create", "delete", "edit", "read", "list", "tree", "info", "glob", "execute", "echo", "start", "wait")


def parse(lines: DataFrame, known: tuple[str, ...] = ACTIONS) -> DataFrame:
    """lines (value, ...) with action, options, fields and error. `[name key=value ...]`, then a separator, then fields between
    separators. Stateless: the same on a batch and on a stream. A line that doesn't parse keeps its value and has an error."""
    head, separator, rest = (F.regexp_extract("value", LINE, i) for i in (1, 2, 3))
    tokens = F.filter(F.split(F.trim(head), " +"), lambda x: x != "")
    name = F.lower(F.try_element_at(tokens, F.lit(1)))
    given = F.filter(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(0))), lambda t: t.contains("="))
    pairs = F.transform(given, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.regexp_replace(t, "^[^=]*=", "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"]
    options = F.map_from_arrays(keys, F.transform(keys, last))  # of an option that is given twice the last one counts
    quoted = F.concat(F.lit("\\Q"), separator, F.lit("\\E"))
    ok = F.col("value").rlike(LINE)
    error = F.when(~ok, "malformed line").when(name.isNull(), "no action").when(~name.isin(*known), "unknown action")
    return lines.withColumns({"action": F.when(ok, name), "options": F.when(ok, options), "fields": F.when(ok, F.split(rest, quoted)), "error": error})


def sink(parsed: DataFrame, good: str, bad: str, checkpoint: str, strict: bool = False):
    """Writes a parsed stream: rows without error to good, the others to bad with their error. Strict: a micro-batch that holds
    a malformed line fails the query before anything of it is written."""

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.persist()
        try:
            wrong = rows.filter("error is not null")
            if strict and not wrong.isEmpty():
                raise ValueError(f"batch {n}: {wrong.first()['error']}")
            rows.filter("error is null").drop("error").write.mode("append").json(good)
            wrong.select("value", "error").write.mode("append").json(bad)
        finally:
            rows.unpersist()

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Tasks that a batch of arriving files is dealt to, at most.
MOST_SLICES = 256


def arriving(spark: SparkSession, directory: str, algorithm: str = "sha256") -> DataFrame:
    """(path, size, mtime_ns, hash) of files as they appear below a directory, each path once: a stream without state.

    If the directory and spark.checkpoint.dir are mounted, tasks list and read what is new, and what has come is logged below the
    latter, which a stream that goes on from its checkpoint needs. Otherwise Spark's file source does it, in which all paths go
    through the driver.
    """
    log = f"{corpus.shared_dir(spark)}/corpusloom/arrived"
    mounted = [re.sub("^file:/*", "/", p) for p in (directory, log)]
    if all(p.startswith("/") for p in mounted):
        spark.dataSource.register(arrivals.Arrivals)
        slices = min(MOST_SLICES, 4 * spark.sparkContext.defaultParallelism)
        files = spark.readStream.format(arrivals.NAME).options(directory=mounted[0], log=mounted[1], slices=str(slices)).load()
        return files.select("path", "size", "mtime_ns", identity.content_hash(F.col("content"), algorithm).alias("hash"))
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(directory)
    path = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    return files.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), identity.content_hash(F.col("content"), algorithm).alias("hash"))


def typed_option(options, key: str, kind: str):
    """An option as boolean, bigint or string; null if absent or of another kind."""
    v = F.try_element_at(options, F.lit(key))
    return F.lower(v).try_cast("boolean") if kind == "boolean" else v.try_cast(kind)


def _drained(waiting: dict[int, str | None], expected: int, over_gaps: bool) -> tuple[int, list[tuple[int, str]]]:
    """What can be emitted of waiting, which is taken out of it, and the index that is expected then. Over gaps, the indexes are sorted
    once: to look for the least of those left, again and again, costs the square of a batch."""
    out, order = [], iter(sorted(waiting) if over_gaps else ())
    while waiting and (over_gaps or expected in waiting):
        i = next(order) if over_gaps else expected
        text = waiting.pop(i)
        expected = i + 1
        if text is not None:
            out.append((i, text))
    return expected, out


def in_order(rows: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """rows (batch, action_index, text, kind) to (batch, action_index, text, late), each batch in the order of its index.

    kind 'item' holds its place until all before it came, 'none' only moves the counter, 'end' closes the batch: what is left
    is emitted over its gaps. A row whose index has passed is emitted at once, as late. A batch that stays silent is closed by
    the timeout, so its state is bounded.
    """
    minutes = int(timeout.split()[0]) * 60_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        waiting: dict[int, str | None] = {}
        expected = 0
        if state.exists:
            expected, indexes, texts = state.get
            waiting = dict(zip(indexes, texts))
        closed = state.hasTimedOut

        if not closed:
            for pdf in batches:
                for i, text, kind in zip(pdf["action_index"], pdf["text"], pdf["kind"]):
                    if kind == "end":
                        closed = True
                    elif i < expected:
                        out.append((key[0], int(i), text, True))
                    else:
                        waiting[int(i)] = None if kind == "none" else text
        expected, ready = _drained(waiting, expected, closed)
        out.extend((key[0], i, text, False) for i, text in ready)
        if closed:
            if state.exists:
                state.remove()
        else:
            state.update((expected, list(waiting), list(waiting.values())))
            state.setTimeoutDuration(minutes)
        yield pd.DataFrame(out, columns=["batch", "action_index", "text", "late"])

    return rows.groupBy("batch").applyInPandasWithState(step, "batch string, action_index long, text string, late boolean", "expected long, indexes array<long>, texts array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def emitted(rows: DataFrame) -> DataFrame:
    """The batch form of in_order(): the texts of rows (batch, action_index, text, kind) in the order of batch and index."""
    return rows.filter("kind = 'item'").select("batch", "action_index", "text").orderBy("batch", "action_index")


def changes(arrivals: DataFrame, snapshot: DataFrame) -> DataFrame:
    """arrivals (path, hash, ...) of a stream with change against a snapshot (path, hash): added, modified or same. A stream-static
    join: the snapshot is read anew for each micro-batch."""
    old = snapshot.select("path", F.col("hash").alias("__old"), F.lit(True).alias("__there"))
    same = F.coalesce(F.col("hash") == F.col("__old"), F.lit(False))
    change = F.when(F.col("__there").isNull(), "added").when(same, "same").otherwise("modified")
    return arrivals.join(old, "path", "left").withColumn("change", change).drop("__old", "__there")


def append_memo(stream: DataFrame, path: str, checkpoint: str):
    """Appends the records (file_key, stat_tag, content_hash, epoch) of each micro-batch to a memo, as sources.append_memo() does.
    A micro-batch that is run again changes nothing. A stream is known by the id in its checkpoint, so that another one in the
    same place is not taken for it."""

    def write(batch: DataFrame, n: int) -> None:
        stream_id = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        corpus.append_memo(batch, path, (stream_id, n))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
