"""Memos: what runs found out about files, in buckets of file keys, each with a base of one row a file and a log of runs.

    published/          JSON lines: the number of buckets; a line for each run, and for each bucket that was compacted
    log/RUN/bucket=B    records of a run
    base/NAME/bucket=B  the latest records of a bucket

What no published line names is not read, so a run that is lost half-way leaves nothing. A run reads the buckets alone that its
records fall into; a bucket is compacted by itself. A memo has one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import identity

#: Buckets of a new memo (a large one should get more). Runs after which the epoch of a record that is seen again is renewed; below the runs after which it
#: would be evicted.
BUCKETS, RENEW = 16, 16
KEY = ["file_key", "stat_tag", "content_hash"]
RECORD = "file_key long, stat_tag long, content_hash string, epoch long, seq long"
LINE = "kind string, name string, seq long, bucket int, buckets array<int>, rows array<long>, epoch long, stream string, batch long"


class _State(NamedTuple):
    """What is in force: the number of buckets, (name, seq, rows) of each bucket's base, (name, seq, {bucket: rows}) of each run
    that some bucket has not compacted, and the newest epoch and seq."""

    buckets: int
    bases: dict
    runs: list
    epoch: int
    seq: int

    def log(self, bucket: int) -> list[tuple[str, int]]:
        """(run, rows) of a bucket since its base."""
        since = self.bases[bucket][1]
        return [(name, rows[bucket]) for name, seq, rows in self.runs if seq > since and bucket in rows]


def append_memo(records: DataFrame, path: str, batch: tuple[str, int] | None = None, buckets: int = BUCKETS) -> None:
    """Appends a run's records (file_key, stat_tag, content_hash, epoch) to a memo's log, without those it already holds.

    A record that is held, but was last written more than RENEW runs ago, is written again with its new epoch, so that a file
    that every run sees is never evicted, and a run without changes writes little or nothing.

    batch: a stream and the number of its micro-batch. A batch that was appended before, or lies before one that was, changes
    nothing; one that was lost half-way is written anew. buckets: how many a new memo gets; a memo keeps what it has.
    """
    spark = records.sparkSession
    if (state := _state(spark, path)) is None:
        _publish(spark, path, [{"kind": "memo", "seq": buckets}])
        state = _state(spark, path)
    if batch and not _lines(spark, path).filter((F.col("kind") == "run") & (F.col("stream") == batch[0]) & (F.col("batch") >= batch[1])).isEmpty():
        return
    run = hashlib.md5(f"{batch[1]} {batch[0]}".encode()).hexdigest() if batch else uuid.uuid4().hex
    seq = max(time.time_ns(), state.seq + 1)
    new = records.groupBy(*KEY).agg(F.max("epoch").alias("epoch")).withColumn("bucket", _bucket(state.buckets)).persist()
    try:
        known = identity.latest_records(_records(spark, path, state, _distinct(new)), newest=state.epoch).select(*KEY, F.col("epoch").alias("__known"))
        changed = new.join(known, KEY, "left").filter(F.col("__known").isNull() | (F.col("epoch") > F.col("__known") + RENEW)).drop("__known")
        there = _write(changed.withColumn("seq", F.lit(seq)), f"{path}/log/{run}")
    finally:
        new.unpersist()
    stream, number = batch or (None, None)
    sizes = {"buckets": list(there), "rows": [n for n, _ in there.values()], "epoch": max((e for _, e in there.values() if e is not None), default=None)}
    _publish(spark, path, [{"kind": "run", "name": run, "seq": seq, "stream": stream, "batch": number} | sizes])


def read_memo(spark: SparkSession, path: str, idle_runs: int = 32, keys: DataFrame | None = None) -> DataFrame:
    """(file_key, stat_tag, content_hash, epoch): the latest record of each file, the log before the base. No rows without a memo.

    keys (file_key, ...): only these files, from their buckets alone.
    """
    if (state := _state(spark, path)) is None:
        return spark.createDataFrame([], RECORD).drop("seq")
    if keys is None:
        return identity.latest_records(_records(spark, path, state, range(state.buckets)), idle_runs, state.epoch)
    wanted = keys.select("file_key").distinct()
    found = _records(spark, path, state, _distinct(wanted.withColumn("bucket", _bucket(state.buckets))))
    return identity.latest_records(found.join(wanted, "file_key", "left_semi"), idle_runs, state.epoch)


def compact_memo(spark: SparkSession, path: str, share: float = 0.25) -> bool:
    """Rewrites base and log of each bucket as a new base where the log holds more than share of the base's rows; whether any was.
    A new base counts from when its line is published, so a run that is lost half-way leaves the old one in force."""
    if (state := _state(spark, path)) is None:
        return False
    logged = {b: sum(n for _, n in state.log(b)) for b in range(state.buckets)}
    full = [b for b, n in logged.items() if n > share * state.bases[b][2]]
    if not full:
        return False
    name = uuid.uuid4().hex
    kept = identity.latest_records(_records(spark, path, state, full), newest=state.epoch)
    there = _write(kept.withColumns({"seq": F.lit(0).cast("long"), "bucket": _bucket(state.buckets)}), f"{path}/base/{name}")
    lines = [{"kind": "base", "bucket": b, "seq": state.seq, "name": name if b in there else None, "rows": [there[b][0] if b in there else 0]} for b in full]
    # a bucket without a log needs no older run either
    lines += [{"kind": "base", "bucket": b, "seq": state.seq, "name": state.bases[b][0], "rows": [state.bases[b][2]]} for b, n in logged.items() if not n]
    _publish(spark, path, lines)
    return True


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("file_key"), F.lit(n)).cast("int")


def _distinct(rows: DataFrame) -> list[int]:
    """The buckets of rows: no more than a memo has."""
    return [r.bucket for r in rows.select("bucket").distinct().collect()]


def _write(rows: DataFrame, path: str) -> dict[int, tuple[int, int]]:
    """Writes rows (bucket, ...) by bucket; the number of rows and the newest epoch of each that has some."""
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    back = rows.sparkSession.read.schema(f"{RECORD}, bucket int").parquet(path)
    return {r.bucket: (r.n, r.epoch) for r in back.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("epoch")).collect()}


def _publish(spark: SparkSession, path: str, lines: list[dict]) -> None:
    rows = F.from_json(F.lit(json.dumps(lines)), "array<struct<" + LINE.replace(" ", ": ").replace(",: ", ", ") + ">>")
    spark.range(1).select(F.inline(rows)).coalesce(1).write.mode("append").json(f"{path}/published")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINE).json(f"{path}/published")


def _state(spark: SparkSession, path: str) -> _State | None:
    heads = _if_there(lambda: _lines(spark, path).groupBy("kind", "bucket").agg(F.max("seq").alias("seq"), F.max_by(F.struct("name", "rows"), "seq").alias("last"), F.max("epoch").alias("epoch")).collect())
    if not heads:
        return None
    n = next(r.seq for r in heads if r.kind == "memo")
    bases = {b: (None, -1, 0) for b in range(n)} | {r.bucket: (r.last.name, r.seq, r.last.rows[0]) for r in heads if r.kind == "base"}
    seq, epoch = next(((r.seq, r.epoch) for r in heads if r.kind == "run"), (-1, None))
    since = min(s for _, s, _ in bases.values())
    runs = _lines(spark, path).filter((F.col("kind") == "run") & (F.col("seq") > since)).select("name", "seq", "buckets", "rows").collect()
    return _State(n, bases, [(r.name, r.seq, dict(zip(r.buckets or (), r.rows or ()))) for r in runs], epoch or 0, seq)


def _records(spark: SparkSession, path: str, state: _State, buckets: Iterable[int]) -> DataFrame:
    """The records of buckets with their tier: 0 in a base, 1 in the log."""
    buckets = list(buckets)
    base = [f"{path}/base/{state.bases[b][0]}/bucket={b}" for b in buckets if state.bases[b][0]]
    log = [f"{path}/log/{run}/bucket={b}" for b in buckets for run, _ in state.log(b)]
    parts = [spark.read.schema(RECORD).parquet(*paths).withColumn("tier", F.lit(tier)) for tier, paths in enumerate((base, log)) if paths]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{RECORD}, tier int")


def _if_there(read: Callable):
    """What read gives, or None if its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
