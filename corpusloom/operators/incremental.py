"""Which tasks are up to date, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import lineage
from corpusloom.sources.corpus import written


def framed(*fields: Column) -> Column:
    """Fields with their lengths before them, so that no two lists of fields look alike."""
    return F.concat(*(x for f in fields for x in (F.length(f).cast("string"), F.lit(":"), f)))


def signature(action: Column, extras: Column, inputs: Column, outputs: Column) -> Column:
    """The identity of a task's declaration; lists of paths count without order."""
    listed = lambda a: F.concat_ws("\x01", F.array_sort(F.array_distinct(a)))
    return F.sha2(framed(F.lit("task"), action, extras, listed(inputs), listed(outputs)), 256)


def world(declared: DataFrame, inventory: DataFrame, require: bool = True) -> DataFrame:
    """(task_id, world): one hash of what a task's declared concrete paths hold; null if one is absent and all are required.

    inventory: (path, hash), hash null where unreadable. Declared (task_id, path) are made distinct before the join, and a
    path that every task declares is one key that adaptive execution can split.
    """
    rows = declared.select("task_id", "path").distinct().join(inventory.select("path", "hash", F.lit(True).alias("there")), "path", "left")
    item = F.concat_ws("=", "path", F.coalesce("hash", F.lit("-")))
    bad = F.bool_or(F.col("hash").isNull() & (F.lit(require) | F.col("there").isNotNull()))
    return rows.withColumn("item", item).groupBy("task_id").agg(F.sha2(F.expr("listagg(item, ',') within group (order by item)"), 256).alias("w"), bad.alias("bad")).select("task_id", F.when(~F.col("bad"), F.col("w")).alias("world"))


def with_environment(fingerprint: Column, env: Column) -> Column:
    return F.when(F.coalesce(env, F.lit("")) == "", fingerprint).otherwise(F.sha2(F.concat(fingerprint, env), 256))


def up_to_date(tasks: DataFrame, manifest: DataFrame, refresh: bool = False) -> DataFrame:
    """tasks (task_id, signature, world_in, world_out, missing_output) with status and the first reason that holds."""
    m = manifest.select("signature", F.col("world_in").alias("__in"), F.col("world_out").alias("__out"), F.lit(True).alias("__known"))
    differs = lambda a, b: ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    reason = (
        F.when(F.col("world_in").isNull(), "missing input").when(F.lit(refresh), "refresh").when(F.col("__known").isNull(), "new task")
        .when(differs("world_in", "__in"), "inputs changed").when(F.col("missing_output") & differs("world_out", "__out"), "output missing")
        .when(differs("world_out", "__out"), "products changed").otherwise("up to date")
    )
    return tasks.join(m, "signature", "left").withColumn("reason", reason).withColumn("hit", F.col("reason") == "up to date").drop("__in", "__out", "__known")


def next_manifest(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The manifest after a run: outcomes (signature, outcome, world_in, world_out), outcome being hit, ok, failed or pruned.

    ok with both worlds replaces the entry, ok without one removes it, pruned removes it; the others carry the old entry.
    """
    stored = outcomes.filter("outcome = 'ok' and world_in is not null and world_out is not null").select("signature", "world_in", "world_out")
    gone = outcomes.filter("outcome in ('ok', 'pruned')").select("signature")
    return manifest.select("signature", "world_in", "world_out").join(gone, "signature", "left_anti").unionByName(stored)


def prune(manifest: DataFrame, declared: DataFrame, key: str, partial: bool = False) -> DataFrame:
    """manifest (key, signature, ...) without the entries of this key whose signature is no longer declared; a partial build
    proves nothing about what it left out, so it prunes nothing."""
    if partial:
        return manifest
    gone = manifest.filter(F.col("key") == key).join(declared.select("signature").distinct(), "signature", "left_anti").select("signature").distinct().withColumn("__gone", F.lit(True))
    return manifest.join(gone, "signature", "left").filter((F.col("key") != key) | F.col("key").isNull() | F.col("__gone").isNull()).select(*manifest.columns)


def gate(tasks: DataFrame, stored: DataFrame) -> DataFrame:
    """tasks (signature, inputs, outputs, n_outputs) with reason and hit, against stored (signature, inputs, outputs).

    inputs and outputs are fingerprints, null where they could not be taken; a task without outputs runs once for its inputs.
    """
    s = stored.select("signature", F.col("inputs").alias("__in"), F.col("outputs").alias("__out"), F.lit(True).alias("__known"))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    reason = (
        F.when(F.col("__known").isNull(), "no entry").when(~same("inputs", "__in"), "inputs changed")
        .when((F.col("n_outputs") > 0) & ~same("outputs", "__out"), "outputs changed").otherwise("up to date")
    )
    return tasks.join(s, "signature", "left").withColumn("reason", reason).withColumn("hit", F.col("reason") == "up to date").drop("__in", "__out", "__known")


def forecast(tasks: DataFrame, manifest: DataFrame, edge: DataFrame, refresh: bool = False) -> DataFrame:
    """(task_id, wave, hit, reason, may_change): what a run would do, in the order it would, without running anything.

    Each task is judged by the hashes as they are, as up_to_date() does. may_change marks hits behind a task that will run:
    they run too if that task's bytes come out different, and stay hits if they don't.
    """
    judged = written(up_to_date(tasks, manifest, refresh).select("task_id", "hit", "reason"))
    start = lineage.ready(judged.select("task_id"), edge.select("src", "dst"))  # both walks begin with it
    reach = lineage.dirty(edge, judged.filter("not hit").select("task_id"), start=start).filter("distance > 0").select("task_id", F.lit(True).alias("__behind"))
    wave = lineage.waves(judged.select("task_id"), edge, start=start)
    return judged.join(wave, "task_id").join(reach, "task_id", "left").select("task_id", "wave", "hit", "reason", (F.col("hit") & F.coalesce("__behind", F.lit(False))).alias("may_change"))


def unchanged_outputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(task_id) of the tasks whose hashes of outputs (task_id, world) are known and equal in two states: re-runs of these don't
    make what waits for them run (lineage.dirty(same=...))."""
    a, b = before.select("task_id", F.col("world").alias("old")), after.select("task_id", F.col("world").alias("new"))
    return a.join(b, "task_id").filter("old = new").select("task_id")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(n, hits, executed, failed) of a run: executed are those that ran well."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.agg(F.count(F.lit(1)).alias("n"), n("hit").alias("hits"), n("ok").alias("executed"), n("failed").alias("failed"))


def existence(declared: DataFrame, inventory: DataFrame) -> DataFrame:
    """(task_id, world): one hash of which of a task's declared paths are there and of their kind (inventory: path, kind), whatever they hold."""
    rows = declared.select("task_id", "path").distinct().join(inventory.select("path", "kind"), "path", "left")
    item = F.concat_ws("=", "path", F.coalesce("kind", F.lit("-")))
    return rows.withColumn("item", item).groupBy("task_id").agg(F.sha2(F.expr("listagg(item, ',') within group (order by item)"), 256).alias("world"))


def expand_declared(declared: DataFrame, env: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """declared (task_id, path) with variables expanded, without the paths that name an unknown one; and (task_id, cacheable):
    false where a path was dropped, since the rest no longer says what the task reads."""
    rows = declared.withColumn("__path", P.expand(F.col("path"), env))
    kept = rows.filter("__path is not null").withColumn("path", F.col("__path")).drop("__path")
    return kept, rows.groupBy("task_id").agg((~F.bool_or(F.col("__path").isNull() & F.col("path").isNotNull())).alias("cacheable"))


def minimal_cover(directories: DataFrame) -> DataFrame:
    """(path): the directories without those that lie below another; the root itself is refused."""
    d = directories.select("path").filter("path <> '/'").distinct()
    return d.join(lineage._below(d, d), "path", "left_anti")


def covered(rows: DataFrame, directories: DataFrame, anti: bool = False) -> DataFrame:
    """Rows (path, ...) that are one of the directories or lie below one; or those that don't. What is exploded are the distinct
    directories that the rows lie in."""
    tops = directories.select("path").distinct()
    inside = tops.unionByName(lineage._below(rows.select("path").distinct(), tops))
    return rows.join(inside, "path", "left_anti" if anti else "left_semi")


def access_policy(log: DataFrame) -> DataFrame:
    """(path, writable): the smallest set of directories that a log (path, operation) touched, reads inside writes left out."""
    files = log.filter("operation like 'file-%'").select(P.dirname(F.col("path")).alias("path"), F.col("operation").rlike("^file-(write|unlink|rename|create)").alias("writes"))
    files = written(files.distinct())
    write = minimal_cover(files.filter("writes"))
    read = covered(minimal_cover(files.filter("not writes")), write, anti=True)
    return write.withColumn("writable", F.lit(True)).unionByName(read.withColumn("writable", F.lit(False)))


def merge_grants(grants: DataFrame) -> DataFrame:
    """(path, writable, pos) of grants of which several may name a path: one that may write wins, and the first place counts."""
    return grants.groupBy("path").agg(F.bool_or("writable").alias("writable"), F.min("pos").alias("pos"))


def required_access(task_paths: DataFrame) -> DataFrame:
    """(path, writable): the directories that a playlist must reach. A glob needs its literal prefix, a read its own path; what
    is made, moved or edited needs the directory above it, writable."""
    base = P.literal_prefix(F.col("path"))
    whole = base == F.col("path")
    writes = F.col("role") != "input"
    rows = task_paths.select(F.when(writes & whole, P.dirname(F.col("path"))).otherwise(base).alias("path"), writes.alias("writable")).filter("path <> ''").distinct()
    rows = written(rows)  # few, and the expressions that they come from would be repeated in every branch below
    write = minimal_cover(rows.filter("writable"))
    read = minimal_cover(covered(rows.filter("not writable"), write, anti=True))  # what is written decides first: it is little
    return write.withColumn("writable", F.lit(True)).unionByName(read.withColumn("writable", F.lit(False)))


def denied(lines: DataFrame) -> DataFrame:
    """(path) of the lines (value) of a program's errors that end with a path and `Permission denied` or `Operation not permitted`."""
    path = F.regexp_extract("value", r"(/[^:'\"]*)['\"]?: (?:Permission denied|Operation not permitted)$", 1)
    return lines.select(path.alias("path")).filter("path <> ''").distinct()


def of_processes(log: DataFrame, pids: DataFrame) -> DataFrame:
    """The rows of a log (pid, ...) that one of the processes (pid) wrote."""
    return log.join(pids.select("pid").distinct(), "pid", "left_semi")


def violations(lines: DataFrame) -> DataFrame:
    """(pid, operation, path) of the log lines (value) that deny a file operation: `... (pid) deny(n) operation /path`."""
    pattern = r"\((\d+)\) deny\(\d+\) ([a-z*-]+) (/.*)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.filter(F.col("value").rlike(pattern)).select(part(1).try_cast("long").alias("pid"), part(2).alias("operation"), part(3).alias("path")).filter("operation like 'file-%'")
