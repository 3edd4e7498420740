"""Content hashes, tree fingerprints, snapshots and what changed between two of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.functions import paths as P

ALGORITHMS = ("sha256", "xxhash64", "crc32")
#: Files in one chunk of the two-level fingerprint.
CHUNK = 65_536
#: Files in one piece of text that the one-level fingerprint takes.
PIECE = 16


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Hex; an empty file hashes to 0, and null (unreadable, absent) stays null and equals nothing."""
    binary = content.cast("binary")
    value = {"sha256": F.sha2(binary, 256), "xxhash64": P.hex64(F.xxhash64(binary)), "crc32": F.lower(F.lpad(F.hex(F.crc32(binary)), 8, "0"))}[algorithm]
    return F.when(content.isNull(), F.lit(None)).when(F.octet_length(content) == 0, F.lit("0")).otherwise(value)


def fingerprint_item(mode: str, path: Column, rel: Column, digest: Column) -> Column:
    return {"content": digest, "absolute": F.concat(path, F.lit("="), digest), "relative": F.concat(rel, F.lit("="), digest)}[mode]


def first_of_path(files: DataFrame, order: Column) -> DataFrame:
    """One row of each path, the first in the given order."""
    return files.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(order))).filter("__n = 1").drop("__n")


def _items(files: DataFrame, by: list[str], mode: str) -> DataFrame:
    """(*by, k, item, part, at) of the files that are there, written in the order of by and the reversed path k: a range sort,
    so that a large group is spread over many partitions. at counts the rows of a partition."""
    from corpusloom.sources.corpus import written  # it imports this module

    item = fingerprint_item(mode, F.col("path"), F.col("rel"), F.col("hash"))
    rows = files.filter(F.col("hash").isNotNull()).dropDuplicates(["path"]).select(*by, F.reverse("path").alias("k"), item.alias("item"))
    placed = written(rows.orderBy(*by, "k").withColumn("at", F.monotonically_increasing_id()))
    return placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})


def tree_fingerprint(files: DataFrame, by: list[str], mode: str = "content") -> DataFrame:
    """One hash of all files of a group (columns path, rel, hash): in the order of the reversed path, absent files left out.

    Neighbours are joined in parallel to pieces of PIECE files; one task takes a group's pieces in their order and holds the
    state of the hash and a batch of pieces, so a group of any size is hashed without ever being one string.
    """
    piece = F.floor(F.col("at") / PIECE).alias("piece")
    pieces = _items(files, by, mode).groupBy(*by, "part", piece).agg(F.expr("listagg(item, '') within group (order by k)").alias("text"), F.count(F.lit(1)).alias("n"))
    kinds = [pieces.schema[c] for c in by]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, state = None, 0, None

        def rows(groups: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
            cols = zip(*groups)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*by, "n_files", "fingerprint"])

        types: list[pa.DataType] = []
        for batch in batches:
            done: list[tuple] = []
            types = [*(batch.schema.field(c).type for c in by), pa.int64(), pa.string()]
            keys = zip(*(batch.column(c).to_pylist() for c in by)) if by else [()] * batch.num_rows
            for key, text, m in zip(keys, batch.column("text").to_pylist(), batch.column("n").to_pylist()):
                if key != last:
                    if last is not None:
                        done.append((*last, n, state and state.hexdigest()))
                    last, n, state = key, 0, None
                n += m
                if text is not None:
                    state = state or hashlib.sha256()
                    state.update(text.encode())
            if done:
                yield rows(done, types)
        if last is not None:
            yield rows([(*last, n, state and state.hexdigest())], types)

    dealt = pieces.repartition(*by) if by else pieces.coalesce(1)
    out = dealt.sortWithinPartitions(*by, "part", "piece").mapInArrow(hashed, StructType([*kinds, StructField("n_files", LongType(), False), StructField("fingerprint", StringType())]))
    return out if by else out.agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.max("fingerprint").alias("fingerprint"))


def chunked_fingerprint(files: DataFrame, mode: str = "content", chunk: int = CHUNK, by: list[str] = ()) -> DataFrame:
    """The fingerprint of very large trees, one for each group, in two levels: a range sort by group and reversed path, hashes of
    chunks of consecutive files, and a hash of those. No task hashes more than a chunk, or a group's hashes of chunks. It
    differs from the one-level form, so the form belongs to a snapshot's parameters."""
    by = list(by)
    placed = _items(files, by, mode)
    per = placed.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = per.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = F.col("p.part") == F.col("s.part")
    for c in by:
        same &= F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    rank = F.col("s.start") + F.col("p.at") - F.col("s.first")
    numbered = placed.alias("p").join(starts.alias("s"), same).select(*(F.col(f"p.{c}") for c in by), "p.k", "p.item", F.floor(rank / chunk).alias("c"))
    chunks = numbered.groupBy(*by, "c").agg(F.sha2(F.expr("listagg(item, '') within group (order by k)"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return chunks.groupBy(*by).agg(F.sum("n").alias("n_files"), F.sha2(F.expr("listagg(h, '') within group (order by c)"), 256).alias("fingerprint"))


FIELDS = ("hash", "size", "inode", "mtime_ns", "mode")


def diff_snapshots(old: DataFrame, new: DataFrame, same_algorithm: bool = True, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(path, change, details): added, removed and modified files; details name the fields with old and new values.

    Hashes of different algorithms are not compared. A null hash equals nothing, not even another null.
    """
    fields = tuple(f for f in fields if f in old.columns and f in new.columns and (same_algorithm or f != "hash"))
    a, b = (df.select("path", F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(n)) for df, n in ((old, "o"), (new, "n")))
    both = a.join(b, "path", "full_outer")
    differs = lambda f: ~F.coalesce(F.col(f"o.{f}") == F.col(f"n.{f}"), F.lit(False)) if f == "hash" else ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    details = F.filter(F.array(*(F.when(differs(f), F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("old"), F.col(f"n.{f}").alias("new"))) for f in fields)), lambda x: x.isNotNull())
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(details) > 0, "modified")
    return both.select("path", change.alias("change"), F.when(change == "modified", details).alias("details")).filter("change is not null")


def diff_params(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old, new) of the parameters (name, value) in which two snapshots differ. If hash_algorithm is among them, their
    hashes must not be compared (same_algorithm=False)."""
    a, b = old.select("name", F.col("value").alias("old")), new.select("name", F.col("value").alias("new"))
    return a.join(b, "name", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


def relative_to(files: DataFrame, bases: DataFrame) -> DataFrame:
    """files with rel: the path below the deepest of the bases (path) that is above it, or the path itself."""
    up = files.select("path").distinct().select("path", F.posexplode(P.ancestors(F.col("path"))).alias("depth", "base"))
    deepest = up.join(bases.select(F.rtrim("path", F.lit("/")).alias("base")).distinct(), "base").groupBy("path").agg(F.max_by("base", "depth").alias("__base"))
    return files.join(deepest, "path", "left").withColumn("rel", F.coalesce(P.relative(F.col("path"), F.col("__base")), F.col("path"))).drop("__base")


def memo_lookup(files: DataFrame, memo: DataFrame) -> DataFrame:
    """files (path, file_key, stat_tag) with the stored hash where key and tag agree; the others must be hashed (hit false)."""
    known = memo.select("file_key", F.col("stat_tag").alias("__tag"), F.col("content_hash").alias("__hash"))
    hit = F.coalesce(F.col("stat_tag") == F.col("__tag"), F.lit(False))
    return files.join(known, "file_key", "left").withColumn("hit", hit).withColumn("hash", F.when(hit, F.col("__hash"))).drop("__tag", "__hash")


def latest_records(records: DataFrame, idle_runs: int = 32, newest: int | None = None) -> DataFrame:
    """Of each file_key the record of the highest (tier, seq), without those not seen in the last idle_runs epochs before the
    newest: that of the records, if none is given."""
    last = records.groupBy("file_key").agg(F.max_by(F.struct("stat_tag", "content_hash", "epoch"), F.struct("tier", "seq")).alias("r")).select("file_key", "r.*")
    if newest is None:
        newest = records.agg(F.max("epoch")).first()[0]
    return last.filter(F.col("epoch") + idle_runs >= (newest or 0))


def file_key(dev: Column, inode: Column) -> Column:
    return F.xxhash64(dev, inode)


def stat_tag(size: Column, mtime_ns: Column, ctime_ns: Column, kind: Column) -> Column:
    return F.xxhash64(size, mtime_ns, ctime_ns, kind)
