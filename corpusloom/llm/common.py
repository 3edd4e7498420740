"""What the operators of this subpackage share: tables, scratch space and running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as a character class for Java's and Python's regular expressions.
WS = r"[\x20\x09-\x0D]"
#: One word.
WORD = r"[^\x20\x09-\x0D]"
#: Spark's setting that lets a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run takes a temporary one, and
    on a cluster, where each executor would write to its own disk, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-corpusloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage is cut, and a lost executor costs nothing.

    The shuffle files of the write go as soon as it is done; what is read back no longer needs them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that all its readers are done with."""
    for file in df.inputFiles()[:1]:  # all its files lie in one folder
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


#: A key with this share of all rows is hot, so there are at most so many hot keys; and rows below which none is.
HOT_SHARE, HOT_LEAST = 10_000, 32


def join_hot(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """rows joined with facts, which has one row for each key; columns on must not be null.

    Keys with a HOT_SHARE-th of all rows are at most HOT_SHARE, so their facts are broadcast and their rows stay where they are;
    the others are shuffled. A key that holds a third of all rows is therefore no task of its own.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    least = max(HOT_LEAST, rows.count() // HOT_SHARE)
    hot = F.broadcast(counts.filter(F.col("__n") >= least).select(*on))  # at most HOT_SHARE keys
    known = F.broadcast(facts.join(hot, on, "left_semi"))
    near = rows.join(hot, on, "left_semi").join(known, on, how)
    far = rows.join(hot, on, "left_anti").join(facts, on, how)
    return near.unionByName(far)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with, for each name in sums, the total of that column over all rows before this one in the given order.

    A range sort deals the rows out; each partition's totals (one row for each partition) are summed up once more and
    added, so that no task sees all rows.
    """
    parts = materialize(
        df.withColumns({f"__v_{k}": v for k, v in sums.items()}).orderBy(*order).withColumns({"__pid": F.spark_partition_id(), "__mid": F.monotonically_increasing_id()}),
        name,
    )
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__pid").agg(*(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums))
    offsets = totals.select("__pid", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums))
    inside = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(offsets), "__pid")  # a row for each partition
    return out.select(*df.columns, *((F.col(f"__o_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0))).alias(k) for k in sums))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with k1, k2: two hashes of the text. Equal texts share a key and all that is found about it, whatever their ids."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit("second"), t)})
