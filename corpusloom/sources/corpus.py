"""Corpora, snapshots and playlists as DataFrames."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import identity
from corpusloom.plans import globs as G
from corpusloom.sources.memo import append_memo, compact_memo, read_memo  # noqa: F401

#: A string or a comment, which stays as it is, or a comma before a closing bracket, comments between them or not.
COMMA = r'("(?:[^"\\]++|\\.)*+"|//[^\n]*+|/\*(?s:.*?)\*/)|,((?:\s|//[^\n]*+\n|/\*(?s:.*?)\*/)*+[\]}])'
MAX_BYTES = 10 * 1024 * 1024
#: One line for each published generation of a manifest.
PUBLISHED = "generation string, at long, version int, playlist string, algorithm string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run takes a temporary one, and
    on a cluster, where each executor would write to its own disk, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-corpusloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read back: its lineage is cut, and it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/corpusloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, roots: list[str], globs: list[str] = (), content: bool = True) -> DataFrame:
    """(path, size, mtime_ns, content) of the files below the roots; each directory that a glob begins with is read once.

    Spark's file sources leave out files without bytes; requested() shows such paths as absent.
    """
    bases = sorted({f"{r.rstrip('/')}/{G.literal_prefix(g)}".rstrip("/") if "/" in g else r for r in roots for g in (globs or [""])})
    bases = [b for b in bases if not any(b != a and b.startswith(a.rstrip("/") + "/") for a in bases)]
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(bases)
    path = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    return df.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), *(["content"] if content else []))


def requested(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path) with the inventory's columns; a path that isn't there stays, with exists false."""
    return wanted.select("path").distinct().join(files.withColumn("__there", F.lit(True)), "path", "left").withColumn("exists", F.coalesce("__there", F.lit(False))).drop("__there")


def read_content(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """(path, kind, text, error): UTF-8 text as it is, anything else in base64; files above most bytes are refused."""
    text = F.is_valid_utf8(F.col("content")) & ~F.col("content").cast("string").contains("\x00")
    fits = F.octet_length("content") <= most
    return files.select(
        "path",
        F.when(~fits, None).when(text, "text").otherwise("base64").alias("kind"),
        F.when(~fits, None).when(text, F.col("content").cast("string")).otherwise(F.regexp_replace(F.base64("content"), r"\s", "")).alias("text"),  # base64() breaks lines
        F.when(~fits, F.concat(F.lit("larger than "), F.lit(most), F.lit(" bytes"))).alias("error"),
    )


def request(paths: DataFrame, most: int = 50) -> DataFrame:
    """paths (path, pos) of one request: the first `most` by pos; more are refused, with an error instead of a path."""
    late = F.col("pos") >= most
    return paths.select("pos", F.when(~late, F.col("path")).alias("path"), F.when(late, F.lit(f"more than {most} paths")).alias("error"))


def path_list(spark: SparkSession, path: str | list[str], env: dict[str, str]) -> DataFrame:
    """(path) from a text file: blank lines and those that begin with # don't count, variables are expanded."""
    line = F.trim("value")
    rows = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    return rows.select(P.expand(line, env, strict=False).alias("path")).filter("path <> ''")


def env_text(spark: SparkSession, paths: list[str], env: dict[str, str]) -> DataFrame:
    """(env_text) of environment lists: their expanded lines, distinct and in order, joined; an ingredient of a fingerprint."""
    lines = path_list(spark, paths, env).distinct()
    return lines.agg(F.coalesce(F.expr("listagg(path, '\\n') within group (order by path)"), F.lit("")).alias("env_text"))


FILES = "path string, hash string, size long, inode long, mtime_ns long, mode int"


#: White space belongs to a path; a text of no characters is not null.
TSV = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def snapshot_format(path: str) -> str:
    """By the path's ending: tsv (also without one) or json."""
    name = path.rpartition("/")[2]
    kind = name.rpartition(".")[2] if "." in name else "tsv"
    if kind not in ("tsv", "json"):
        raise ValueError(f"no snapshot format {kind!r}")
    return kind


def write_snapshot(files: DataFrame, path: str, params: dict | None = None) -> None:
    """.tsv (or no ending): rows sorted by path under a header. .json: lines of one object with fingerprint_params, and of one
    object for each part of the files, sorted by path, so that no task writes them all."""
    columns = [F.col(c) if c in files.columns else F.lit(None).cast("long").alias(c) for c in ("path", "hash", "size", "inode", "mtime_ns", "mode")]
    rows = files.select(*columns).orderBy("path")
    if snapshot_format(path) == "tsv":
        broken = F.col("path").rlike(r"[\r\n]")
        whole = F.when(broken, F.raise_error(F.concat(F.lit("a line end in a path: "), F.to_json(F.struct("path"))))).otherwise(F.col("path"))
        rows.withColumn("path", whole).write.csv(path, sep="\t", header=True, **TSV)
        return
    rows.select(F.array(F.struct("*")).alias("files")).write.json(path)
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    values = {str(k): text(v) for k, v in (params or {}).items()}
    one = files.sparkSession.createDataFrame([(values,)], "fingerprint_params map<string, string>")
    one.coalesce(1).write.mode("append").json(path)


def read_snapshot(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """(path, hash, size, inode, mtime_ns, mode). single: a .json file that is one object over many lines."""
    if snapshot_format(path) == "json":
        rows = spark.read.schema(f"files array<struct<{_typed(FILES)}>>").option("multiLine", single).json(path)
        return rows.select(F.explode("files").alias("f")).select("f.*")
    return spark.read.csv(path, sep="\t", header=True, schema=FILES, mode="DROPMALFORMED", nullValue="\x00", **TSV).filter("path is not null")


def read_snapshot_params(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """(name, value) of a .json snapshot's parameters; lists and numbers as JSON. diff_params() takes two of them."""
    rows = spark.read.schema("fingerprint_params map<string, string>").option("multiLine", single).json(path)
    each = rows.filter("fingerprint_params is not null").select(F.explode("fingerprint_params").alias("name", "value"))
    return each.withColumn("value", F.when(F.col("value").startswith("["), F.to_json(F.from_json("value", "array<string>"))).otherwise(F.col("value")))


def _typed(fields: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))


def playlist(spark: SparkSession, path: str, step: str, key: str | None = None) -> DataFrame:
    """(key, seq, step) of a JSON playlist: an array of steps, or an object of them by key. Trailing commas are accepted."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", COMMA, "$1$2").alias("value"))
    array = F.from_json("value", f"array<{step}>", {"allowComments": "true"})
    keyed = F.from_json("value", f"map<string, array<{step}>>", {"allowComments": "true"})
    is_array = F.ltrim("value").startswith("[")
    one = text.filter(is_array).select(F.lit("").alias("key"), F.posexplode(array).alias("seq", "step"))
    many = text.filter(~is_array).select(F.explode(keyed).alias("key", "steps")).select("key", F.posexplode("steps").alias("seq", "step"))
    rows = one.unionByName(many)
    return rows if key is None else rows.filter(F.col("key") == key)


def environment(steps: DataFrame, env: dict[str, str]) -> DataFrame:
    """(env_text) of all variables that steps (step with env ARRAY<STRING>) name: sorted distinct `NAME=value` lines. A name that is
    not set raises."""
    names = steps.select(F.explode("step.env").alias("name")).distinct()
    known = steps.sparkSession.createDataFrame(sorted(env.items()), "name string, value string")
    rows = names.join(known, "name", "left").withColumn("line", F.concat("name", F.lit("="), F.col("value"), F.lit("\n")))
    checked = F.when(F.col("line").isNull(), F.raise_error(F.concat(F.lit("not set: "), "name"))).otherwise(F.col("line"))
    return rows.select(checked.alias("line")).agg(F.coalesce(F.expr("listagg(line, '') within group (order by line)"), F.lit("")).alias("env_text"))


def write_manifest(manifest: DataFrame, path: str, version: int, playlist: str, algorithm: str) -> None:
    """A new generation of a manifest, in the order of its signatures. It counts from when its line is among the published ones; until then readers see the last."""
    generation = uuid.uuid4().hex
    manifest.select("signature", "world_in", "world_out").orderBy("signature").write.parquet(f"{path}/data/{generation}")
    line = manifest.sparkSession.createDataFrame([(generation, time.time_ns(), version, playlist, algorithm)], PUBLISHED)
    line.coalesce(1).write.mode("append").json(f"{path}/published")


def read_manifest(spark: SparkSession, path: str, version: int, playlist: str, algorithm: str) -> DataFrame:
    """(signature, world_in, world_out) of the newest generation; no rows if there is none, or if it is for another version,
    playlist or hash algorithm."""
    try:
        newest = spark.read.schema(PUBLISHED).json(f"{path}/published").orderBy(F.desc("at")).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = []
    schema = "signature string, world_in string, world_out string"
    if not newest or tuple(newest[0])[2:] != (version, playlist, algorithm):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/data/{newest[0].generation}")
