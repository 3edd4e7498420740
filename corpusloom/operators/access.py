"""Which paths may be touched, and what declarations find in an inventory. Everything is an equi-join on ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import incremental, lineage


def upwards(path: Column) -> Column:
    """The path, all directories above it, and the root."""
    return F.concat(F.array(F.lit("/")), P.ancestors(path, proper=False))


def allowed(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """rows (path, need_writable, ...) with allowed: a grant (path, writable) is the path or lies above it, and is writable if
    that is needed. Null paths are never allowed, a null need is none. Distinct paths are exploded, not rows."""
    need = F.coalesce("need_writable", F.lit(False))
    asked = rows.select(F.col("path").alias("__path"), need.alias("__need")).distinct().filter("__path is not null")
    given = grants.groupBy(F.col("path").alias("up")).agg(F.bool_or("writable").alias("w"))
    ok = asked.select("__path", "__need", F.explode(upwards(F.col("__path"))).alias("up")).join(given, "up").filter("w or not __need").select("__path", "__need").distinct().withColumn("allowed", F.lit(True))
    out = rows.join(ok, (F.col("path") == F.col("__path")) & (need == F.col("__need")), "left").drop("__path", "__need")
    return out.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def stale_excludes(excludes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(pattern) of the excludes that hold a slash, have a literal prefix, and lie below the literal prefix of no input."""
    prefix = P.literal_prefix(F.col("pattern"))
    asked = excludes.select("pattern", prefix.alias("at")).filter(F.col("pattern").contains("/") & (F.col("at") != "")).distinct()
    roots = inputs.select(F.rtrim(P.literal_prefix(F.col("path")), F.lit("/")).alias("up")).filter("up <> ''").distinct()
    under = asked.select("pattern", F.explode(upwards(F.col("at"))).alias("up")).join(roots, "up", "left_semi").select("pattern").distinct()
    return asked.select("pattern").join(under, "pattern", "left_anti")


def outside_targets(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(path): where resolved links (target, state) lead out of all roots; each place once, those below another left out."""
    found = links.filter("state = 'resolved'").select(F.col("target").alias("path")).distinct()
    return incremental.minimal_cover(incremental.covered(found, roots, anti=True))


def declared_files(declared: DataFrame, inventory: DataFrame) -> DataFrame:
    """(task_id, declared, path, hash) of the inventory's files that a task's declared paths stand for: the file itself, all
    files below a directory, or the files that a glob matches (by name alone if it holds no slash). A path that looks like a
    glob but is there as it is stands for itself. A declaration that finds nothing gives one row with a null path.

    Files are matched with distinct declarations; tasks are joined last, so a header that every task names is matched once.
    """
    wanted = declared.select(F.col("path").alias("declared")).filter("declared is not null").distinct()
    files = inventory.select("path", "hash", F.lower("path").alias("low"), F.lower(P.basename(F.col("path"))).alias("name"))
    glob = P.is_glob(F.col("declared"))
    literal = wanted.filter(glob).join(files.select(F.col("path").alias("declared")), "declared", "left_semi")
    globs = wanted.filter(glob).join(literal, "declared", "left_anti")
    plain = lineage.at_or_below(files.select("path", "hash"), wanted.filter(~glob).unionByName(literal), "path", "declared")
    slash = F.col("declared").contains("/")
    by_path = lineage.path_matches(files, globs.filter(slash), "low", "declared")
    by_name = lineage.path_matches(files, globs.filter(~slash), "name", "declared")
    found = plain.unionByName(files.join(by_path, "low").select("path", "declared")).unionByName(files.join(by_name, "name").select("path", "declared")).distinct()
    found = found.join(inventory.select("path", "hash"), "path")
    return declared.select("task_id", F.col("path").alias("declared")).distinct().join(found, "declared", "left").select("task_id", "declared", "path", "hash")


def unmatched(found: DataFrame) -> DataFrame:
    """(task_id, declared, error) of the declarations of declared_files() that found nothing."""
    error = F.when(P.is_glob(F.col("declared")), "matches nothing").otherwise("not found")
    return found.filter("path is null").select("task_id", "declared", error.alias("error"))


def edit_targets(targets: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (path, ...) that targets (path) name or match, each once; and (declared, error) of the targets that find nothing,
    for which the whole request is to be refused."""
    found = declared_files(targets.select(F.lit(0).alias("task_id"), "path"), files.select("path", F.lit("").alias("hash")))
    return files.join(found.select("path").distinct(), "path", "left_semi"), unmatched(found).select("declared", "error")
