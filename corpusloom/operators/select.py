"""Which files of an inventory: globs, regular expressions, excludes, names, directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.plans import globs as G


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def java_regex(spark, pattern: str) -> str:
    """The pattern, if Java accepts it; an invalid one raises before any job starts."""
    spark._jvm.java.util.regex.Pattern.compile(pattern)
    return pattern


def include(path: Column, rel: Column, globs: list[str] = (), regexes: list[str] = ()) -> Column:
    """Any glob or any regular expression; nothing given, or an empty glob, takes everything."""
    if (not globs and not regexes) or "" in globs:
        return F.lit(True)
    low, name = F.lower(rel), F.lower(P.basename(path))
    conditions = [(low if G.tests_path(g) else name).rlike(G.to_regex(g)) for g in globs]
    return any_of(conditions + [rel.rlike("(?i)" + r) for r in regexes])


def exclude(path: Column, rel: Column, patterns: list[str]) -> Column:
    """Literal paths take their subtree with them; globs match the absolute path, the relative one, or the name."""
    e = G.classify_excludes(list(patterns))
    under = lambda p, d: (p == d) | p.startswith(d + "/")
    conditions = [under(path, d) for d in e.literal_abs] + [under(rel, d) for d in e.literal_rel]
    conditions += [F.lower(path).rlike(G.to_regex(g)) for g in e.glob_abs] + [F.lower(rel).rlike(G.to_regex(g)) for g in e.glob_rel]
    return any_of(conditions + [F.lower(P.basename(path)).rlike(G.to_regex(g)) for g in e.names])


def select_files(files: DataFrame, root: str, globs: list[str] = (), regexes: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """Rows of files (path, ...) below root that match, with rel; excludes win over includes.

    The root and the literal prefixes of absolute patterns are plain prefix tests, which Spark pushes into the scan.
    """
    for r in regexes:
        java_regex(files.sparkSession, r)
    rel = P.relative(F.col("path"), F.lit(root))
    below = files.filter(F.col("path").startswith(root.rstrip("/") + "/")).withColumn("rel", rel)
    return below.filter(include(F.col("path"), F.col("rel"), list(globs), list(regexes)) & ~exclude(F.col("path"), F.col("rel"), list(excludes)))


def with_directories(files: DataFrame, root: str) -> DataFrame:
    """(path, kind, parent, name, depth): the files and all directories that their paths imply, below root."""
    up = files.select(F.explode(P.ancestors(F.col("path"))).alias("path")).filter(F.col("path").startswith(root.rstrip("/") + "/")).distinct().withColumn("kind", F.lit("directory"))
    rows = files.filter(F.col("path").startswith(root.rstrip("/") + "/")).select("path", F.lit("file").alias("kind")).unionByName(up)
    p = F.col("path")
    return rows.select("path", "kind", P.dirname(p).alias("parent"), P.basename(p).alias("name"), (P.depth(p) - len([x for x in root.split("/") if x])).alias("depth"))


def list_directory(entries: DataFrame, directory: str) -> DataFrame:
    return entries.filter(F.col("parent") == directory).orderBy("name")


def tree(entries: DataFrame, depth: int = 5) -> DataFrame:
    """Entries down to a depth (negative: all), in path order."""
    return (entries if depth < 0 else entries.filter(F.col("depth") <= depth)).orderBy("path")


def info(entries: DataFrame) -> DataFrame:
    """(path, type, size, modified, mode, permissions) of entries (path, kind, size, mtime_ns, mode); times in UTC, mode in octal. With
    created, if entries have created_ns."""
    mode = F.col("mode").cast("int")
    kind = F.when(F.col("kind") == "link", "symlink").otherwise(F.col("kind"))
    created = [P.iso_utc(F.col("created_ns")).alias("created")] if "created_ns" in entries.columns else []
    return entries.select("path", kind.alias("type"), "size", *created, P.iso_utc(F.col("mtime_ns")).alias("modified"), P.octal_mode(mode).alias("mode"), P.permissions(kind, mode).alias("permissions"))


def nested_tree(entries: DataFrame, depth: int = 5) -> DataFrame:
    """(path, json) of each entry of depth 1: name, kind and, for directories above the given depth, children in the order of
    their names. Levels are joined from the deepest up, so a task holds no more than the subtree it writes."""
    name = F.concat(F.lit('{"name":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(',"kind":"'), F.col("kind"), F.lit('"'))
    below = None
    for level in range(depth, 0, -1):
        here = entries.filter(F.col("depth") == level).select("path", "parent", "name", "kind", name.alias("head"))
        inner = F.lit("")
        if below is not None:
            listed = below.groupBy(F.col("parent").alias("path")).agg(F.expr("listagg(json, ',') within group (order by name, kind)").alias("children"))
            here = here.join(listed, "path", "left")
            inner = F.when(F.col("kind") == "directory", F.concat(F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]"))).otherwise("")
        below = here.select("path", "parent", "name", "kind", F.concat("head", inner, F.lit("}")).alias("json"))
    return below.select("path", "json")


def find_by_name(entries: DataFrame, part: str, most: int = 1000) -> DataFrame:
    return capped(entries.filter(F.lower("name").contains(part.lower())), [F.col("path")], most)


def capped(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows in an order, with truncated: whether the cap was reached."""
    top = rows.orderBy(*order).limit(most)
    n = top.count()
    return top.withColumn("truncated", F.lit(n >= most))


def pattern_matches(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, pattern) for many globs on relative paths: an equi-join of each path's ancestors with the globs' literal prefixes
    leaves few candidates for the regular expression. Spark chooses how the pattern table is joined, by its size."""
    spark = files.sparkSession
    rows = [(p, "/" + G.literal_prefix(p).strip("/"), G.to_regex(p)) for p in patterns]
    table = spark.createDataFrame(rows, "pattern string, prefix string, regex string")
    up = files.select("path", "rel", F.explode(F.concat(F.array(F.lit("/")), P.ancestors(F.concat(F.lit("/"), F.col("rel")), proper=False))).alias("prefix"))
    return up.join(table, "prefix").filter(F.expr("lower(rel) rlike regex")).select("path", "pattern")
