"""Symbolic links of a scanned tree: where each hop leads, and what lies beyond links that leave a root.

entries: (path, kind, target) of real paths, kind being file, link or directory, as sources.tree.scan_tree(directories=True) gives
them. A target is relative to the directory that its link's path names; '.' and '..' are dropped by name, before links are looked
at. A path whose directories are themselves links stands for the place that they lead to.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.sources.corpus import written

#: Links that the directories of one path may lead through, as on most systems; beyond them the path is nowhere.
MOST_TURNS = 40


def _joined(link: Column, target: Column) -> Column:
    """The place that a link's target names, without '.' and '..'."""
    return P.normalize(F.when(target.startswith("/"), target).otherwise(F.concat(P.dirname(link), F.lit("/"), target)))


def canonical(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, real) of distinct absolute paths: the first directory of a path that is a link (path, target) is replaced by what it
    names, again and again, until no directory is one. The last name stays, link or not. real is null for paths that run in circles."""
    table = links.select(F.col("path").alias("up"), "target")
    now = written(paths.select("path").distinct().withColumn("real", F.col("path")))
    done = []
    for turn in range(MOST_TURNS + 1):
        up = now.select("path", "real", F.explode(P.ancestors(F.col("real"))).alias("up")).join(table, "up")
        first = up.groupBy("path", "real").agg(F.min_by(F.struct("up", "target"), F.length("up")).alias("via"))  # at most a row for each name of the path
        moved = first.select("path", P.normalize(F.concat(_joined(F.col("via.up"), F.col("via.target")), F.col("real").substr(F.length("via.up") + 1, F.length("real")))).alias("next"))
        both = written(now.join(moved, "path", "left"))
        done.append(both.filter("next is null").select("path", "real"))
        now = both.filter("next is not null").select("path", F.col("next").alias("real"))
        if now.isEmpty():
            break
        if turn == MOST_TURNS:
            done.append(now.select("path", F.lit(None).cast("string").alias("real")))
    return reduce(DataFrame.unionByName, done)


def steps(links: DataFrame, entries: DataFrame) -> DataFrame:
    """(place, next, kind) for links (path, target), and all links that they lead to: next is what the link at place names, kind what is
    there (absent if nothing is). Each path is looked up once, however many links lead over it."""
    real = written(entries.select("path", "kind", "target"))
    through = real.filter("kind = 'link'").select("path", "target")
    front = written(links.select(F.col("path").alias("place"), "target").distinct())
    known: list[DataFrame] = []
    while True:
        led = written(front.select("place", _joined(F.col("place"), F.col("target")).alias("next")))
        places = canonical(led.select(F.col("next").alias("path")), through).withColumnRenamed("path", "next")
        found = written(places.join(real.withColumnRenamed("path", "real"), "real", "left").select("next", F.coalesce("kind", F.lit("absent")).alias("kind"), "target"))
        known.append(led.join(found.select("next", "kind"), "next").select("place", "next", "kind"))
        seen = reduce(DataFrame.unionByName, known).select("place")
        front = written(found.filter("kind = 'link'").select(F.col("next").alias("place"), "target").join(seen, "place", "left_anti"))
        if front.isEmpty():
            return written(reduce(DataFrame.unionByName, known))


def hops(links: DataFrame, entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, hop, place, kind, state): each place that a link leads over, hop by hop from 1, and how its chain ends: resolved, broken
    (at the last place there is nothing) or cycle (the last place leads back to an earlier one, or to the link itself).

    Jumps double each round, so a chain costs the logarithm of its length in joins; its rows are as many as its hops. known: steps().
    """
    step = known if known is not None else steps(links, entries)
    rows = written(step.select(F.col("place").alias("path"), F.lit(1).alias("hop"), F.col("next").alias("place"), "kind"))
    jump = written(step.filter("kind = 'link'").select(F.col("place").alias("path"), F.col("next").alias("to")))
    size, length = rows.count(), 1
    while not jump.isEmpty():
        further = jump.join(rows.withColumnRenamed("path", "to"), "to").select("path", (F.col("hop") + length).alias("hop"), "place", "kind")
        rows = written(rows.unionByName(further).groupBy("path", "place", "kind").agg(F.min("hop").alias("hop")))
        if size == (size := rows.count()):
            break
        on = jump.select(F.col("path").alias("to"), F.col("to").alias("end"))
        jump = written(jump.join(on, "to").select("path", F.col("end").alias("to")))
        length *= 2
    last = rows.groupBy("path").agg(F.max_by("kind", "hop").alias("last"))
    state = F.when(F.col("last") == "link", "cycle").when(F.col("last") == "absent", "broken").otherwise("resolved")
    wanted = links.select("path").distinct()
    return rows.join(last.join(wanted, "path", "left_semi"), "path").select("path", "hop", "place", "kind", state.alias("state"))


def follow(entries: DataFrame, root: str, wanted: Callable[[Column, Column], Column] | None = None, excluded: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(path, kind, base, via) of the files and links below root, and of all that links there lead to outside of it.

    Every hop of a link's chain that lies outside of its base counts: a file or link as itself, a directory as a further base, whose
    links are followed in turn; each base is walked once. wanted and excluded are conditions on (path, path below its base), as
    select.include() and select.exclude() give them; a single place is held against wanted by its whole path. Excluded links are
    not followed. via: the least link that leads to the base or the place, null below root.
    """
    keep = wanted or (lambda path, rel: F.lit(True))
    drop = excluded or (lambda path, rel: F.lit(False))
    real = written(entries.select("path", "kind", "target"))
    through = real.filter("kind = 'link'").select("path", "target")
    path, base = F.col("path"), F.col("base")
    rel = F.when(path.startswith(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))), path.substr(F.length(F.rtrim(base, F.lit("/"))) + 2, F.length(path))).otherwise(F.lit(""))
    spark = entries.sparkSession
    front = written(spark.createDataFrame([(root.rstrip("/") or "/", None)], "base string, via string"))
    bases, out = [front], []
    while True:
        places = canonical(front.select(F.concat(F.rtrim(base, F.lit("/")), F.lit("/.")).alias("path")), through)  # with a name below, so that a base that is a link is followed
        homes = places.select(F.regexp_replace("path", r"/\.$", "").alias("base"), F.regexp_replace("real", r"/\.?$", "").alias("real"))
        homes = written(front.join(homes.select(F.when(base == "", F.lit("/")).otherwise(base).alias("base"), "real"), "base"))
        # each real directory above an entry may be a base's: as many candidates as a path has directories
        up = real.filter("kind <> 'directory'").select(F.col("path").alias("there"), "kind", "target", F.explode(F.concat(F.array(F.lit("")), P.ancestors(path))).alias("real"))
        below = up.join(homes, "real").select("base", "via", F.concat(F.rtrim(base, F.lit("/")), F.col("there").substr(F.length("real") + 1, F.length("there"))).alias("path"), "kind", "target")
        inside = written(below.filter(~drop(path, rel)))
        out.append(inside.filter(keep(path, rel)).select("path", "kind", "base", "via"))
        linked = inside.filter("kind = 'link'").select("path", "target", "base")
        if linked.isEmpty():
            break
        led = hops(linked, real).select(F.col("path").alias("link"), "place", "kind").join(linked.select(F.col("path").alias("link"), "base"), "link")
        under = (F.col("place") == base) | F.col("place").startswith(F.concat(F.rtrim(base, F.lit("/")), F.lit("/")))
        beyond = written(led.filter("kind <> 'absent'").filter(~under).groupBy("place", "kind").agg(F.min("link").alias("via")).withColumnRenamed("place", "path"))
        beyond = beyond.withColumn("base", F.lit(root)).filter(~drop(path, rel))
        out.append(beyond.filter("kind <> 'directory'").filter(keep(path, path)).select("path", "kind", F.lit(None).cast("string").alias("base"), "via"))
        seen = reduce(DataFrame.unionByName, bases).select("base")
        front = written(beyond.filter("kind = 'directory'").select(path.alias("base"), "via").join(seen, "base", "left_anti"))
        if front.isEmpty():
            break
        bases.append(front)
    every = reduce(DataFrame.unionByName, out)
    # a place that several ways lead to counts once: below the root first, then by the least link
    return every.groupBy("path", "kind").agg(F.min(F.struct(F.col("via").isNotNull().alias("far"), "via", "base")).alias("w")).select("path", "kind", "w.base", "w.via")
