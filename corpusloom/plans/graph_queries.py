"""Registered queries over playlists, task graphs and links, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import factored, incremental, lineage
from corpusloom.plans.queries import TASKS, _table, task_paths

#: Variables of the playlist; its steps name another one that is not set.
ENV = {"HOME": "/home/me"}


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def playlist(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the steps of a playlist, in groups of 600: every twelfth one of a kind, and two steps of a group in a cycle."""
    k, g = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 600)
    kind, place = k % 12, k % 600
    at = lambda *p: _text("/g", g, *p)
    cycle = place.isin(11, 23)
    action = F.when(cycle, "execute")
    for m, name in enumerate(("clone", "execute", "execute", "info", "execute", "create", "create", "read", "edit", "edit", "move", "delete")):
        action = action.when(kind == m, name)
    items = (
        F.when(kind == 7, F.array(at("/dir/", k - 2, "/x.txt"), F.lit("${HOME}/y"), F.lit("${NOT_SET}/z")))
        .when(kind == 8, F.array(at("/gen/", k - 8, ".h"))).when(kind == 9, F.array(at("/gen/*", k % 10, ".h")))
        .when(kind == 10, F.array(at("/in/", k, ".a"), at("/in/", k, ".b"))).when((kind == 11) & ~cycle, F.array(at("/moved/", k - 1, ".a")))
    )
    inputs = (
        F.when(place == 11, F.array(at("/cycle/a"))).when(place == 23, F.array(at("/cycle/b"))).when(kind == 1, F.array(at("/gen/*.h"), _text("/G", g, "/conf")))
        .when(kind == 2, F.array(at("/obj/", k - 1, ".o"), F.lit("${NOT_SET}"))).when(kind == 4, F.array(at("/out/", k % 10, "*.bin")))
    )
    outputs = F.when(place == 11, F.array(at("/cycle/b"))).when(place == 23, F.array(at("/cycle/a"))).when(kind == 1, F.array(at("/obj/", k, ".o"))).when(kind == 2, F.array(at("/out/*.bin")))
    return _table(spark, d, "orders").select(
        F.lit("").alias("key"), k.alias("seq"),
        F.struct(
            action.alias("action"), F.when(kind == 0, _text("/src/", F.col("o_custkey"), ".h")).alias("from"), F.when(kind == 0, at("/gen/", k, ".h")).alias("to"),
            items.alias("items"), F.when(kind == 10, at("/moved")).alias("destination directory"), F.when(kind == 6, at("/dir/", k - 1, "/f.txt")).alias("file"),
            F.when(kind == 5, at("/dir/", k)).alias("directory"), F.when(kind == 3, at("/out/", k, ".bin")).alias("path"), F.lit("/bin/tool").alias("tool"),
            inputs.alias("inputs"), outputs.alias("outputs"), F.when((kind == 9) & (k % 2 == 1), True).alias("dry-run"), F.when(k % 60 == 0, False).alias("cache"),
        ).alias("step"),
    )


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return lineage.expand_steps(playlist(spark, d), ENV)


def playlist_tasks(spark: SparkSession, d: str) -> DataFrame:
    paths = F.array_join(F.transform("paths", lambda x: F.concat(x["role"], F.lit("="), x["path"])), ",")
    return _tasks(spark, d).select("task_id", "action", "item", "cacheable", "existence_only", paths.alias("paths"))


def playlist_edges(spark: SparkSession, d: str) -> DataFrame:
    return factored.reasons(factored.relations(lineage.paths_of(factored.numbered(_tasks(spark, d)))))


def _waves(spark: SparkSession, d: str) -> tuple[factored.Relations, DataFrame]:
    tasks = factored.numbered(_tasks(spark, d))
    rel = factored.relations(lineage.paths_of(tasks))
    return rel, lineage.written(factored.waves(tasks, rel))


def playlist_waves(spark: SparkSession, d: str) -> DataFrame:
    """The wave of each task, or, of those on or behind a cycle, for how many others it still waits."""
    rel, wave = _waves(spark, d)
    return wave.join(factored.cycle_report(rel, wave), "task_id", "left").select("task_id", "wave", "waiting")


def playlist_widths(spark: SparkSession, d: str) -> DataFrame:
    return lineage.widths(_waves(spark, d)[1])


def playlist_reach(spark: SparkSession, d: str) -> DataFrame:
    """How far the tasks lie behind a change of some, over factored edges."""
    tasks = factored.numbered(_tasks(spark, d))
    return factored.dirty(factored.relations(lineage.paths_of(tasks)), tasks.filter("seq.seq % 2400 = 1200").select("task_id", "task"))


def static_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that wait for nothing: nothing leads to them in the factored edges either, and these grow with the declarations, not as pairs do."""
    tasks = factored.numbered(_tasks(spark, d))
    edge = factored.edges(factored.relations(lineage.paths_of(tasks)))
    return factored.static_tasks(tasks, edge)


def task_degrees(spark: SparkSession, d: str) -> DataFrame:
    return lineage.degrees(lineage.edges(task_paths(spark, d)))


def conflict_paths(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks whose declarations contradict each other in every way that conflicts() knows."""
    k = F.col("o_orderkey")
    kind, home = k % 7, _text("/E/", k % 300)
    entry = lambda role, path: F.struct(F.lit(role).alias("role"), path.alias("path"))
    declared = (
        F.when(kind == 0, F.array(entry("output", _text("/d/", k % 400, "/x")))).when(kind == 1, F.array(entry("exclusive", home), entry("input", F.concat(home, F.lit("/own")))))
        .when(kind == 2, F.array(entry("input", home))).when(kind == 3, F.array(entry("input", F.concat(home, F.lit("/sub/f")))))
        .when(kind == 4, F.array(entry("output", _text(home, "/made/", k)), entry("output", _text(home, "/made/", k, "/deep"))))
        .when(kind == 5, F.array(entry("mutating", home))).otherwise(F.array(entry("mutating", _text("/e/", k % 300, "/edited/", k))))
    )
    return _table(spark, d, "orders").select(k.alias("task_id"), k.alias("seq"), F.explode(declared).alias("x")).select("task_id", "seq", "x.*")


def playlist_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return lineage.conflicts(conflict_paths(spark, d))


def rerun_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """What runs again after a change if every third task makes the same outputs as before."""
    paths = task_paths(spark, d, customers=False)
    world = lambda c: paths.select("task_id").distinct().withColumn("world", c)
    same = incremental.unchanged_outputs(world(F.lit("w")), world(F.when(F.col("task_id") % 3 == 0, "w").otherwise("x")))
    return lineage.dirty(lineage.edges(paths), paths.filter("task_id % 1009 = 7").select("task_id"), same)


def chain_waves(spark: SparkSession, d: str) -> DataFrame:
    """Orders as one chain for each customer modulo 3, so that a chain is as long as a third of the table."""
    o = _table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("c"))
    edge = o.filter("o_orderkey >= 3").select((F.col("o_orderkey") - 3).alias("src"), F.col("o_orderkey").alias("dst"))
    return lineage.waves(o.select(F.col("o_orderkey").alias("task_id")), edge)


def link_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Orders as links to the order a seventh of their number, but a twentieth of them to their neighbour and back."""
    k = F.col("o_orderkey")
    target = F.when(k % 40 == 8, k + 1).when(k % 40 == 9, k - 1).otherwise(F.floor(k / 7))
    o = _table(spark, d, "orders").filter("o_orderkey > 0")
    return lineage.resolve_links(o.select(k.alias("path"), target.cast("long").alias("target"), F.lit(True).alias("exists")))


def linked_files(spark: SparkSession, d: str) -> DataFrame:
    """Files below one source, and those that links lead to from there."""
    docs = _table(spark, d, "documents").filter("source is not null and lang is not null")
    files = docs.select(_text("/corpus/", F.col("source"), "/", F.col("lang"), "/doc_", F.col("doc_id"), ".txt").alias("path"))
    s = docs.groupBy("source").agg(F.min("doc_id").alias("m"))
    links = s.filter("source <> 'src0' and m % 2 = 0").select(_text("/corpus/src0/links/", F.col("source")).alias("path"), _text("/corpus/", F.col("source"), "/en").alias("target"), F.lit(True).alias("exists"))
    return lineage.follow(files, links, "/corpus/src0").groupBy("via").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


QUERIES = {f.__name__: f for f in (playlist_tasks, playlist_edges, playlist_waves, playlist_widths, playlist_reach, static_tasks, task_degrees, playlist_conflicts, rerun_cutoff, chain_waves, link_cycles, linked_files)}

_STEPS = """
o AS (SELECT o_orderkey AS k, o_orderkey // 600 AS g, o_orderkey % 12 AS m, o_orderkey % 600 AS p, o_custkey AS c FROM orders),
r AS (
  SELECT k, 0 AS i, unnest([{'role': 'input', 'path': '/src/' || c || '.h'}, {'role': 'output', 'path': '/g' || g || '/gen/' || k || '.h'}]) AS x FROM o WHERE m = 0
  UNION ALL SELECT k, 0, unnest([{'role': 'input', 'path': '/g' || g || '/gen/*.h'}, {'role': 'input', 'path': '/G' || g || '/conf'}, {'role': 'output', 'path': '/g' || g || '/obj/' || k || '.o'}]) FROM o WHERE m = 1
  UNION ALL SELECT k, 0, unnest([{'role': 'input', 'path': '/g' || g || '/obj/' || (k - 1) || '.o'}, {'role': 'output', 'path': '/g' || g || '/out/*.bin'}]) FROM o WHERE m = 2
  UNION ALL SELECT k, 0, {'role': 'input', 'path': '/g' || g || '/out/' || k || '.bin'} FROM o WHERE m = 3
  UNION ALL SELECT k, 0, {'role': 'input', 'path': '/g' || g || '/out/' || (k % 10) || '*.bin'} FROM o WHERE m = 4
  UNION ALL SELECT k, 0, {'role': 'output', 'path': '/g' || g || '/dir/' || k} FROM o WHERE m = 5
  UNION ALL SELECT k, 0, {'role': 'output', 'path': '/g' || g || '/dir/' || (k - 1) || '/f.txt'} FROM o WHERE m = 6
  UNION ALL SELECT k, 0, {'role': 'input', 'path': '/g' || g || '/dir/' || (k - 2) || '/x.txt'} FROM o WHERE m = 7 UNION ALL SELECT k, 1, {'role': 'input', 'path': '/home/me/y'} FROM o WHERE m = 7
  UNION ALL SELECT k, 0, {'role': 'mutating', 'path': '/g' || g || '/gen/' || (k - 8) || '.h'} FROM o WHERE m = 8
  UNION ALL SELECT k, 0, {'role': 'mutating', 'path': '/g' || g || '/gen/*' || (k % 10) || '.h'} FROM o WHERE m = 9
  UNION ALL SELECT k, i, unnest([{'role': 'exclusive', 'path': '/g' || g || '/in/' || k || e}, {'role': 'output', 'path': '/g' || g || '/moved/' || k || e}]) FROM o, (VALUES (0, '.a'), (1, '.b')) AS v(i, e) WHERE m = 10
  UNION ALL SELECT k, 0, {'role': 'exclusive', 'path': '/g' || g || '/moved/' || (k - 1) || '.a'} FROM o WHERE m = 11 AND p NOT IN (11, 23)
  UNION ALL SELECT k, 0, unnest([{'role': 'input', 'path': '/g' || g || '/cycle/a'}, {'role': 'output', 'path': '/g' || g || '/cycle/b'}]) FROM o WHERE p = 11
  UNION ALL SELECT k, 0, unnest([{'role': 'input', 'path': '/g' || g || '/cycle/b'}, {'role': 'output', 'path': '/g' || g || '/cycle/a'}]) FROM o WHERE p = 23),
tp AS (SELECT k || '/' || i AS t, k, i, k // 600 AS g, x.role AS role, lower(x.path) AS path, contains(x.path, '*') AS glob FROM r)"""

_EDGES = (
    _STEPS
    + """,
used AS (SELECT * FROM tp WHERE role IN ('input', 'exclusive')), made AS (SELECT * FROM tp WHERE role = 'output'), mut AS (SELECT * FROM tp WHERE role = 'mutating'),
meets AS (SELECT a.t AS src, b.t AS dst, a.role, (a.k, a.i) < (b.k, b.i) AS before FROM tp a JOIN mut b ON a.g = b.g AND a.t <> b.t
  AND (a.path = b.path OR NOT a.glob AND b.glob AND a.path GLOB b.path OR a.glob AND NOT b.glob AND b.path GLOB a.path OR a.glob AND b.glob AND contains(a.path, '/gen/') AND (a.role = 'input' OR a.path = b.path))),
chain AS (SELECT DISTINCT src, dst FROM meets WHERE role = 'mutating' AND before), settled AS (SELECT src, dst FROM chain UNION SELECT dst, src FROM chain),
every AS (
  SELECT a.t AS src, b.t AS dst, 'explicit' AS reason FROM made a JOIN used b ON a.path = b.path AND NOT a.glob AND NOT b.glob
  UNION ALL SELECT a.t, b.t, 'ancestor' FROM made a JOIN used b ON a.path = regexp_extract(b.path, '^(.*)/[^/]+$', 1) AND NOT b.glob WHERE b.path NOT IN (SELECT path FROM made)
  UNION ALL SELECT a.t, b.t, 'implicit' FROM made a JOIN tp b ON b.role IN ('output', 'mutating') AND NOT b.glob AND a.path = regexp_extract(b.path, '^(.*)/[^/]+$', 1)
  UNION ALL SELECT a.t, b.t, 'glob' FROM made a JOIN used b ON a.g = b.g AND (a.glob AND NOT b.glob AND b.path GLOB a.path OR NOT a.glob AND b.glob AND a.path GLOB b.path OR a.glob AND b.glob)
    WHERE NOT (a.glob AND b.glob) OR contains(a.path, '/out/') AND contains(b.path, '/out/')
  UNION ALL SELECT src, dst, 'mutators' FROM chain
  UNION ALL SELECT src, dst, 'maker' FROM meets ANTI JOIN settled USING (src, dst) WHERE role = 'output'
  UNION ALL SELECT src, dst, 'reader' FROM (SELECT CASE WHEN before THEN src ELSE dst END AS src, CASE WHEN before THEN dst ELSE src END AS dst FROM meets WHERE role = 'input') ANTI JOIN settled USING (src, dst)),
e AS (SELECT src, dst, min(reason) AS reason FROM every WHERE src <> dst GROUP BY src, dst)"""
)
_WAVES = (
    _EDGES
    + """,
n AS (SELECT DISTINCT t FROM (SELECT t FROM tp UNION ALL SELECT k || '/0' FROM o) ), bad AS (SELECT k || '/0' AS t FROM o WHERE p IN (11, 23)),
lv(t, wave) AS (SELECT t, 0 FROM n WHERE t NOT IN (SELECT dst FROM e) UNION SELECT e.dst, lv.wave + 1 FROM lv JOIN e ON e.src = lv.t),
w AS (SELECT t, CAST(max(wave) AS INT) AS wave FROM lv GROUP BY t)"""
)
_DAG = "g AS (SELECT DISTINCT b AS src, t AS dst FROM l WHERE b IN (SELECT o_orderkey FROM orders) AND b <> t)"
ORACLE = {
    "playlist_tasks": f"""WITH {_STEPS}, a AS (SELECT k, i, string_agg(x.role || '=' || x.path, ',' ORDER BY CASE x.role WHEN 'output' THEN 1 ELSE 0 END, x.path NOT LIKE '%*%') AS paths FROM r GROUP BY k, i)
      SELECT k || '/' || i AS task_id, CASE WHEN p IN (11, 23) THEN 'execute' ELSE ['clone', 'execute', 'execute', 'info', 'execute', 'create', 'create', 'read', 'edit', 'edit', 'move', 'delete'][m + 1] END AS action, CAST(i AS INT) AS item,
      k % 60 <> 0 AND CASE WHEN p IN (11, 23) THEN true WHEN m IN (2, 3, 4, 7) THEN false WHEN m = 9 THEN k % 2 = 0 ELSE true END AS cacheable, m = 5 AS existence_only, paths FROM a JOIN o USING (k)""",
    "playlist_edges": f"WITH {_EDGES} SELECT src, dst, reason FROM e",
    "playlist_waves": f"WITH RECURSIVE {_WAVES} SELECT t AS task_id, wave, CASE WHEN wave IS NULL THEN 1::BIGINT END AS waiting FROM n LEFT JOIN w USING (t)",
    "playlist_widths": f"WITH RECURSIVE {_WAVES} SELECT wave, count(*) AS width, (SELECT max(wave) + 1 FROM w)::BIGINT AS critical FROM w GROUP BY wave",
    "playlist_reach": f"""WITH RECURSIVE {_EDGES}, w(t, distance) AS (SELECT t, 0 FROM (SELECT DISTINCT t FROM tp WHERE k % 2400 = 1200) UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.t WHERE w.distance < 8)
      SELECT t AS task_id, min(distance) AS distance FROM w GROUP BY t""",
    "static_tasks": f"WITH {_EDGES} SELECT DISTINCT t AS task_id FROM tp WHERE t NOT IN (SELECT dst FROM e)",
    "task_degrees": f"WITH {TASKS}, x AS (SELECT dst AS task_id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) SELECT task_id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM x GROUP BY task_id",
    "playlist_conflicts": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS m, '/e/' || (o_orderkey % 300) AS h FROM orders),
      ex AS (SELECT h, min(k) AS k FROM o WHERE m = 1 GROUP BY h)
      SELECT 'duplicate producer' AS rule, '/d/' || (k % 400) || '/x' AS path, count(*) AS n FROM o WHERE m = 0 GROUP BY k % 400 HAVING count(*) > 1
      UNION ALL SELECT 'shared exclusive', h, count(*) FROM o WHERE m IN (1, 2) GROUP BY h HAVING count(*) > 1 AND bool_or(m = 1)
      UNION ALL SELECT 'consumer under exclusive', h || CASE m WHEN 1 THEN '/own' ELSE '/sub/f' END, count(*) FROM o WHERE m IN (1, 3) AND h IN (SELECT h FROM ex) GROUP BY h, m
      UNION ALL SELECT 'producer under exclusive', h || CASE m WHEN 4 THEN '/made/' ELSE '/edited/' END || k, 1 FROM o WHERE m IN (4, 6) AND h IN (SELECT h FROM ex)
      UNION ALL SELECT 'producer under exclusive', h || '/made/' || k || '/deep', 1 FROM o WHERE false
      UNION ALL SELECT 'mutate vs exclusive', o.h, count(*) FROM o JOIN ex ON o.h = ex.h AND ex.k < o.k WHERE m = 5 GROUP BY o.h""",
    "rerun_cutoff": f"""WITH RECURSIVE {TASKS}, {_DAG},
      w(task_id, distance) AS (SELECT t, 0 FROM (SELECT DISTINCT t FROM tp WHERE path NOT LIKE '/customer/%') WHERE t % 1009 = 7 UNION SELECT g.dst, w.distance + 1 FROM w JOIN g ON g.src = w.task_id WHERE g.src % 3 <> 0)
      SELECT task_id, CAST(min(distance) AS INT) AS distance FROM w GROUP BY task_id""",
    "chain_waves": "SELECT o_orderkey AS task_id, CAST(row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1 AS INT) AS wave FROM orders",
    "link_cycles": """WITH RECURSIVE l AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 40 = 8 THEN o_orderkey + 1 WHEN o_orderkey % 40 = 9 THEN o_orderkey - 1 ELSE o_orderkey // 7 END AS target FROM orders WHERE o_orderkey > 0),
      w(path, target, hops) AS (SELECT path, target, 1 FROM l UNION SELECT w.path, l.target, hops + 1 FROM w JOIN l ON w.target = l.path WHERE hops < 12),
      f AS (SELECT path, min(hops) AS hops FROM w WHERE target NOT IN (SELECT path FROM l) GROUP BY path)
      SELECT path, coalesce(CASE WHEN f.hops IS NOT NULL THEN w.target END, l.target) AS target, CAST(f.hops AS INT) AS hops, CASE WHEN f.hops IS NULL THEN 'cycle' ELSE 'resolved' END AS state
      FROM l LEFT JOIN f USING (path) LEFT JOIN w ON w.path = l.path AND w.hops = f.hops""",
    "linked_files": """WITH f AS (SELECT source, lang, '/corpus/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
      s AS (SELECT source FROM (SELECT source, min(doc_id) AS m FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source) WHERE source <> 'src0' AND m % 2 = 0)
      SELECT NULL::VARCHAR AS via, count(*) AS n, min(path) AS first_path FROM f WHERE source = 'src0' HAVING count(*) > 0
      UNION ALL SELECT '/corpus/src0/links/' || source, count(*), min(path) FROM f JOIN s USING (source) WHERE lang = 'en' GROUP BY source""",
}
