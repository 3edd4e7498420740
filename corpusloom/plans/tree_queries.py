"""Registered queries over a directory tree that is made from documents, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import links, select
from corpusloom.plans.queries import _table
from corpusloom.sources import tree
from corpusloom.sources.corpus import shared_dir, written

#: What the tree has for a document d of source s and language l: (condition, kind, path, target).
MADE = [
    ("true", "file", "s || '/' || l || '/doc_' || d || '.txt'", None),
    ("d % 10 = 3", "link", "s || '/links/l_' || d", "'../' || l || '/doc_' || d || '.txt'"),
    ("d % 10 = 5", "link", "s || '/links/c_' || d", "'l_' || (d - 2)"),
    ("d % 50 = 7", "link", "s || '/links/o_' || d", "'../../src' || d % 20 || '/en'"),
    ("d % 50 = 9", "link", "s || '/links/x_' || d", "'y_' || d"),
    ("d % 50 = 9", "link", "s || '/links/y_' || d", "'./x_' || d"),
    ("d % 50 = 11", "link", "s || '/links/a_' || d", "root || '/' || s || '/links/b_' || d"),
    ("d % 50 = 11", "link", "s || '/links/b_' || d", "'../../' || s || '/links/../' || l || '/doc_' || d || '.txt'"),
    ("d % 50 = 17", "link", "s || '/links/d_' || d", "'../' || l"),
    ("d % 50 = 17", "link", "s || '/links/m_' || d", "'d_' || d || '/doc_' || d || '.txt'"),
    ("d % 100 = 1", "hard", "'hard/h_' || d", "root || '/' || s || '/' || l || '/doc_' || d || '.txt'"),
]


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """A scan of the tree, with its directories; and the path of its root, which is gone by then."""
    where = shared_dir(spark)
    if not where.startswith(("file:/", "/")):
        raise ValueError(f"{where} is no folder that can be mounted")
    root = f"/{where.removeprefix('file:').lstrip('/')}/corpusloom/tree-{uuid.uuid4().hex}"
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("d"), F.coalesce("source", F.lit("none")).alias("s"), F.coalesce("lang", F.lit("none")).alias("l"), "text", F.lit(root).alias("root"))
    content = F.when(F.col("kind") == "file", F.when(F.col("d") % 13 == 0, "").otherwise(F.coalesce("text", F.lit(""))))
    each = F.explode(F.filter(F.array(*(F.when(F.expr(c), F.struct(F.lit(k).alias("kind"), F.concat("root", F.lit("/"), F.expr(p)).alias("path"), F.expr(t or "cast(null as string)").alias("target"))) for c, k, p, t in MADE)), lambda x: x.isNotNull()))
    rows = docs.select("d", "text", each.alias("e")).select("d", "text", "e.*").withColumns({"mode": F.when(F.col("d") % 2 == 0, 0o644).otherwise(0o600), "mtime_ns": (F.lit(1_600_000_000).cast("long") + F.col("d")) * 1_000_000_000 + F.col("d")}).withColumn("content", content)
    tree.write_tree(rows.filter("kind <> 'hard'"))
    tree.write_tree(rows.filter("kind = 'hard'"))
    entries = written(tree.scan_tree(spark, [root], directories=True))
    tree.remove_tree(spark, root)
    return entries, root


def _shown(root: str) -> Callable[[str], F.Column]:
    """A path below the root, from the root on; anything else as it is."""
    return lambda c: F.when(F.col(c).startswith(root), F.expr(f"substring({c}, {len(root) + 1})")).otherwise(F.col(c)).alias(c)


def tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files, those without bytes too, and links of the tree, as they are on disk."""
    entries, root = _entries(spark, d)
    shown = _shown(root)
    size = F.when(F.col("target").startswith("/"), F.col("size") - len(root)).otherwise(F.col("size"))
    return entries.filter("kind <> 'directory'").select(shown("path"), "kind", size.alias("size"), "mtime_ns", "n_links", shown("target"), (F.col("inode") > 0).alias("has_inode"))


def tree_info(spark: SparkSession, d: str) -> DataFrame:
    """Metadata rows of the tree's files and links, by the times and modes that it was given."""
    entries, root = _entries(spark, d)
    rows = select.info(entries.filter("kind <> 'directory'"))
    return rows.select(_shown(root)("path"), "type", "modified", "mode", "permissions", (F.col("created") >= F.col("modified")).alias("changed_later"))


def link_hops(spark: SparkSession, d: str) -> DataFrame:
    """Each place that each link of the tree leads over."""
    entries, root = _entries(spark, d)
    shown = _shown(root)
    return links.hops(entries.filter("kind = 'link'"), entries).select(shown("path"), "hop", shown("place"), "kind", "state")


def tree_follow(spark: SparkSession, d: str) -> DataFrame:
    """What is below the directory of one source, and what its links lead to in others: text files and links, but no document of
    which the number ends in 4."""
    entries, root = _entries(spark, d)
    wanted = lambda path, rel: select.include(path, rel, ["*.txt", "l_*", "o_*"])
    excluded = lambda path, rel: select.exclude(path, rel, ["doc_*4.txt"])
    found = links.follow(entries, f"{root}/src0", wanted, excluded)
    shown = _shown(root)
    return found.select(shown("path"), "kind", shown("base"), shown("via"))


QUERIES = {f.__name__: f for f in (tree_scan, tree_info, link_hops, tree_follow)}

_DOCS = "t AS (SELECT doc_id AS d, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l, text, '' AS root FROM documents)"
_TREE = (
    _DOCS
    + ", e AS ("
    + " UNION ALL ".join(f"SELECT d, s, l, '{k}' AS kind, '/' || {p} AS path, {t or 'NULL'} AS target, text FROM t WHERE {c}" for c, k, p, t in MADE)
    + ")"
)
_HOPS = f"""{_TREE}, f AS (SELECT path FROM e WHERE kind = 'file'), k AS (SELECT path FROM e WHERE kind = 'link'), dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]+$', 1) AS path FROM e),
  doc AS (SELECT d, s, l, '/' || s || '/' || l || '/doc_' || d || '.txt' AS path, '/' || s || '/links/' AS h FROM t),
  hop AS (
    SELECT h || 'l_' || d AS path, 1 AS hop, path AS place, 'file' AS kind, 'resolved' AS state FROM doc WHERE d % 10 = 3
    UNION ALL SELECT x.h || 'c_' || x.d, 1, x.h || 'l_' || (x.d - 2), CASE WHEN y.d IS NULL THEN 'absent' ELSE 'link' END, CASE WHEN y.d IS NULL THEN 'broken' ELSE 'resolved' END FROM doc x LEFT JOIN doc y ON y.d = x.d - 2 AND y.s = x.s WHERE x.d % 10 = 5
    UNION ALL SELECT x.h || 'c_' || x.d, 2, y.path, 'file', 'resolved' FROM doc x JOIN doc y ON y.d = x.d - 2 AND y.s = x.s WHERE x.d % 10 = 5
    UNION ALL SELECT h || 'o_' || d, 1, '/src' || d % 20 || '/en', CASE WHEN dirs.path IS NULL THEN 'absent' ELSE 'directory' END, CASE WHEN dirs.path IS NULL THEN 'broken' ELSE 'resolved' END FROM doc LEFT JOIN dirs ON dirs.path = '/src' || d % 20 || '/en' WHERE d % 50 = 7
    UNION ALL SELECT h || a || '_' || d, unnest([1, 2]), unnest(CASE a WHEN 'x' THEN [h || 'y_' || d, h || 'x_' || d] ELSE [h || 'x_' || d, h || 'y_' || d] END), 'link', 'cycle' FROM doc, (VALUES ('x'), ('y')) v(a) WHERE d % 50 = 9
    UNION ALL SELECT h || 'a_' || d, unnest([1, 2]), unnest([h || 'b_' || d, path]), unnest(['link', 'file']), 'resolved' FROM doc WHERE d % 50 = 11
    UNION ALL SELECT h || 'b_' || d, 1, path, 'file', 'resolved' FROM doc WHERE d % 50 = 11
    UNION ALL SELECT h || 'd_' || d, 1, '/' || s || '/' || l, 'directory', 'resolved' FROM doc WHERE d % 50 = 17
    UNION ALL SELECT h || 'm_' || d, 1, h || 'd_' || d || '/doc_' || d || '.txt', 'file', 'resolved' FROM doc WHERE d % 50 = 17)"""
ORACLE = {
    "tree_scan": f"""WITH {_TREE} SELECT path, CASE kind WHEN 'hard' THEN 'file' ELSE kind END AS kind,
      CASE WHEN kind = 'link' THEN strlen(target) WHEN d % 13 = 0 THEN 0 ELSE coalesce(strlen(text), 0) END AS size, (1600000000 + d) * 1000000000 + d AS mtime_ns,
      CASE WHEN kind <> 'link' AND d % 100 = 1 THEN 2 ELSE 1 END::BIGINT AS n_links, CASE WHEN kind = 'link' THEN target END AS target, true AS has_inode FROM e""",
    "tree_info": f"""WITH {_TREE} SELECT path, CASE kind WHEN 'link' THEN 'symlink' ELSE 'file' END AS type, strftime(make_timestamp((1600000000 + d) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS modified,
      CASE WHEN kind = 'link' THEN '0777' WHEN d % 2 = 0 THEN '0644' ELSE '0600' END AS mode, CASE WHEN kind = 'link' THEN 'lrwxrwxrwx' WHEN d % 2 = 0 THEN '-rw-r--r--' ELSE '-rw-------' END AS permissions, true AS changed_later FROM e""",
    "link_hops": f"WITH {_HOPS} SELECT path, hop, place, kind, state FROM hop",
    "tree_follow": f"""WITH RECURSIVE {_HOPS},
      b(base) AS (SELECT '/src0' UNION SELECT hop.place FROM b JOIN hop ON hop.path LIKE b.base || '/%' WHERE hop.kind = 'directory' AND hop.place <> b.base AND hop.place NOT LIKE b.base || '/%'),
      p AS (SELECT e.path, e.kind, b.base FROM b JOIN e ON e.path LIKE b.base || '/%'),
      o AS (SELECT hop.place AS path, hop.kind, hop.path AS via FROM b JOIN hop ON hop.path LIKE b.base || '/%' WHERE hop.kind <> 'absent' AND hop.place NOT LIKE b.base || '/%'),
      r AS (SELECT path, CASE kind WHEN 'hard' THEN 'file' ELSE kind END AS kind, base, CASE WHEN base <> '/src0' THEN (SELECT min(via) FROM o WHERE o.path = base) END AS via FROM p
        UNION ALL SELECT path, kind, NULL, min(via) FROM o WHERE kind <> 'directory' GROUP BY path, kind)
      SELECT path, kind, (min(row(CASE WHEN via IS NULL THEN 0 ELSE 1 END, via, base)))[3] AS base, (min(row(CASE WHEN via IS NULL THEN 0 ELSE 1 END, via, base)))[2] AS via FROM r
      WHERE (path LIKE '%.txt' OR regexp_matches(path, '/[lo]_[^/]*$')) AND NOT regexp_matches(path, '/doc_[^/]*4[.]txt$') GROUP BY path, kind""",
}
