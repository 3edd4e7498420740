"""Registered queries over snapshots, manifests, memos, logs, grants and content, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import access, identity, incremental, lineage, search, select
from corpusloom.plans.queries import FILES, ROOT, _table, files, task_paths
from corpusloom.sources import corpus
from corpusloom.streaming import actions


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{corpus.shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def snapshot_json(spark: SparkSession, d: str) -> DataFrame:
    """Files written as a JSON snapshot and read back, with the parameters that it holds."""
    path = _scratch(spark, "snapshot") + ".json"
    f = files(spark, d).filter("path is not null")
    rows = f.select("path", identity.content_hash(F.col("text")).alias("hash"), "size", F.col("doc_id").alias("inode"), (F.col("doc_id") * 1000).alias("mtime_ns"), F.lit(0o644).alias("mode"))
    corpus.write_snapshot(rows, path, {"hash_algorithm": "sha256", "glob_patterns": ["*.txt"]})
    params = corpus.read_snapshot_params(spark, path).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))), ";").alias("params"))
    return corpus.read_snapshot(spark, path).crossJoin(F.broadcast(params))  # one row of parameters


def snapshot_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "snapshot") + ".tsv"
    f = files(spark, d).filter("path is not null and text <> ''")
    corpus.write_snapshot(f.select("path", identity.content_hash(F.col("text")).alias("hash"), "size"), path)
    return corpus.read_snapshot(spark, path).select("path", "hash", "size")


def params_diff(spark: SparkSession, d: str) -> DataFrame:
    """Sources as parameters of two snapshots: the smallest id, and the number of documents."""
    s = _table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("b"))
    side = lambda c, keep: s.filter(keep).select(F.col("source").alias("name"), F.col(c).cast("string").alias("value"))
    return identity.diff_params(side("a", "a % 5 <> 0"), side("b", "a % 7 <> 0"))


def manifest_rounds(spark: SparkSession, d: str) -> DataFrame:
    """A manifest over orders, carried through a run with every outcome, pruned, written, and read back."""
    k = F.col("o_orderkey")
    o = _table(spark, d, "orders").select(k.cast("string").alias("signature"), k.alias("k"), F.lit("main").alias("key"))
    old = o.filter("k % 5 <> 0").select("signature", F.lit("in").alias("world_in"), F.lit("out").alias("world_out"), "key")
    outcome = F.when(k % 4 == 0, "hit").when(k % 4 == 1, "ok").when(k % 4 == 2, "failed").otherwise("pruned")
    ran = _table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(k.cast("string").alias("signature"), outcome.alias("outcome"), F.lit("new in").alias("world_in"), F.when(k % 8 != 1, "new out").alias("world_out"))
    kept = incremental.prune(old, o.filter("k % 11 <> 0").select("signature"), "main")
    path = _scratch(spark, "manifest")
    corpus.write_manifest(incremental.next_manifest(kept, ran), path, 1, "orders", "sha256")
    return corpus.read_manifest(spark, path, 1, "orders", "sha256")


def run_counts(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "hit").when(F.col("o_orderstatus") == "O", "ok").otherwise("failed")
    return incremental.outcome_counts(_table(spark, d, "orders").select(outcome.alias("outcome")))


def memo_runs(spark: SparkSession, d: str) -> DataFrame:
    """Files recorded in three runs of a memo, with repeats, changes, renewed epochs and one compaction."""
    path = _scratch(spark, "memo")
    e = _table(spark, d, "events").select(F.col("event_id").alias("k"))
    run = lambda keep, tag, epoch: e.filter(keep).select(F.col("k").alias("file_key"), F.lit(tag).cast("long").alias("stat_tag"), F.concat(F.lit(f"h{tag}-"), "k").alias("content_hash"), F.lit(epoch).cast("long").alias("epoch"))
    corpus.append_memo(run("k % 2 = 0", 1, 1).union(run("k % 2 = 0", 1, 1)), path)
    corpus.append_memo(run("k % 3 = 0", 1, 20), path)
    corpus.compact_memo(spark, path)
    corpus.append_memo(run("k % 5 = 0", 2, 40), path)
    return corpus.read_memo(spark, path)


def memo_replay(spark: SparkSession, d: str) -> DataFrame:
    """Files recorded by micro-batches of a stream, two of which come again after a compaction; of the files in question only."""
    path = _scratch(spark, "memo")
    e = _table(spark, d, "events").select(F.col("event_id").alias("file_key"))

    def batch(n: int, keep: str, tag: int, epoch: int) -> None:
        records = e.filter(keep).select("file_key", F.lit(tag).cast("long").alias("stat_tag"), F.concat(F.lit(f"h{tag}-"), "file_key").alias("content_hash"), F.lit(epoch).cast("long").alias("epoch"))
        corpus.append_memo(records, path, ("stream", n))

    batch(0, "true", 1, 1)
    batch(1, "file_key % 100 = 0", 2, 2)
    corpus.compact_memo(spark, path)
    batch(0, "true", 1, 1)
    batch(1, "file_key % 100 = 0", 2, 2)
    batch(2, "file_key % 100 in (0, 1) and file_key % 200 <> 0", 3, 3)
    return corpus.read_memo(spark, path, keys=e.filter("file_key % 50 in (0, 1, 2)"))


def read_content(spark: SparkSession, d: str) -> DataFrame:
    """Turns as files, some with bytes that are no text, and some above a size."""
    t = _table(spark, d, "conversations")
    path = F.concat(F.lit("/turns/"), "conv_id", F.lit("/"), "turn")
    content = F.concat(F.encode("text", "UTF-8"), F.when(F.col("turn") % 3 == 1, F.lit(b"\xff\xfe")).when(F.col("turn") % 3 == 2, F.lit(b"\x00")).otherwise(F.lit(b"")))
    return corpus.read_content(t.select(path.alias("path"), content.alias("content")), 600)


def file_info(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files with every mode there is."""
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "directory").when(k % 7 == 0, "symlink").otherwise("file")
    entries = _table(spark, d, "orders").select(F.concat(F.lit("/o/"), k.cast("string")).alias("path"), kind.alias("kind"), F.round("o_totalprice").cast("long").alias("size"), (k.cast("decimal(20,0)") * 1_000_007_000_000).alias("mtime_ns"), ((k * 37) % 4096).alias("mode"))
    return select.info(entries)


def relative_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of sources with paths below the nearest of several bases."""
    f = files(spark, d).filter("path is not null").withColumn("hash", identity.content_hash(F.col("text"))).withColumn("source", F.element_at(P.parts(F.col("path")), 2))
    docs = _table(spark, d, "documents").filter("source is not null")
    bases = docs.select(F.concat(F.lit(ROOT + "/"), "source").alias("path")).distinct().union(docs.select(F.concat(F.lit(ROOT + "/"), "source", F.lit("/en")).alias("path")).distinct())
    return identity.tree_fingerprint(identity.relative_to(f, bases), ["source"], "relative")


def access_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of a violation log of a few processes, and the directories that they need."""
    e = _table(spark, d, "events")
    operation = F.when(F.col("event_id") % 3 == 0, "file-write-create").when(F.col("event_id") % 3 == 1, "file-read-data").otherwise("network-outbound")
    line = F.concat(F.lit("kernel: tool("), (F.col("user_id") % 10).cast("string"), F.lit(") deny(1) "), operation, F.lit(" /u"), (F.col("user_id") % 40).cast("string"), F.lit("/"), "event_type", F.lit("/f"), F.col("event_id").cast("string"))
    log = incremental.violations(e.select(line.alias("value")).union(e.select(F.lit("other line"))))
    return incremental.access_policy(incremental.of_processes(log, e.filter("user_id % 10 < 7").select((F.col("user_id") % 10).alias("pid"))))


def denied_paths(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    why = F.when(F.col("event_id") % 2 == 0, "Permission denied").when(F.col("event_id") % 5 == 1, "Operation not permitted").otherwise("No such file")
    return incremental.denied(e.select(F.concat(F.lit("cp: /u"), (F.col("user_id") % 400).cast("string"), F.lit(": "), why).alias("value")))


def grants(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer")
    return incremental.merge_grants(c.select(F.concat(F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment").alias("path"), (F.col("c_acctbal") < -900).alias("writable"), F.col("c_custkey").alias("pos")))


def _search(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = spark.createDataFrame([(f"{ROOT}/src1", False), (f"{ROOT}/src2/en", True), (f"{ROOT}/src3", False)], "path string, writable boolean")
    chosen = search.selections(f"{ROOT}/src1", ["en/*.txt"], ["doc_*3.txt"]) + search.selections(None, [f"{ROOT}/src[12]/**/*.txt", f"{ROOT}/src3/en/doc_*1.txt"], ["doc_*3.txt"])
    return search.search_files(files(spark, d), chosen, "ing", 40, g, context=1)


def search_capped(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d)[0].select("path", "line", "text", "is_match")


def search_summary(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d)[1]


def edit_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many files each of several targets finds, and what the targets that find nothing are told."""
    s = _table(spark, d, "documents").filter("source is not null and lang is not null").groupBy("source").agg(F.min("doc_id").alias("m"))
    base = F.concat(F.lit(ROOT + "/"), "source")
    targets = s.select(F.explode(F.array(F.concat(base, F.lit("/en/doc_*5.txt")), F.concat(base, F.lit("/en/doc_"), F.col("m").cast("string"), F.lit(".txt")), F.concat(base, F.lit("/none/*")))).alias("path"))
    found, wrong = access.edit_targets(targets, files(spark, d).filter("path is not null").select("path"))
    return found.select("path", F.lit(None).cast("string").alias("error")).unionByName(wrong.withColumnRenamed("declared", "path"))


def block_edit(spark: SparkSession, d: str) -> DataFrame:
    """Documents after an indented block that is named without its indentation; a newline at a block's end goes with it."""
    text = F.concat(F.lit("start\n    if x:\n      y\n"), F.coalesce("text", F.lit("")), F.lit("\nend"))
    f = files(spark, d).select("path", F.when(F.col("doc_id") % 10 == 0, F.concat(text, F.lit("\n\tif x:\n\t  y"))).otherwise(text).alias("text"))
    out = search.apply_edits(f, [{"old": "if x:\n  y", "new": "if z:\n    w", "limit": 1}])
    return out.select("path", F.sha2("text", 256).alias("text_hash"), "error")


def find_by_name(spark: SparkSession, d: str) -> DataFrame:
    return select.find_by_name(select.with_directories(files(spark, d).filter("path is not null"), ROOT), "C_1", 50).select("path", "kind", "truncated")


def list_directory(spark: SparkSession, d: str) -> DataFrame:
    return select.list_directory(select.with_directories(files(spark, d).filter("path is not null"), ROOT), ROOT + "/src1/en").select("path", "kind", "name")


def environment_text(spark: SparkSession, d: str) -> DataFrame:
    """Environment lists of nations, written as text and read with comments and variables, folded into a fingerprint; and the
    variables that steps name."""
    path = _scratch(spark, "env")
    n = _table(spark, d, "nation")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("# "), "n_name")).when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit("  ${HOME}/"), "n_name")).when(F.col("n_nationkey") % 5 == 2, F.lit("")).otherwise(F.concat(F.lit("$(MISSING)/"), "n_name"))
    n.select(line.alias("value")).union(n.select(F.lit("${HOME}/x"))).write.text(path)
    listed = corpus.env_text(spark, [path], {"HOME": "/h"})
    steps = n.select(F.struct(F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.lit("R0")).alias("env")).alias("step"))
    named = corpus.environment(steps, {f"R{i}": f"v{i}" for i in range(5)})
    folded = listed.select(incremental.with_environment(F.lit("fp"), F.col("env_text")).alias("folded"), incremental.with_environment(F.lit("fp"), F.lit("")).alias("plain"))
    return listed.crossJoin(named.withColumnRenamed("env_text", "named")).crossJoin(folded)  # one row each


def requested_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths that are asked for, of which some are not there."""
    f = files(spark, d).filter("path is not null and doc_id % 3 <> 0").select("path", "size")
    return corpus.requested(f, files(spark, d).filter("path is not null").select("path")).select("path", "size", "exists")


def literal_first(spark: SparkSession, d: str) -> DataFrame:
    """Names that look like globs: what is there as it is stands for itself; a class that is left open is no glob."""
    f = files(spark, d).filter("path is not null")
    odd = f.withColumn("path", F.when(F.col("doc_id") % 10 == 0, F.concat("path", F.lit("[1]"))).when(F.col("doc_id") % 10 == 1, F.concat("path", F.lit("[1"))).otherwise(F.col("path")))
    wanted = odd.filter("doc_id % 10 < 3").select("doc_id", "path").union(f.filter("doc_id % 10 = 2").select("doc_id", F.concat(F.substring_index("path", ".", 1), F.lit(".t[x]t")).alias("path")))
    return access.declared_files(wanted.select(F.col("doc_id").alias("task_id"), "path"), odd.select("path", identity.content_hash(F.col("text")).alias("hash")))


def task_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of tasks, and whether two orders of declaration give one."""
    p = task_paths(spark, d).groupBy("task_id").agg(F.collect_list(F.when(F.col("role") == "input", F.col("path"))).alias("i"), F.collect_list(F.when(F.col("role") == "output", F.col("path"))).alias("o"))
    sign = lambda i: incremental.signature(F.lit("execute"), F.lit("x"), i, F.col("o"))
    return p.select("task_id", sign(F.col("i")).alias("signature"), (sign(F.array_sort("i")) == sign(F.reverse("i"))).alias("stable"))


def world_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of what tasks make and want for themselves, of which some is not there, and hashes of its kinds alone."""
    made = task_paths(spark, d).filter("role in ('output', 'exclusive')")
    k = F.col("o_orderkey")
    there = _table(spark, d, "orders").filter("o_orderkey % 4 <> 0").select(F.concat(F.lit("/out/"), k.cast("string")).alias("path"), F.when(k % 6 != 1, F.concat(F.lit("h"), k.cast("string"))).alias("hash"), F.when(k % 9 == 0, "directory").otherwise("file").alias("kind"))
    return incremental.world(made, there, require=False).join(incremental.existence(made, there).withColumnRenamed("world", "kinds"), "task_id").select("task_id", "world", "kinds")


def stale_excludes(spark: SparkSession, d: str) -> DataFrame:
    """Excludes of sources against inputs of some of them."""
    s = _table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.min("doc_id").alias("m"))
    excludes = s.select(F.explode(F.array(F.concat(F.lit(ROOT + "/"), "source", F.lit("/x/*.o")), F.concat(F.lit(ROOT + "/"), "source", F.lit("/y")), F.lit("*.tmp"), F.lit("**/z"))).alias("pattern"))
    return access.stale_excludes(excludes, s.filter("m % 2 = 0").select(F.concat(F.lit(ROOT + "/"), "source", F.lit("/**/*.c")).alias("path")))


def first_of_path(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders")
    rows = o.select(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").alias("k"))
    return identity.first_of_path(rows, F.col("k"))


def file_keys(spark: SparkSession, d: str) -> DataFrame:
    """Files by key and tag: how many have one that another file has too, and how many copies by key there are."""
    o = _table(spark, d, "orders").select((F.col("o_orderkey") % 7000).alias("inode"), F.lit(1).cast("long").alias("dev"), F.col("o_custkey").cast("long").alias("size"))
    keyed = o.select(identity.file_key(F.col("dev"), F.col("inode")).alias("key"), identity.stat_tag(F.col("size"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit("file")).alias("tag"), "inode", "size")
    each = keyed.groupBy("inode").agg(F.count_distinct("key").alias("keys"), F.count_distinct("tag").alias("tags"), F.count(F.lit(1)).alias("n"))
    return each.join(keyed.groupBy("key").agg(F.min("inode").alias("inode"), F.count(F.lit(1)).alias("same_key")), "inode").select("inode", "keys", "tags", "n", "same_key")


def ordered_output(spark: SparkSession, d: str) -> DataFrame:
    """Events as the outputs of batches, in order, with their place in it."""
    e = _table(spark, d, "events")
    rows = e.select((F.col("user_id") % 50).alias("batch"), F.col("event_id").alias("action_index"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 10 == 0, "none").otherwise("item").alias("kind"))
    out = actions.emitted(rows)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("action_index")).cast("long"))


def media_types(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files with names to be encoded and many extensions."""
    ext = F.element_at(F.array(*(F.lit(x) for x in ("html", "MD", "mm", "plist", "yml", "m", "jpeg", "tar.gz"))), (F.col("page_id") % 8 + 1).cast("int"))
    name = F.element_at(F.array(*(F.lit(x) for x in ("a b", "x*y", "t~1", "é", "p+q"))), (F.col("page_id") % 5 + 1).cast("int"))
    rows = _table(spark, d, "pages").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit("/"), name, F.lit("."), ext).alias("path"))
    return search.resources(rows)


def request_cap(spark: SparkSession, d: str) -> DataFrame:
    return corpus.request(_table(spark, d, "customer").select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").alias("pos")), 50)


def chunked_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The two-level fingerprint of each source, in chunks of seven files."""
    f = files(spark, d).filter("path is not null").withColumn("source", F.element_at(P.parts(F.col("path")), 2))
    hashed = f.withColumns({"hash": identity.content_hash(F.col("text")), "rel": F.col("path")})
    return identity.chunked_fingerprint(hashed, chunk=7, by=["source"])


def select_all(spark: SparkSession, d: str) -> DataFrame:
    """Everything below the root (an empty glob) but what an absolute glob, a relative one and a literal leave out."""
    return select.select_files(files(spark, d), ROOT, [""], excludes=[f"{ROOT}/*/en/doc_*9.txt", "src1/*/doc_?2*", "src2/de", ""]).select("path", "rel")


def playlist_json(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a playlist by nation, written as one JSON text with trailing commas, read back and expanded."""
    s = _table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 4).alias("g"))
    step = F.concat(F.lit('{"action": "read", "items": ["/s/'), F.col("s_suppkey").cast("string"), F.lit('", "/a, ]/${X}",],},'))
    keys = s.withColumn("step", step).groupBy("g").agg(F.expr("listagg(step, ' ') within group (order by s_suppkey)").alias("steps"))
    one = keys.select(F.concat(F.lit('"k'), F.col("g").cast("string"), F.lit('": ['), "steps", F.lit("],")).alias("part"))
    path = _scratch(spark, "playlist")
    one.agg(F.concat(F.lit("{"), F.expr("listagg(part, ' ') within group (order by part)"), F.lit("}")).alias("value")).coalesce(1).write.text(path)
    steps = corpus.playlist(spark, path, "struct<action: string, items: array<string>>")
    tasks = lineage.expand_steps(steps, {"X": "x"})
    return lineage.paths_of(tasks).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("first_task"))


def outside_links(spark: SparkSession, d: str) -> DataFrame:
    """Where links of files lead out of the roots, each place once."""
    s = _table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.min("doc_id").alias("m"))
    target = F.concat(F.when(F.col("m") % 3 == 0, F.lit("/ext/")).otherwise(F.lit(ROOT + "/")), "source")
    links = s.select(F.concat(F.lit("/links/"), "source").alias("path"), F.explode(F.array(target, F.concat(target, F.lit("/deep")))).alias("target"), F.lit("resolved").alias("state"))
    return access.outside_targets(links, spark.createDataFrame([(ROOT,)], "path string"))


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_json, snapshot_tsv, params_diff, manifest_rounds, run_counts, memo_runs, memo_replay, read_content, file_info, relative_fingerprint, access_log, denied_paths, grants, search_capped,
        search_summary, edit_targets, block_edit, find_by_name, list_directory, environment_text, requested_paths, literal_first, task_signatures, world_outputs, stale_excludes, first_of_path,
        file_keys, ordered_output, media_types, request_cap, chunked_fingerprint, select_all, playlist_json, outside_links,
    )
}

_HASH = "CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN '0' ELSE sha256(text) END"
_TP = """l AS (SELECT l_orderkey AS t, l_partkey AS p, l_linenumber AS n, l_partkey % l_orderkey AS b FROM lineitem WHERE l_orderkey > 0),
  i AS (SELECT t, '/part/' || p AS path FROM l UNION ALL SELECT t, CASE WHEN n = 2 THEN '/OUT/' || b || '/log.txt' ELSE '/out/' || b END FROM l),
  o AS (SELECT o_orderkey AS t, 'output' AS role, '/out/' || o_orderkey AS path FROM orders UNION ALL SELECT o_orderkey, 'output', '/customer/' || o_custkey FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey, 'exclusive', '/customer/' || o_custkey FROM orders WHERE o_orderkey % 50 = 4)"""
_SEARCH = """c AS (SELECT path, text, source, lang FROM f WHERE path IS NOT NULL AND name NOT LIKE 'doc\\_%3.txt' ESCAPE '\\' AND (source IN ('src1', 'src2') OR source = 'src3' AND lang = 'en' AND name LIKE 'doc\\_%1.txt' ESCAPE '\\')),
  k AS (SELECT * FROM c WHERE source IN ('src1', 'src3') OR lang = 'en'),
  l AS (SELECT path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM k),
  m AS (SELECT path, line, regexp_replace(x, '\\r$', '') AS text FROM l WHERE NOT (line = n AND x = '')),
  h AS (SELECT path, line FROM m WHERE contains(text, 'ing') ORDER BY path, line LIMIT 40)"""
ORACLE = {
    "snapshot_json": f"WITH {FILES} SELECT path, {_HASH} AS hash, size, doc_id AS inode, doc_id * 1000 AS mtime_ns, 420::INT AS mode, 'glob_patterns=[\"*.txt\"];hash_algorithm=sha256' AS params FROM f WHERE path IS NOT NULL",
    "snapshot_tsv": f"WITH {FILES} SELECT path, {_HASH} AS hash, size FROM f WHERE path IS NOT NULL AND text <> ''",
    "params_diff": """WITH s AS (SELECT source, min(doc_id) AS a, count(*) AS b FROM documents WHERE source IS NOT NULL GROUP BY source), x AS (SELECT source, a::VARCHAR AS old FROM s WHERE a % 5 <> 0), y AS (SELECT source, b::VARCHAR AS new FROM s WHERE a % 7 <> 0)
      SELECT source AS name, old, new FROM x FULL JOIN y USING (source) WHERE old IS DISTINCT FROM new""",
    "manifest_rounds": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS ran, o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AS kept FROM orders)
      SELECT k::VARCHAR AS signature, CASE WHEN ran AND k % 4 = 1 THEN 'new in' ELSE 'in' END AS world_in, CASE WHEN ran AND k % 4 = 1 THEN 'new out' ELSE 'out' END AS world_out FROM o
      WHERE CASE WHEN ran AND k % 4 = 1 THEN k % 8 <> 1 WHEN ran AND k % 4 = 3 THEN false ELSE kept END""",
    "run_counts": "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) FILTER (o_orderstatus = 'O') AS executed, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed FROM orders",
    "memo_runs": """SELECT event_id AS file_key, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS stat_tag, CASE WHEN event_id % 5 = 0 THEN 'h2-' ELSE 'h1-' END || event_id AS content_hash,
      CASE WHEN event_id % 5 = 0 THEN 40 ELSE 20 END::BIGINT AS epoch FROM events WHERE event_id % 5 = 0 OR event_id % 3 = 0""",
    "memo_replay": """WITH t AS (SELECT event_id AS file_key, CASE WHEN event_id % 100 IN (0, 1) AND event_id % 200 <> 0 THEN 3 WHEN event_id % 100 = 0 THEN 2 ELSE 1 END::BIGINT AS stat_tag FROM events WHERE event_id % 50 IN (0, 1, 2))
      SELECT file_key, stat_tag, 'h' || stat_tag || '-' || file_key AS content_hash, stat_tag AS epoch FROM t""",
    "read_content": r"""WITH t AS (SELECT '/turns/' || conv_id || '/' || turn AS path, text, turn % 3 AS m, encode(text) || CASE turn % 3 WHEN 1 THEN '\xFF\xFE'::BLOB WHEN 2 THEN '\x00'::BLOB ELSE ''::BLOB END AS content FROM conversations)
      SELECT path, CASE WHEN octet_length(content) <= 600 THEN CASE m WHEN 0 THEN 'text' ELSE 'base64' END END AS kind, CASE WHEN octet_length(content) <= 600 THEN CASE m WHEN 0 THEN text ELSE base64(content) END END AS text,
      CASE WHEN octet_length(content) > 600 THEN 'larger than 600 bytes' END AS error FROM t""",
    "file_info": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'directory' WHEN o_orderkey % 7 = 0 THEN 'symlink' ELSE 'file' END AS type, round(o_totalprice)::BIGINT AS size, (o_orderkey * 37) % 4096 AS m FROM orders)
      SELECT '/o/' || k AS path, type, size, strftime(make_timestamp((k * 1000007000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS modified, (m // 512)::VARCHAR || (m // 64) % 8 || (m // 8) % 8 || m % 8 AS mode,
      CASE type WHEN 'directory' THEN 'd' WHEN 'symlink' THEN 'l' ELSE '-' END || CASE WHEN m & 256 > 0 THEN 'r' ELSE '-' END || CASE WHEN m & 128 > 0 THEN 'w' ELSE '-' END || CASE WHEN m & 2048 > 0 THEN CASE WHEN m & 64 > 0 THEN 's' ELSE 'S' END WHEN m & 64 > 0 THEN 'x' ELSE '-' END
      || CASE WHEN m & 32 > 0 THEN 'r' ELSE '-' END || CASE WHEN m & 16 > 0 THEN 'w' ELSE '-' END || CASE WHEN m & 1024 > 0 THEN CASE WHEN m & 8 > 0 THEN 's' ELSE 'S' END WHEN m & 8 > 0 THEN 'x' ELSE '-' END
      || CASE WHEN m & 4 > 0 THEN 'r' ELSE '-' END || CASE WHEN m & 2 > 0 THEN 'w' ELSE '-' END || CASE WHEN m & 512 > 0 THEN CASE WHEN m & 1 > 0 THEN 't' ELSE 'T' END WHEN m & 1 > 0 THEN 'x' ELSE '-' END AS permissions FROM o""",
    "relative_fingerprint": f"""WITH {FILES}, r AS (SELECT source, path, CASE WHEN lang = 'en' THEN name ELSE lang || '/' || name END || '=' || {_HASH} AS item FROM f WHERE path IS NOT NULL AND text IS NOT NULL)
      SELECT source, count(*) AS n_files, sha256(string_agg(item, '' ORDER BY reverse(path))) AS fingerprint FROM r GROUP BY source""",
    "access_log": """WITH e AS (SELECT '/u' || (user_id % 40) || '/' || event_type AS path, event_id % 3 AS m FROM events WHERE user_id % 10 < 7), w AS (SELECT DISTINCT path FROM e WHERE m = 0)
      SELECT path, true AS writable FROM w UNION ALL SELECT DISTINCT path, false FROM e WHERE m = 1 AND path NOT IN (SELECT path FROM w)""",
    "denied_paths": "SELECT DISTINCT '/u' || (user_id % 400) AS path FROM events WHERE event_id % 2 = 0 OR event_id % 5 = 1",
    "grants": "SELECT '/n' || c_nationkey || '/' || c_mktsegment AS path, bool_or(c_acctbal < -900) AS writable, min(c_custkey) AS pos FROM customer GROUP BY 1",
    "search_capped": f"WITH {FILES}, {_SEARCH} SELECT m.path, CAST(m.line AS BIGINT) AS line, m.text, bool_or(m.line = h.line) AS is_match FROM m JOIN h ON m.path = h.path AND abs(m.line - h.line) <= 1 GROUP BY ALL",
    "search_summary": f"WITH {FILES}, {_SEARCH} SELECT count(DISTINCT path) AS files, count(*) AS matches, (SELECT count(*) FROM c) - (SELECT count(*) FROM k) AS skipped, count(*) >= 40 AS truncated FROM h",
    "edit_targets": f"""WITH {FILES}, g AS (SELECT * FROM f WHERE path IS NOT NULL), s AS (SELECT source, min(doc_id) AS m FROM g GROUP BY source), one AS (SELECT '/corpus/' || source || '/en/doc_' || m || '.txt' AS path FROM s)
      SELECT path, NULL::VARCHAR AS error FROM g WHERE lang = 'en' AND doc_id % 10 = 5 OR path IN (SELECT path FROM one) UNION ALL SELECT path, 'not found' FROM one WHERE path NOT IN (SELECT path FROM g)
      UNION ALL SELECT '/corpus/' || source || '/none/*', 'matches nothing' FROM s UNION ALL SELECT '/corpus/' || source || '/en/doc_*5.txt', 'matches nothing' FROM s WHERE source NOT IN (SELECT source FROM g WHERE lang = 'en' AND doc_id % 10 = 5)""",
    "block_edit": f"""WITH {FILES}, t AS (SELECT path, doc_id % 10 = 0 AS two, coalesce(text, '') AS x FROM f)
      SELECT path, sha256('start' || chr(10) || CASE WHEN two THEN '    if x:' || chr(10) || '      y' ELSE '    if z:' || chr(10) || '        w' END || CASE WHEN two THEN chr(10) ELSE '' END || x || chr(10) || 'end' || CASE WHEN two THEN chr(10) || chr(9) || 'if x:' || chr(10) || chr(9) || '  y' ELSE '' END) AS text_hash,
      CASE WHEN two THEN 'edit 0: 2 matches' END AS error FROM t""",
    "find_by_name": f"""WITH {FILES}, a AS (SELECT path, 'file' AS kind, name FROM f WHERE path IS NOT NULL UNION SELECT '/corpus/' || source, 'directory', source FROM f WHERE path IS NOT NULL UNION SELECT '/corpus/' || source || '/' || lang, 'directory', lang FROM f WHERE path IS NOT NULL)
      SELECT path, kind, (SELECT count(*) FROM a WHERE contains(lower(name), 'c_1')) >= 50 AS truncated FROM a WHERE contains(lower(name), 'c_1') ORDER BY path LIMIT 50""",
    "list_directory": f"WITH {FILES} SELECT path, 'file' AS kind, name FROM f WHERE source = 'src1' AND lang = 'en'",
    "environment_text": """WITH x AS (SELECT DISTINCT CASE n_nationkey % 5 WHEN 1 THEN '/h/' || n_name ELSE '/' || n_name END AS p FROM nation WHERE n_nationkey % 5 IN (1, 3, 4) UNION SELECT '/h/x'),
      t AS (SELECT string_agg(p, chr(10) ORDER BY p) AS env_text FROM x), y AS (SELECT DISTINCT 'R' || n_regionkey || '=v' || n_regionkey || chr(10) AS p FROM nation UNION SELECT 'R0=v0' || chr(10))
      SELECT env_text, (SELECT string_agg(p, '' ORDER BY p) FROM y) AS named, sha256('fp' || env_text) AS folded, 'fp' AS plain FROM t""",
    "requested_paths": f"WITH {FILES} SELECT path, CASE WHEN doc_id % 3 <> 0 THEN size END AS size, doc_id % 3 <> 0 AS exists FROM f WHERE path IS NOT NULL",
    "literal_first": f"""WITH {FILES}, g AS (SELECT *, {_HASH} AS hash FROM f WHERE path IS NOT NULL)
      SELECT doc_id AS task_id, p AS declared, p AS path, hash FROM (SELECT doc_id, hash, path || CASE doc_id % 10 WHEN 0 THEN '[1]' WHEN 1 THEN '[1' ELSE '' END AS p FROM g WHERE doc_id % 10 < 3)
      UNION ALL SELECT doc_id, '/corpus/' || source || '/' || lang || '/doc_' || doc_id || '.t[x]t', path, hash FROM g WHERE doc_id % 10 = 2""",
    "task_signatures": f"""WITH {_TP}, a AS (SELECT t, array_to_string(list_sort(list_distinct(list(path))), chr(1)) AS i FROM i GROUP BY t), b AS (SELECT t, array_to_string(list_sort(list_distinct(list(path))), chr(1)) AS o FROM o WHERE role = 'output' GROUP BY t),
      x AS (SELECT t, coalesce(i, '') AS i, coalesce(o, '') AS o FROM (SELECT DISTINCT t FROM (SELECT t FROM i UNION ALL SELECT t FROM o)) LEFT JOIN a USING (t) LEFT JOIN b USING (t))
      SELECT t AS task_id, sha256('4:task7:execute1:x' || length(i) || ':' || i || length(o) || ':' || o) AS signature, true AS stable FROM x""",
    "world_outputs": f"""WITH {_TP}, d AS (SELECT DISTINCT t, path FROM o), r AS (SELECT '/out/' || o_orderkey AS path, CASE WHEN o_orderkey % 6 <> 1 THEN 'h' || o_orderkey END AS hash, CASE WHEN o_orderkey % 9 = 0 THEN 'directory' ELSE 'file' END AS kind FROM orders WHERE o_orderkey % 4 <> 0)
      SELECT t AS task_id, CASE WHEN NOT bool_or(r.path IS NOT NULL AND hash IS NULL) THEN sha256(string_agg(d.path || '=' || coalesce(hash, '-'), ',' ORDER BY d.path || '=' || coalesce(hash, '-'))) END AS world,
      sha256(string_agg(d.path || '=' || coalesce(kind, '-'), ',' ORDER BY d.path || '=' || coalesce(kind, '-'))) AS kinds FROM d LEFT JOIN r ON d.path = r.path GROUP BY t""",
    "stale_excludes": "WITH s AS (SELECT source, min(doc_id) AS m FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT '/corpus/' || source || x AS pattern FROM s, (VALUES ('/x/*.o'), ('/y')) AS v(x) WHERE m % 2 <> 0",
    "first_of_path": "SELECT '/c/' || o_custkey AS path, min(o_orderkey) AS k FROM orders GROUP BY o_custkey",
    "file_keys": "SELECT o_orderkey % 7000 AS inode, 1::BIGINT AS keys, count(DISTINCT o_custkey) AS tags, count(*) AS n, count(*) AS same_key FROM orders GROUP BY 1",
    "ordered_output": "SELECT user_id % 50 AS batch, event_id AS action_index, event_type AS text, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS place FROM events WHERE event_id % 10 <> 0",
    "media_types": """WITH p AS (SELECT page_id AS k, ['html', 'MD', 'mm', 'plist', 'yml', 'm', 'jpeg', 'tar.gz'][page_id % 8 + 1] AS e, ['text/html', 'text/markdown', 'text/x-c++', NULL, 'application/yaml', 'text/x-objcsrc', 'image/jpeg', NULL][page_id % 8 + 1] AS mime,
      ['a b', 'x*y', 't~1', 'é', 'p+q'][page_id % 5 + 1] AS n, ['a%20b', 'x%2Ay', 't~1', '%C3%A9', 'p%2Bq'][page_id % 5 + 1] AS u FROM pages) SELECT '/p/' || k || '/' || n || '.' || e AS path, n || '.' || e AS name, 'file:///p/' || k || '/' || u || '.' || e AS uri, mime FROM p""",
    "chunked_fingerprint": f"""WITH {FILES}, h AS (SELECT source, path, {_HASH} AS h, (row_number() OVER (PARTITION BY source ORDER BY reverse(path)) - 1) // 7 AS c FROM f WHERE path IS NOT NULL AND text IS NOT NULL),
      g AS (SELECT source, c, sha256(string_agg(h, '' ORDER BY reverse(path))) AS h, count(*) AS n FROM h GROUP BY source, c) SELECT source, CAST(sum(n) AS BIGINT) AS n_files, sha256(string_agg(h, '' ORDER BY c)) AS fingerprint FROM g GROUP BY source""",
    "select_all": f"""WITH {FILES} SELECT path, rel FROM f WHERE path IS NOT NULL AND NOT (lang = 'en' AND doc_id % 10 = 9 OR source = 'src1' AND regexp_matches(name, '^doc_.2') OR source = 'src2' AND lang = 'de')""",
    "playlist_json": """WITH s AS (SELECT s_suppkey AS k, s_nationkey % 4 AS g, row_number() OVER (PARTITION BY s_nationkey % 4 ORDER BY s_suppkey) - 1 AS i FROM supplier)
      SELECT '/s/' || k AS path, 1::BIGINT AS n, 'k' || g || '/' || i || '/0' AS first_task FROM s UNION ALL SELECT '/a, ]/x', count(*), min('k' || g || '/' || i || '/1') FROM s""",
    "outside_links": "SELECT '/ext/' || source AS path FROM (SELECT source, min(doc_id) AS m FROM documents WHERE source IS NOT NULL GROUP BY source) WHERE m % 3 = 0",
    "request_cap": "SELECT c_custkey AS pos, CASE WHEN c_custkey < 50 THEN '/c/' || c_custkey END AS path, CASE WHEN c_custkey >= 50 THEN 'more than 50 paths' END AS error FROM customer",
}
