"""Registered queries over streams that are made from the driver's tables, over formats and edits, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import factored, identity, incremental, lineage, search
from corpusloom.plans.graph_queries import _EDGES, _tasks
from corpusloom.plans.queries import FILES, _table, files
from corpusloom.plans.table_queries import _scratch
from corpusloom.sources import corpus, tree
from corpusloom.streaming import actions

#: Files of each wave of rows that ordered_stream() writes; a micro-batch takes as many.
WAVE_FILES = 8


def stream_sink(spark: SparkSession, d: str) -> DataFrame:
    """Action lines as text files, read as a stream: what the sinks hold of good lines and of bad ones."""
    source, good, bad = (_scratch(spark, f"actions-{x}") for x in ("lines", "good", "bad"))
    e = _table(spark, d, "events")
    k = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("broken "), k)).when(F.col("event_id") % 89 == 0, F.concat(F.lit("[fly]|"), k))
    e.select(line.otherwise(F.concat(F.lit("[Copy n="), k, F.lit("]\t/"), "event_type", F.lit("/"), k, F.lit("\t/to/"), F.col("user_id").cast("string")))).write.text(source)
    actions.sink(actions.parse(spark.readStream.text(source)), good, bad, _scratch(spark, "actions-checkpoint")).awaitTermination()
    parsed = spark.read.schema("value string, action string, options map<string, string>, fields array<string>").json(good)
    rows = parsed.select("value", "action", actions.typed_option(F.col("options"), "n", "bigint").alias("n"), F.array_join("fields", ",").alias("fields"), F.lit(None).cast("string").alias("error"))
    wrong = spark.read.schema("value string, error string").json(bad)
    return rows.unionByName(wrong, allowMissingColumns=True)


def ordered_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user by number, through a stream in three waves: some come late or never, some twice, then each user ends."""
    at = Window.partitionBy("user_id").orderBy("event_id")
    e = _table(spark, d, "events").withColumn("action_index", (F.row_number().over(at) - 1).cast("long"))
    kind = F.when(F.col("event_id") % 7 == 0, "none").otherwise("item")
    rows = corpus.written(e.select("event_id", F.col("user_id").cast("string").alias("batch"), "action_index", F.concat_ws("-", "event_type", "event_id").alias("text"), kind.alias("kind")))
    again = rows.filter("event_id % 13 = 5 and event_id % 11 <> 0 and kind = 'item'")
    ends = rows.select("batch").distinct().select(F.lit(None).cast("long").alias("event_id"), "batch", F.lit(-1).cast("long").alias("action_index"), F.lit(None).cast("string").alias("text"), F.lit("end").alias("kind"))
    source, out = _scratch(spark, "ordered-rows"), _scratch(spark, "ordered-out")
    for wave in (rows.filter("event_id % 11 <> 0"), rows.filter("event_id % 22 = 0").unionByName(again), ends):
        wave.repartition(WAVE_FILES).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", WAVE_FILES).parquet(source)
    writer = actions.in_order(stream.drop("event_id")).writeStream.format("parquet").option("path", out).option("checkpointLocation", _scratch(spark, "ordered-checkpoint"))
    # timeouts make empty micro-batches for ever, so the stream is stopped once its last file is through
    batches = -(-len(spark.read.parquet(source).inputFiles()) // WAVE_FILES)
    query = writer.trigger(processingTime="1 second").start()
    while sum(p["numInputRows"] > 0 for p in query.recentProgress) < batches:
        query.awaitTermination(1)  # raises if the stream failed
    query.stop()
    return spark.read.schema("batch string, action_index long, text string, late boolean").parquet(out)


def stream_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files that appear in a directory: their hashes, and what changed against a snapshot."""
    where = corpus.shared_dir(spark)
    if not where.startswith(("file:/", "/")):
        raise ValueError(f"{where} is no folder that can be mounted")
    root = f"/{where.removeprefix('file:').lstrip('/')}/corpusloom/arrivals-{uuid.uuid4().hex}"
    docs = _table(spark, d, "documents").select("doc_id", F.concat(F.lit(root + "/"), F.pmod("doc_id", F.lit(50)).cast("string"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    tree.write_tree(docs.filter("text <> ''").select("path", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("target"), F.col("text").alias("content"), F.lit(0o644).alias("mode"), F.lit(1_700_000_000_000_000_000).alias("mtime_ns")))
    hashed = identity.content_hash(F.col("text"))
    old = corpus.written(docs.filter("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(hashed).alias("hash")))
    out = _scratch(spark, "arrived")
    found = actions.changes(actions.arriving(spark, root), old)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", _scratch(spark, "arrivals-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    tree.remove_tree(spark, root)
    rows = spark.read.schema(found.schema).parquet(out)
    return rows.select(F.expr(f"substring(path, {len(root) + 1})").alias("path"), "size", "hash", "change")


def stream_memo(spark: SparkSession, d: str) -> DataFrame:
    """Files recorded in a memo by one stream in two goes, of which the second sees only what came since, repeats among it."""
    source, path, checkpoint = (_scratch(spark, f"memo-{x}") for x in ("rows", "table", "checkpoint"))
    schema = "file_key long, stat_tag long, content_hash string, epoch long"
    k = F.col("event_id")
    rows = lambda keep, tag, epoch: _table(spark, d, "events").filter(keep).select(k.alias("file_key"), F.lit(tag).cast("long").alias("stat_tag"), F.concat(F.lit(f"h{tag}-"), k).alias("content_hash"), F.lit(epoch).cast("long").alias("epoch"))
    for arrived in (rows("true", 1, 1), rows("event_id % 10 = 0", 2, 2).unionByName(rows("event_id % 10 = 1", 1, 1))):
        arrived.write.mode("append").parquet(source)
        actions.append_memo(spark.readStream.schema(schema).parquet(source), path, checkpoint).awaitTermination()
    return corpus.read_memo(spark, path).select("file_key", "stat_tag", "content_hash")


def grep_binary(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a word in texts of which some hold a NUL: early in the text (skipped), or beyond the first 4096 characters."""
    nul = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x\x00\n"), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.rpad(F.lit(""), 5000, "-"), F.lit("\x00\n"), "text"))
    f = files(spark, d).filter("path is not null").withColumn("text", nul.otherwise(F.col("text")))
    found = search.grep(f, "License", regex=False)
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def edit_all(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of a text, and then of another in any case, replaced; files that lack one of them stay as that edit found them."""
    edits = [{"old": " the ", "new": " THE$1 ", "limit": 0}, {"old": "LICENSE", "new": "licence\\1", "limit": 0, "ignore_case": True}]
    out = search.apply_edits(files(spark, d).filter("path is not null and text is not null"), edits)
    return out.select("path", F.sha2("text", 256).alias("hash"), "error")


def snapshot_names(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot under three names, whose endings choose the format; each read back."""
    f = files(spark, d).filter("path is not null").select("path", identity.content_hash(F.col("text")).alias("hash"), "size")
    out = []
    for ending in (".tsv", "", ".json"):
        path = _scratch(spark, "snapshot") + ending
        corpus.write_snapshot(f, path)
        out.append(corpus.read_snapshot(spark, path).groupBy(F.lit(ending).alias("ending"), F.element_at(F.split("path", "/"), 3).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("hash").alias("hash")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def playlist_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """What runs again after a change of some tasks, if what they make is held against an inventory from before, by hashes: tasks whose
    outputs are all there and as they were make nothing else run."""
    tasks = factored.numbered(_tasks(spark, d))
    paths = lineage.paths_of(tasks)
    made = paths.filter("role = 'output' and not contains(path, '*')").select("task_id", "path")
    n = F.length("path")
    before = made.select("path").distinct().withColumn("hash", F.sha2("path", 256))
    after = before.filter(n % 10 != 9).withColumn("hash", F.when(n % 3 == 0, F.col("hash")).otherwise(F.sha2(F.concat("path", F.lit("'")), 256)))
    same = incremental.unchanged_outputs(incremental.world(made, before), incremental.world(made, after))
    return factored.dirty(factored.relations(paths), tasks.filter("seq.seq % 240 = 0").select("task_id", "task"), lineage.written(same))


QUERIES = {f.__name__: f for f in (stream_sink, ordered_stream, stream_arrivals, stream_memo, grep_binary, edit_all, snapshot_names, playlist_cutoff)}
ORACLE = {
    "stream_sink": """SELECT CASE WHEN k % 97 = 0 THEN 'broken ' || k WHEN k % 89 = 0 THEN '[fly]|' || k ELSE '[Copy n=' || k || ']' || chr(9) || '/' || event_type || '/' || k || chr(9) || '/to/' || user_id END AS value,
      CASE WHEN k % 97 <> 0 AND k % 89 <> 0 THEN 'copy' END AS action, CASE WHEN k % 97 <> 0 AND k % 89 <> 0 THEN k END AS n,
      CASE WHEN k % 97 <> 0 AND k % 89 <> 0 THEN '/' || event_type || '/' || k || ',/to/' || user_id END AS fields, CASE WHEN k % 97 = 0 THEN 'malformed line' WHEN k % 89 = 0 THEN 'unknown action' END AS error
      FROM (SELECT *, event_id AS k FROM events)""",
    "ordered_stream": """WITH r AS (SELECT event_id AS k, user_id AS u, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS i, event_type || '-' || event_id AS text FROM events),
      x AS (SELECT u, min(i) AS expected FROM (SELECT u, i FROM r WHERE k % 11 = 0 UNION ALL SELECT u, max(i) + 1 FROM r GROUP BY u) GROUP BY u)
      SELECT CAST(u AS VARCHAR) AS batch, i AS action_index, text, false AS late FROM r WHERE k % 7 <> 0 AND (k % 11 <> 0 OR k % 22 = 0)
      UNION ALL SELECT CAST(u AS VARCHAR), i, text, true FROM r JOIN x USING (u) WHERE k % 13 = 5 AND k % 11 <> 0 AND k % 7 <> 0 AND i < expected""",
    "stream_arrivals": """SELECT '/' || (doc_id % 50) || '/doc_' || doc_id || '.txt' AS path, strlen(text) AS size, sha256(text) AS hash,
      CASE WHEN doc_id % 4 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'modified' ELSE 'same' END AS change FROM documents WHERE text <> ''""",
    "stream_memo": "SELECT event_id AS file_key, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS stat_tag, CASE WHEN event_id % 10 = 0 THEN 'h2-' ELSE 'h1-' END || event_id AS content_hash FROM events",
    "grep_binary": f"""WITH {FILES}, l AS (SELECT path, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM f WHERE path IS NOT NULL AND doc_id % 4 <> 0)
      SELECT path, count(*) AS n, min(i + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END)::BIGINT AS first_line FROM l WHERE contains(x, 'License') GROUP BY path""",
    "edit_all": f"""WITH {FILES}, a AS (SELECT path, text, replace(text, ' the ', ' THE$1 ') AS once, contains(text, ' the ') AS one FROM f WHERE path IS NOT NULL AND text IS NOT NULL)
      SELECT path, sha256(CASE WHEN NOT one THEN text WHEN contains(lower(once), 'license') THEN regexp_replace(once, 'license', 'licence\\\\1', 'gi') ELSE once END) AS hash,
      CASE WHEN NOT one THEN 'edit 0: no match' WHEN NOT contains(lower(once), 'license') THEN 'edit 1: no match' END AS error FROM a""",
    "snapshot_names": f"""WITH {FILES} SELECT ending, source, count(*) AS n, sum(size)::BIGINT AS size, min(CASE WHEN text = '' THEN '0' ELSE sha256(text) END) AS hash FROM f, (VALUES ('.tsv'), (''), ('.json')) AS e(ending) WHERE path IS NOT NULL GROUP BY ending, source""",
    "playlist_cutoff": f"""WITH RECURSIVE {_EDGES}, same AS (SELECT t FROM tp WHERE role = 'output' AND NOT tp.glob GROUP BY t HAVING bool_and(length(path) % 3 = 0 AND length(path) % 10 <> 9)),
      w(t, distance) AS (SELECT t, 0 FROM (SELECT DISTINCT t FROM tp WHERE k % 240 = 0) UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.t WHERE w.distance < 8 AND e.src NOT IN (SELECT t FROM same))
      SELECT t AS task_id, min(distance) AS distance FROM w GROUP BY t""",
}
