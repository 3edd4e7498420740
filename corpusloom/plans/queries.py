"""The registered queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import access, identity, incremental, lineage, search, select
from corpusloom.streaming import actions

ROOT = "/corpus"
GLOBS = ("**/en/*.txt", "src1*/**", "doc_*7.txt", "{src2,src3}/[de][ens]/doc_?[0-4]*.txt")
EXCLUDES = ("/corpus/src13", "src14/fr", "src15/**/doc_1*", "doc_*[05].txt")
ANYWHERE = tuple(f"**/doc_*{i:02}.txt" for i in range(100)) + tuple(f"**/{lang}/doc_{i}*" for lang in ("e?", "[df]*") for i in range(10)) + ("**", "*/*/*_1?.txt")
MANY = tuple(f"src{i}/{lang}/doc_*{i % 10}.txt" for i in range(20) for lang in ("en", "d?"))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """documents as files."""
    path = F.concat(F.lit(ROOT + "/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _table(spark, d, "documents").select("doc_id", path.alias("path"), "text", F.col("n_chars").alias("size"))


FILES = "f AS (SELECT doc_id, '/corpus/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, source || '/' || lang || '/doc_' || doc_id || '.txt' AS rel, 'doc_' || doc_id || '.txt' AS name, source, lang, text, n_chars AS size FROM documents)"


def tree_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    chosen = select.select_files(files(spark, d), ROOT, ["**/en/*.txt"], excludes=["doc_*7.txt"])
    hashed = chosen.withColumn("hash", identity.content_hash(F.col("text"))).withColumn("source", F.element_at(P.parts(F.col("rel")), 1))
    return identity.tree_fingerprint(hashed, ["source"]).orderBy("source")


def glob_select(spark: SparkSession, d: str) -> DataFrame:
    return select.select_files(files(spark, d), ROOT, list(GLOBS), [r"doc_\d*99\."], list(EXCLUDES)).select("path", "rel", "size")


def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    return select.tree(select.with_directories(files(spark, d), ROOT), 2).select("path", "kind", "parent", "name", "depth")


def globs_anywhere(spark: SparkSession, d: str) -> DataFrame:
    """How many files each of many globs without a directory matches, and the first of them."""
    rows = files(spark, d).filter("path is not null").select("path", F.lower(F.expr(f"substring(path, {len(ROOT) + 2})")).alias("rel"))
    globs = spark.createDataFrame([(g,) for g in ANYWHERE], "glob string")
    found = lineage.path_matches(rows, globs, "rel", "glob")
    return rows.join(found, "rel").groupBy(F.col("glob").alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def many_globs(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).withColumn("rel", P.relative(F.col("path"), F.lit(ROOT)))
    return select.pattern_matches(rows, list(MANY)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages")
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1))
    p = F.col("path")
    mode = ((F.col("page_id") * 37) % 4096).cast("int")
    return pages.select("page_id", path.alias("raw")).withColumn("path", P.normalize(F.col("raw"))).select(
        "page_id", "path", P.basename(p).alias("name"), P.depth(p).cast("long").alias("depth"), F.array_join(P.ancestors(p), ",").alias("up"), P.file_uri(p).alias("uri"), P.octal_mode(mode).alias("octal"),
        P.iso_utc(F.col("page_id") * 1_000_000_007_000).alias("at"),
    )


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, d)
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" edited"))).otherwise(F.col("text"))
    snap = lambda df, t: df.select("path", identity.content_hash(t).alias("hash"), F.char_length(t).cast("long").alias("size"))
    return snap(f.filter("doc_id % 13 <> 0"), F.col("text")), snap(f.filter("doc_id % 17 <> 0"), changed)


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    out = identity.diff_snapshots(*_snapshots(spark, d))
    return out.select("path", "change", F.array_join(F.transform("details", lambda x: F.concat_ws(":", x["field"], x["old"], x["new"])), ";").alias("details"))


def memo_lookup(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select("path", F.col("doc_id").alias("file_key"), F.col("size").alias("stat_tag"))
    log = files(spark, d)
    tiers = [log.filter(f"doc_id % {m} <> 0").select(F.col("doc_id").alias("file_key"), (F.col("size") + (F.col("doc_id") % m == 1).cast("long")).alias("stat_tag"), F.concat(F.lit(f"h{m}-"), "doc_id").alias("content_hash"), (F.col("doc_id") % 50).alias("epoch"), F.lit(t).alias("tier"), F.lit(0).alias("seq")) for t, m in enumerate((5, 3, 2))]
    memo = identity.latest_records(tiers[0].unionByName(tiers[1]).unionByName(tiers[2]))
    return identity.memo_lookup(f, memo).select("path", "hit", "hash")


def grep_context(spark: SparkSession, d: str) -> DataFrame:
    return search.grep(files(spark, d), r"\bthe[a-z]*ing\b", context=1).select("path", "line", "text", "is_match", "separator")


def grep_literal(spark: SparkSession, d: str) -> DataFrame:
    return search.grep(files(spark, d), "LICENSE", regex=False, ignore_case=True).select("path", "line", "text")


def edit_files(spark: SparkSession, d: str) -> DataFrame:
    edits = [{"old": "the ", "new": "THE ", "limit": 2}, {"old": r"(\w+), (\w+)", "new": r"\2; \1", "limit": 0, "regex": True}]
    out = search.apply_edits(files(spark, d), edits)
    return out.select("path", F.sha2("text", 256).alias("text_hash"), "error")


def edit_unique(spark: SparkSession, d: str) -> DataFrame:
    return search.apply_edits(files(spark, d), [{"old": "License", "new": "Licence", "limit": 1}]).select("path", F.sha2("text", 256).alias("text_hash"), "error")


def edit_first(spark: SparkSession, d: str) -> DataFrame:
    out = search.apply_edits(files(spark, d), [{"old": r"(\w+), ", "new": r"\1; ", "limit": 2, "regex": True}])
    return out.select("path", F.sha2("text", 256).alias("text_hash"), "error")


def nested_tree(spark: SparkSession, d: str) -> DataFrame:
    return select.nested_tree(select.with_directories(files(spark, d), ROOT), 3)


def task_paths(spark: SparkSession, d: str, customers: bool = True) -> DataFrame:
    """Orders as tasks: each makes out/<key>, and reads a part and what a task of a smaller key makes. Without customers, no path below
    /customer is declared, and none is null: the same as a filter on paths, which would have to make the text of every path."""
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("c"))
    l = _table(spark, d, "lineitem").filter("l_orderkey > 0").select(F.col("l_orderkey").alias("task_id"), "l_partkey", "l_linenumber")
    if not customers:
        o, l = o.filter("task_id is not null"), l.filter("l_partkey is not null")
    row = lambda df, role, *path: df.select("task_id", F.col("task_id").alias("seq"), F.lit(role).alias("role"), F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in path)).alias("path"))
    before = F.col("l_partkey") % F.col("task_id")
    out = row(o, "output", "/out/", F.col("task_id")).unionByName(row(l, "input", "/part/", F.col("l_partkey")))
    out = out.unionByName(row(l.filter("l_linenumber <> 2"), "input", "/out/", before)).unionByName(row(l.filter("l_linenumber = 2"), "input", "/OUT/", before, "/log.txt"))
    if not customers:
        return out
    return out.unionByName(row(o.filter("task_id % 10 = 3"), "output", "/customer/", F.col("c"))).unionByName(row(o.filter("task_id % 50 = 4"), "exclusive", "/customer/", F.col("c")))


TASKS = """
l AS (SELECT l_orderkey AS t, l_partkey AS p, l_linenumber AS n, l_partkey % l_orderkey AS b FROM lineitem WHERE l_orderkey > 0),
tp AS (SELECT o_orderkey AS t, 'output' AS role, '/out/' || o_orderkey AS path FROM orders UNION ALL SELECT t, 'input', '/part/' || p FROM l
  UNION ALL SELECT t, 'input', CASE WHEN n = 2 THEN '/out/' || b || '/log.txt' ELSE '/out/' || b END FROM l
  UNION ALL SELECT o_orderkey, 'output', '/customer/' || o_custkey FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey, 'exclusive', '/customer/' || o_custkey FROM orders WHERE o_orderkey % 50 = 4),
e AS (
  SELECT src, dst, min(reason) AS reason FROM (
    SELECT a.t AS src, b.t AS dst, 'explicit' AS reason FROM tp a JOIN tp b ON a.path = b.path WHERE a.role = 'output' AND b.role IN ('input', 'exclusive')
    UNION ALL SELECT o_orderkey, t, 'ancestor' FROM l JOIN orders ON o_orderkey = b WHERE n = 2) WHERE src <> dst GROUP BY src, dst)"""


def task_edges(spark: SparkSession, d: str) -> DataFrame:
    return lineage.edges(task_paths(spark, d))


def task_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return lineage.conflicts(task_paths(spark, d))


def task_waves(spark: SparkSession, d: str) -> DataFrame:
    paths = task_paths(spark, d, customers=False)
    return lineage.waves(paths.select("task_id").distinct(), lineage.edges(paths))


def task_status(spark: SparkSession, d: str) -> DataFrame:
    paths = task_paths(spark, d)
    inputs = paths.filter("role = 'input' and path like '/part/%'")
    inventory = _table(spark, d, "part").filter("p_partkey % 97 <> 5").select(F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("hash"))
    w = incremental.world(inputs, inventory)
    now = w.select("task_id", F.sha2(F.col("task_id").cast("string"), 256).alias("signature"), F.col("world").alias("world_in"), F.concat(F.lit("out-"), F.col("task_id") % 9 == 0).alias("world_out"), (F.col("task_id") % 18 == 0).alias("missing_output"))
    k = F.col("task_id")
    stored = now.filter("task_id % 5 <> 0").select("signature", F.when(k % 7 == 0, F.lit("other")).otherwise(F.col("world_in")).alias("world_in"), F.lit("out-false").alias("world_out"))
    return incremental.up_to_date(now, stored).select("task_id", "reason", "hit")


def minimal_cover(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1))
    dirs = _table(spark, d, "pages").select(P.normalize(path).alias("path")).filter("length(path) > 1")
    return incremental.minimal_cover(dirs)


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages")
    target = F.when(F.col("page_id") % 40 == 7, F.lit(-1)).when(F.col("page_id") == 3, F.lit(1)).otherwise(F.floor(F.col("page_id") / 2))
    return lineage.resolve_links(pages.filter("page_id > 0").select(F.col("page_id").alias("path"), target.cast("long").alias("target"), (F.col("page_id") % 40 != 7).alias("exists")))


def action_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    line = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("broken "), "event_type")).otherwise(F.concat(F.lit("[Echo n="), F.col("event_id").cast("string"), F.lit(" raw=TRUE]|"), F.col("user_id").cast("string"), F.lit("|"), "event_type"))
    out = actions.parse(e.select("event_id", line.alias("value")))
    return out.select("event_id", "action", F.coalesce(actions.typed_option(F.col("options"), "n", "bigint"), F.lit(-1)).alias("n"), F.coalesce(actions.typed_option(F.col("options"), "raw", "boolean"), F.lit(False)).alias("raw"), F.array_join("fields", ",").alias("fields"), "error")


def file_resources(spark: SparkSession, d: str) -> DataFrame:
    return search.resources(files(spark, d))


def edit_preview(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return search.unified_diff(f, search.apply_edits(f, [{"old": "License", "new": "Licence", "limit": 1}]))


def dirty_tasks(spark: SparkSession, d: str) -> DataFrame:
    paths = task_paths(spark, d, customers=False)
    return lineage.dirty(lineage.edges(paths), paths.filter("task_id % 1009 = 7").select("task_id"))


def required_access(spark: SparkSession, d: str) -> DataFrame:
    return incremental.required_access(task_paths(spark, d).withColumn("path", F.lower("path")))


def access_check(spark: SparkSession, d: str) -> DataFrame:
    """Files against grants on some of their sources, and a writable grant on English files."""
    f = files(spark, d)
    docs = _table(spark, d, "documents")
    sources = docs.groupBy("source").agg(F.min("doc_id").alias("m")).filter("m % 5 <> 0 and source is not null")
    grants = sources.select(F.concat(F.lit(ROOT + "/"), "source").alias("path"), (F.col("m") % 2 == 0).alias("writable"))
    english = docs.filter("source is not null").select(F.concat(F.lit(ROOT + "/"), "source", F.lit("/en")).alias("path"), F.lit(True).alias("writable")).distinct()
    return access.allowed(f.select("doc_id", "path", (F.col("doc_id") % 3 == 0).alias("need_writable")), grants.unionByName(english)).select("doc_id", "need_writable", "allowed")


def declared_files(spark: SparkSession, d: str) -> DataFrame:
    """For each source a task that declares its directory of English files, a glob over all languages and one file."""
    f = files(spark, d).filter("path is not null")
    s = _table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.min("doc_id").alias("m"))
    base = F.concat(F.lit(ROOT + "/"), "source")
    paths = F.array(F.concat(base, F.lit("/en")), F.concat(base, F.lit("/*/doc_*7.txt")), F.concat(base, F.lit("/fr/doc_"), F.col("m").cast("string"), F.lit(".txt")))
    found = access.declared_files(s.select(F.col("m").alias("task_id"), F.explode(paths).alias("path")), f.select("path", identity.content_hash(F.col("text")).alias("hash")))
    return found.groupBy("task_id", "declared").agg(F.count("path").alias("n"), F.min("path").alias("first_path"))


def gate_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = _table(spark, d, "orders").select(k.alias("signature"), F.when(k % 11 != 0, F.col("o_custkey")).alias("inputs"), F.col("o_totalprice").alias("outputs"), (k % 4).alias("n_outputs"))
    stored = o.filter("signature % 5 <> 0").select("signature", F.when(F.col("signature") % 7 == 0, -1).otherwise(F.col("inputs")).alias("inputs"), F.when(F.col("signature") % 9 == 0, -1.0).otherwise(F.col("outputs")).alias("outputs"))
    return incremental.gate(o, stored).select("signature", "reason", "hit")


def effective_producers(spark: SparkSession, d: str) -> DataFrame:
    edits = _table(spark, d, "lineitem").filter("l_orderkey > 0 and l_linenumber = 3").select(F.col("l_orderkey").alias("task_id"), F.col("l_orderkey").alias("seq"), F.lit("mutating").alias("role"), F.concat(F.lit("/Part/"), F.col("l_partkey").cast("string")).alias("path"))
    return lineage.effective_producers(task_paths(spark, d).unionByName(edits))


def task_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks in their order of execution; stored worlds are missing for some and out of date for others."""
    paths = task_paths(spark, d, customers=False)
    k = F.col("task_id")
    now = lineage.written(paths.select("task_id").distinct()).select("task_id", F.sha2(k.cast("string"), 256).alias("signature"), F.lit("in").alias("world_in"), F.lit("out").alias("world_out"), F.lit(False).alias("missing_output"))
    stored = now.filter("task_id % 1009 <> 7").select("signature", F.when(k % 997 == 11, "other").otherwise(F.col("world_in")).alias("world_in"), "world_out")
    return incremental.forecast(now, stored, lineage.edges(paths))


QUERIES = {f.__name__: f for f in (access_check, declared_files, effective_producers, gate_check, task_forecast, tree_fingerprint, glob_select, directory_tree, globs_anywhere, many_globs, path_functions, snapshot_diff, memo_lookup, grep_context, grep_literal, edit_files, edit_first, edit_unique, nested_tree, task_edges, task_conflicts, task_waves, task_status, minimal_cover, resolve_links, action_stream, file_resources, edit_preview, dirty_tasks, required_access)}

_HASH = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} = '' THEN '0' ELSE sha256({0}) END"
_PAGE = r"p AS (SELECT page_id, rtrim(regexp_replace('/' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1), '/+', '/', 'g'), '/') AS path FROM pages)"
ORACLE = {
    "access_check": f"""WITH {FILES}, s AS (SELECT source, min(doc_id) AS m FROM documents WHERE source IS NOT NULL GROUP BY source)
      SELECT doc_id, doc_id % 3 = 0 AS need_writable, coalesce(path IS NOT NULL AND (lang = 'en' OR m % 5 <> 0 AND (m % 2 = 0 OR doc_id % 3 <> 0)), false) AS allowed FROM f LEFT JOIN s USING (source)""",
    "declared_files": f"""WITH {FILES}, s AS (SELECT source, min(doc_id) AS m FROM documents WHERE source IS NOT NULL GROUP BY source),
      x AS (SELECT m AS task_id, '/corpus/' || source || '/en' AS declared, source, 0 AS k FROM s UNION ALL SELECT m, '/corpus/' || source || '/*/doc_*7.txt', source, 1 FROM s UNION ALL SELECT m, '/corpus/' || source || '/fr/doc_' || m || '.txt', source, 2 FROM s)
      SELECT task_id, declared, count(path) AS n, min(path) AS first_path FROM x LEFT JOIN f ON x.source = f.source AND path IS NOT NULL AND (k = 0 AND lang = 'en' OR k = 1 AND doc_id % 10 = 7 OR k = 2 AND path = declared) GROUP BY task_id, declared""",
    "effective_producers": f"""WITH {TASKS}, r AS (SELECT t, role, path FROM tp UNION ALL SELECT l_orderkey, 'mutating', '/Part/' || l_partkey FROM lineitem WHERE l_orderkey > 0 AND l_linenumber = 3),
      q AS (SELECT t, role, lower(path) AS path, max((role IN ('input', 'exclusive'))::INT) OVER (PARTITION BY lower(path) ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM r)
      SELECT path, max(t) AS task_id FROM q WHERE role = 'output' OR role = 'mutating' AND coalesce(used, 0) = 0 GROUP BY path""",
    "gate_check": """SELECT o_orderkey AS signature, r AS reason, r = 'up to date' AS hit FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'no entry' WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN 'inputs changed'
      WHEN o_orderkey % 4 > 0 AND o_orderkey % 9 = 0 THEN 'outputs changed' ELSE 'up to date' END AS r FROM orders)""",
    "task_forecast": f"""WITH RECURSIVE {TASKS}, g AS (SELECT DISTINCT b AS src, t AS dst FROM l WHERE b IN (SELECT o_orderkey FROM orders) AND b <> t), n AS (SELECT DISTINCT t FROM tp WHERE path NOT LIKE '/customer/%'),
      w(task_id, wave) AS (SELECT t, 0 FROM n WHERE t NOT IN (SELECT dst FROM g) UNION SELECT g.dst, w.wave + 1 FROM w JOIN g ON g.src = w.task_id),
      b(task_id) AS (SELECT t FROM n WHERE t % 1009 = 7 OR t % 997 = 11 UNION SELECT g.dst FROM b JOIN g ON g.src = b.task_id),
      j AS (SELECT t AS task_id, CASE WHEN t % 1009 = 7 THEN 'new task' WHEN t % 997 = 11 THEN 'inputs changed' ELSE 'up to date' END AS reason FROM n)
      SELECT task_id, wave, reason = 'up to date' AS hit, reason, reason = 'up to date' AND task_id IN (SELECT task_id FROM b) AS may_change FROM j JOIN (SELECT task_id, CAST(max(wave) AS INT) AS wave FROM w GROUP BY task_id) USING (task_id)""",
    "file_resources": f"WITH {FILES} SELECT path, name, 'file://' || path AS uri, 'text/plain' AS mime FROM f",
    "dirty_tasks": f"""WITH RECURSIVE {TASKS}, g AS (SELECT DISTINCT b AS src, t AS dst FROM l WHERE b IN (SELECT o_orderkey FROM orders) AND b <> t),
      w(task_id, distance) AS (SELECT t, 0 FROM (SELECT DISTINCT t FROM tp WHERE path NOT LIKE '/customer/%') WHERE t % 1009 = 7 UNION SELECT g.dst, w.distance + 1 FROM w JOIN g ON g.src = w.task_id) SELECT task_id, CAST(min(distance) AS INT) AS distance FROM w GROUP BY task_id""",
    "required_access": f"""WITH {TASKS}, w AS (SELECT DISTINCT '/' || string_split(path, '/')[2] AS path FROM tp WHERE role <> 'input')
      SELECT path, true AS writable FROM w UNION ALL SELECT DISTINCT path, false FROM tp WHERE role = 'input' AND '/' || string_split(path, '/')[2] NOT IN (SELECT path FROM w)""",
    "tree_fingerprint": f"WITH {FILES} SELECT source, count(*) AS n_files, sha256(string_agg({_HASH.format('text')}, '' ORDER BY reverse(path))) AS fingerprint FROM f WHERE lang = 'en' AND NOT regexp_matches(name, '^doc_[^/]*7\\.txt$') AND text IS NOT NULL GROUP BY source",
    "glob_select": f"""WITH {FILES} SELECT path, rel, size FROM f WHERE (lang = 'en' OR source LIKE 'src1_%' AND source <> 'src' OR starts_with(source, 'src1') OR name LIKE 'doc\\_%7.txt' ESCAPE '\\'
      OR source IN ('src2', 'src3') AND regexp_matches(lang, '^[de][ens]$') AND regexp_matches(name, '^doc_.[0-4].*\\.txt$') OR regexp_matches(rel, 'doc_\\d*99\\.'))
      AND NOT (source = 'src13' OR source = 'src14' AND lang = 'fr' OR source = 'src15' AND starts_with(name, 'doc_1') OR regexp_matches(name, '^doc_.*[05]\\.txt$'))""",
    "directory_tree": f"WITH {FILES}, a AS (SELECT DISTINCT '/corpus/' || source AS path, '/corpus' AS parent, source AS name, 1 AS depth FROM f UNION SELECT DISTINCT '/corpus/' || source || '/' || lang, '/corpus/' || source, lang, 2 FROM f) SELECT path, 'directory' AS kind, parent, name, CAST(depth AS INT) AS depth FROM a",
    "globs_anywhere": f"""WITH {FILES}, p AS (SELECT path, lower(rel) AS rel, lower(name) AS name, lower(lang) AS lang FROM f WHERE path IS NOT NULL), i AS (SELECT range AS i FROM range(100)), j AS (SELECT range AS i FROM range(10)),
      h AS (SELECT '**/doc_*' || lpad(i::VARCHAR, 2, '0') || '.txt' AS pattern, path FROM p JOIN i ON name GLOB 'doc_*' || lpad(i::VARCHAR, 2, '0') || '.txt'
        UNION ALL SELECT '**/e?/doc_' || i || '*', path FROM p JOIN j ON name GLOB 'doc_' || i || '*' AND lang GLOB 'e?' UNION ALL SELECT '**/[df]*/doc_' || i || '*', path FROM p JOIN j ON name GLOB 'doc_' || i || '*' AND lang GLOB '[df]*'
        UNION ALL SELECT '**', path FROM p UNION ALL SELECT '*/*/*_1?.txt', path FROM p WHERE name GLOB '*_1?.txt')
      SELECT pattern, count(*) AS n, min(path) AS first_path FROM h GROUP BY pattern""",
    "many_globs": f"WITH {FILES}, g AS (SELECT i, l, 'src' || i || '/' || l || '/doc_*' || (i % 10) || '.txt' AS pattern FROM range(20) AS r(i), (VALUES ('en'), ('d?')) AS v(l)) SELECT pattern, count(*) AS n, min(path) AS first_path FROM f JOIN g ON source = 'src' || i AND (lang = l OR l = 'd?' AND regexp_matches(lang, '^d.$')) AND name LIKE 'doc%' || (i % 10) || '.txt' GROUP BY pattern",
    "path_functions": f"""WITH {_PAGE}, q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s, (page_id * 37) % 4096 AS m FROM p)
      SELECT page_id, path, s[-1] AS name, CAST(len(s) AS BIGINT) AS depth, array_to_string(list_transform(range(1, len(s)), lambda i: '/' || array_to_string(s[1:i], '/')), ',') AS up, 'file://' || path AS uri,
      CAST(m // 512 AS VARCHAR) || (m // 64) % 8 || (m // 8) % 8 || m % 8 AS octal, strftime(make_timestamp((page_id * 1000000007000) // 1000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM q""",
    "snapshot_diff": f"""WITH {FILES}, a AS (SELECT path, {_HASH.format('text')} AS h, length(text) AS s FROM f WHERE doc_id % 13 <> 0),
      n AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN coalesce(text, '') || ' edited' ELSE text END AS t FROM f WHERE doc_id % 17 <> 0), b AS (SELECT path, {_HASH.format('t')} AS h, length(t) AS s FROM n),
      j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.h = b.h AND a.s = b.s THEN NULL ELSE 'modified' END AS change, a.h AS ah, b.h AS bh, a.s AS sa, b.s AS sb FROM a FULL JOIN b ON a.path = b.path)
      SELECT path, change, CASE WHEN change = 'modified' THEN concat_ws(';', CASE WHEN ah = bh THEN NULL ELSE concat_ws(':', 'hash', ah, bh) END, CASE WHEN sa = sb THEN NULL ELSE concat_ws(':', 'size', sa, sb) END) END AS details FROM j WHERE change IS NOT NULL""",
    "memo_lookup": f"""WITH {FILES}, r AS (SELECT doc_id, size + (doc_id % m = 1)::INT AS tag, 'h' || m || '-' || doc_id AS hash, doc_id % 50 AS epoch, t FROM f, (VALUES (0, 5), (1, 3), (2, 2)) AS v(t, m) WHERE doc_id % m <> 0),
      x AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t DESC) = 1), y AS (SELECT * FROM x WHERE epoch + 32 >= (SELECT max(epoch) FROM r))
      SELECT path, coalesce(tag = size, false) AS hit, CASE WHEN tag = size THEN hash END AS hash FROM f LEFT JOIN y USING (doc_id)""",
    "grep_context": f"""WITH {FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM f),
      m AS (SELECT path, line, regexp_replace(x, '\\r$', '') AS text, regexp_matches(regexp_replace(x, '\\r$', ''), '\\bthe[a-z]*ing\\b') AS is_match FROM l WHERE NOT (line = n AND x = '')),
      w AS (SELECT *, max(is_match::INT) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM m)
      SELECT path, CAST(line AS BIGINT) AS line, text, is_match, coalesce(line - lag(line) OVER (PARTITION BY path ORDER BY line) > 1, false) AS separator FROM w WHERE near = 1""",
    "grep_literal": f"WITH {FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f) SELECT path, CAST(line AS BIGINT) AS line, regexp_replace(x, '\\r$', '') AS text FROM l WHERE contains(lower(x), 'license')",
    "edit_first": rf"WITH {FILES} SELECT path, sha256(CASE WHEN regexp_matches(text, '(\w+), ') THEN regexp_replace(regexp_replace(text, '(\w+), ', '\1; '), '(\w+), ', '\1; ') ELSE text END) AS text_hash, CASE WHEN NOT regexp_matches(text, '(\w+), ') THEN 'edit 0: no match' END AS error FROM f",
    "nested_tree": f"""WITH {FILES}, l AS (SELECT source, lang, '{{"name":"' || lang || '","kind":"directory","children":[' || string_agg('{{"name":"' || name || '","kind":"file"}}', ',' ORDER BY name) || ']}}' AS j FROM f GROUP BY source, lang)
      SELECT '/corpus/' || source AS path, '{{"name":"' || source || '","kind":"directory","children":[' || string_agg(j, ',' ORDER BY lang) || ']}}' AS json FROM l GROUP BY source""",
    "edit_unique": f"WITH {FILES}, c AS (SELECT path, text, len(string_split(text, 'License')) - 1 AS n FROM f) SELECT path, sha256(CASE WHEN n = 1 THEN replace(text, 'License', 'Licence') ELSE text END) AS text_hash, CASE WHEN n = 0 THEN 'edit 0: no match' WHEN n > 1 THEN 'edit 0: ' || n || ' matches' END AS error FROM c",
    "task_edges": f"WITH {TASKS} SELECT src, dst, reason FROM e",
    "task_conflicts": f"""WITH {TASKS} SELECT 'duplicate producer' AS rule, path, count(DISTINCT t) AS n FROM tp WHERE role = 'output' GROUP BY path HAVING count(DISTINCT t) > 1
      UNION ALL SELECT 'shared exclusive', path, count(*) FROM tp WHERE role IN ('input', 'exclusive') GROUP BY path HAVING count(*) > 1 AND bool_or(role = 'exclusive')""",
    "task_waves": f"""WITH RECURSIVE {TASKS}, g AS (SELECT DISTINCT b AS src, t AS dst FROM l WHERE b IN (SELECT o_orderkey FROM orders) AND b <> t),
      w(task_id, wave) AS (SELECT t, 0 FROM (SELECT DISTINCT t FROM tp WHERE path NOT LIKE '/customer/%') WHERE t NOT IN (SELECT dst FROM g) UNION SELECT g.dst, w.wave + 1 FROM w JOIN g ON g.src = w.task_id) SELECT task_id, CAST(max(wave) AS INT) AS wave FROM w GROUP BY task_id""",
    "task_status": f"""WITH {TASKS}, i AS (SELECT DISTINCT t, p FROM l), j AS (SELECT t, bool_or(p_partkey IS NULL) AS bad FROM i LEFT JOIN (SELECT * FROM part WHERE p_partkey % 97 <> 5) ON p = p_partkey GROUP BY t),
      r AS (SELECT t AS task_id, CASE WHEN bad THEN 'missing input' WHEN t % 5 = 0 THEN 'new task' WHEN t % 7 = 0 THEN 'inputs changed' WHEN t % 18 = 0 THEN 'output missing' WHEN t % 9 = 0 THEN 'products changed' ELSE 'up to date' END AS reason FROM j) SELECT task_id, reason, reason = 'up to date' AS hit FROM r""",
    "resolve_links": """WITH RECURSIVE l AS (SELECT page_id AS path, CASE WHEN page_id % 40 = 7 THEN -1 WHEN page_id = 3 THEN 1 ELSE page_id // 2 END AS target, page_id % 40 <> 7 AS there FROM pages WHERE page_id > 0),
      w(path, target, hops, there) AS (SELECT path, target, 1, there FROM l UNION ALL SELECT w.path, l.target, hops + 1, l.there FROM w JOIN l ON w.target = l.path)
      SELECT path, target, CAST(hops AS INT) AS hops, CASE WHEN there THEN 'resolved' ELSE 'broken' END AS state FROM w WHERE target NOT IN (SELECT path FROM l)""",
    "edit_files": rf"""WITH {FILES}, a AS (SELECT path, text, string_split(text, 'the ') AS s FROM f), b AS (SELECT path, text, len(s) - 1 AS n, CASE WHEN len(s) <= 3 THEN array_to_string(s, 'THE ') ELSE s[1] || 'THE ' || s[2] || 'THE ' || array_to_string(s[3:], 'the ') END AS one FROM a)
      SELECT path, sha256(CASE WHEN n = 0 THEN text WHEN NOT regexp_matches(one, '(\w+), (\w+)') THEN one ELSE regexp_replace(one, '(\w+), (\w+)', '\2; \1', 'g') END) AS text_hash,
      CASE WHEN n = 0 THEN 'edit 0: no match' WHEN NOT regexp_matches(one, '(\w+), (\w+)') THEN 'edit 1: no match' END AS error FROM b""".replace("\\\\", "\\"),
    "edit_preview": f"""WITH {FILES}, l AS (SELECT path, string_split(text, chr(10)) AS s FROM f WHERE len(string_split(text, 'License')) = 2), p AS (SELECT path, s, list_position(list_transform(s, lambda x: contains(x, 'License')), true) AS i, len(s) AS n FROM l)
      SELECT path, CAST(greatest(i - 3, 1) AS INT) AS start, CAST(least(n, i + 3) - greatest(i - 3, 1) + 1 AS INT) AS old_lines, CAST(least(n, i + 3) - greatest(i - 3, 1) + 1 AS INT) AS new_lines,
      array_to_string(list_concat(list_transform(s[greatest(i - 3, 1):i - 1], lambda x: ' ' || x), ['-' || s[i], '+' || replace(s[i], 'License', 'Licence')], list_transform(s[i + 1:least(n, i + 3)], lambda x: ' ' || x)), chr(10)) AS hunk FROM p""",
    "minimal_cover": f"WITH {_PAGE}, d AS (SELECT DISTINCT path FROM p WHERE length(path) > 1) SELECT path FROM d WHERE NOT EXISTS (SELECT 1 FROM d u WHERE starts_with(d.path, u.path || '/'))",
    "action_stream": "SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN 'echo' END AS action, CASE WHEN event_id % 97 <> 0 THEN event_id ELSE -1 END AS n, event_id % 97 <> 0 AS raw, CASE WHEN event_id % 97 <> 0 THEN user_id || ',' || event_type END AS fields, CASE WHEN event_id % 97 = 0 THEN 'malformed line' END AS error FROM events",
}
