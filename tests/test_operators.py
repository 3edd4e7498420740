import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import access, identity, incremental, lineage, search, select
from corpusloom.plans import globs
from corpusloom.sources import corpus
from corpusloom.streaming import actions


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_paths(spark):
    df = spark.createDataFrame([("/a/./b//c/../d/",), ("a/../../b",), ("/..",), ("x.TAR.gz",)], "p string")
    got = df.select(P.normalize(F.col("p")), P.extension(F.col("p")), P.basename(F.col("p"))).collect()
    assert [g[0] for g in got] == ["/a/b/d", "../b", "/", "x.TAR.gz"] and got[3][1] == "gz" and got[0][2] == "d"
    modes = spark.createDataFrame([("file", 0o4755), ("directory", 0o1777), ("file", 0o644)], "k string, m int")
    assert [r[0] for r in modes.select(P.permissions(F.col("k"), F.col("m"))).collect()] == ["-rwsr-xr-x", "drwxrwxrwt", "-rw-r--r--"]


def test_expand(spark):
    df = spark.createDataFrame([("a${X}b${Y}",), ("${Z}",), ("${X",), ("$(X)-${Z}!",), ("plain ${}",)], "t string")
    env = {"X": "1", "Y": "2"}
    assert [r[0] for r in df.select(P.expand(F.col("t"), env)).collect()] == ["a1b2", None, None, None, "plain ${}"]
    assert [r[0] for r in df.select(P.expand(F.col("t"), env, strict=False)).collect()][3] == "1-!"


def test_select(spark):
    files = spark.createDataFrame([(p,) for p in ("/r/a.txt", "/r/src/b.c", "/r/src/gen/c.c", "/r/tmp/d.c", "/rx/e.c", "/r/src/F.C")], "path string")
    got = lambda **k: {r.rel for r in select.select_files(files, "/r", **k).collect()}
    assert got() == {"a.txt", "src/b.c", "src/gen/c.c", "tmp/d.c", "src/F.C"}
    assert got(globs=["*.c"], excludes=["tmp", "/r/src/gen"]) == {"src/b.c", "src/F.C"}
    assert got(regexes=["GEN/"]) == {"src/gen/c.c"} and got(globs=["src/*.c"]) == {"src/b.c", "src/F.C"}
    with pytest.raises(Exception, match="PatternSyntax|Unclosed"):
        got(regexes=["("])


def test_snapshots_and_fingerprints(spark, tmp_path):
    (tmp_path / "t" / "d").mkdir(parents=True)
    (tmp_path / "t" / "a.txt").write_text("one")
    (tmp_path / "t" / "d" / "b.bin").write_bytes(b"\xff\x00")
    (tmp_path / "t" / "c").write_text("three")
    inv = corpus.scan(spark, [str(tmp_path / "t")])
    snap = inv.withColumn("hash", identity.content_hash(F.col("content")))
    assert {r.path.rpartition("/")[2]: r.kind for r in corpus.read_content(inv).collect()} == {"a.txt": "text", "b.bin": "base64", "c": "text"}
    for name in ("s", "s.json"):
        corpus.write_snapshot(snap, str(tmp_path / name))
        back = corpus.read_snapshot(spark, str(tmp_path / name))
        assert not identity.diff_snapshots(snap.drop("content"), back, fields=("size", "mtime_ns")).collect()
    with pytest.raises(ValueError):
        corpus.write_snapshot(snap, str(tmp_path / "s.plist"))
    a = spark.createDataFrame([("x", "1", 1), ("y", "2", 2), ("n", None, 3)], "path string, hash string, size long")
    b = spark.createDataFrame([("x", "9", 1), ("z", "2", 2), ("n", None, 3)], "path string, hash string, size long")
    assert rows(identity.diff_snapshots(a, b).select("path", "change")) == [("n", "modified"), ("x", "modified"), ("y", "removed"), ("z", "added")]
    corpus.shared_dir(spark)
    tree = snap.withColumn("rel", F.col("path"))
    assert identity.chunked_fingerprint(tree, chunk=2).first()["n_files"] == 3


def test_search_and_edits(spark):
    files = spark.createDataFrame([("f", "one\r\ntwo\nthree\nfour\nfive two\n"), ("g", "nothing")], "path string, text string")
    assert rows(search.grep(files, "two", context=1)) == [("f", 1, "one", False, False), ("f", 2, "two", True, False), ("f", 3, "three", False, False), ("f", 4, "four", False, False), ("f", 5, "five two", True, False)]
    edit = lambda *e: {r.path: (r.text, r.error) for r in search.apply_edits(files, list(e)).collect()}
    assert edit({"old": "two", "new": "2", "limit": 0})["f"][0] == "one\r\n2\nthree\nfour\nfive 2\n"
    assert edit({"old": "two", "new": "2"})["f"][1] == "edit 0: 2 matches" and edit({"old": "two", "new": "2"})["g"][1] == "edit 0: no match"
    assert edit({"old": "^(t)(\\w+)", "new": r"$2\1", "limit": 0, "regex": True}, {"old": "four", "new": "$4"})["f"] == ("one\r\nwot\nhreet\n$4\nfive two\n", None)
    with pytest.raises(ValueError):
        search.template(r"\2", 1)


def test_edit_first_and_block(spark):
    files = spark.createDataFrame([("f", "a1 b2 c3 d4"), ("g", "if x:\n    one\n      two\n\n    three\nend\n"), ("h", "  one\n    two\n one\n   two"), ("n", None)], "path string, text string")
    edit = lambda **e: {r.path: (r.text, r.error) for r in search.apply_edits(files, [e]).collect()}
    assert edit(old=r"([a-d])(\d)(?= |$)", new=r"\2$1$$\\", limit=3, regex=True)["f"] == ("1a$\\ 2b$\\ 3c$\\ d4", None)
    assert edit(old="A", new="$1", limit=5, ignore_case=True)["f"] == ("$11 b2 c3 d4", None)
    assert edit(old="x*", new="y", limit=2, regex=True)["f"][1] == "edit 0: empty match"
    assert edit(old="\tone\n\t  two\n", new="1\n 2\n", limit=1)["g"] == ("if x:\n    1\n     2\n\n\n    three\nend\n", None)
    got = edit(old="one\n  two", new="1", limit=1)
    assert got["g"] == ("if x:\n    1\n    three\nend\n", None) and got["h"][1] == "edit 0: 2 matches" and got["f"][1] == "edit 0: no match" and got["n"][0] is None
    assert edit(old=" end", new="END", limit=1)["g"][0].endswith("three\nEND")


def test_binary(spark):
    rows_ = spark.createDataFrame([(bytearray(b"\x10\x02"),), (bytearray(b"\x10\x02\x00"),), (bytearray(b"x" * 4096 + b"\x00"),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in rows_.select(search.is_binary(F.col("c"))).collect()] == [False, True, False, False]


def test_fingerprints_of_groups(spark):
    """A group is hashed whole, over many partitions and pieces, and no aggregate holds it."""
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    data = [(f"/r/{i}", str(i), h(str(i)) if i % 50 else None, None if i % 4 == 0 else "big" if i % 10 else "small") for i in range(3000)]
    files = spark.createDataFrame(data + data[:99], "path string, rel string, hash string, g string").repartition(7)
    groups = {g: sorted((p[::-1], x) for p, _, x, y in data if x and y == g) for g in (None, "big", "small")}
    one = identity.tree_fingerprint(files, ["g"])
    assert {r.g: (r.n_files, r.fingerprint) for r in one.collect()} == {g: (len(v), h("".join(x for _, x in v))) for g, v in groups.items()}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "listagg(item" not in plan or "piece" in plan.split("listagg(item")[0].rpartition("Aggregate")[2]
    two = {r.g: (r.n_files, r.fingerprint) for r in identity.chunked_fingerprint(files, chunk=100, by=["g"]).collect()}
    assert two == {g: (len(v), h("".join(h("".join(x for _, x in v[i : i + 100])) for i in range(0, len(v), 100)))) for g, v in groups.items()}
    whole = sorted((p[::-1], x) for p, _, x, _ in data if x)
    assert rows(identity.tree_fingerprint(files, [])) == [(len(whole), h("".join(x for _, x in whole)))]
    assert rows(identity.tree_fingerprint(files.limit(0), [])) == [(0, None)] and rows(identity.tree_fingerprint(files.limit(0), ["g"])) == []


def test_nested_tree(spark):
    files = spark.createDataFrame([("/r/b/x.txt",), ("/r/b/c/y",), ("/r/a\"q",)], "path string")
    entries = select.with_directories(files, "/r")
    got = {r.path: json.loads(r.json) for r in select.nested_tree(entries).collect()}
    assert got == {"/r/a\"q": {"name": 'a"q', "kind": "file"}, "/r/b": {"name": "b", "kind": "directory", "children": [{"name": "c", "kind": "directory", "children": [{"name": "y", "kind": "file"}]}, {"name": "x.txt", "kind": "file"}]}}
    assert json.loads(select.nested_tree(entries, 1).filter("path = '/r/b'").first().json) == {"name": "b", "kind": "directory"}


def test_manifest(spark, tmp_path):
    at = f"file://{tmp_path}/m"
    assert corpus.read_manifest(spark, at, 1, "p", "sha256").count() == 0
    for w in ("old", "new"):
        corpus.write_manifest(spark.createDataFrame([("s", w, None)], "signature string, world_in string, world_out string"), at, 1, "p", "sha256")
    assert rows(corpus.read_manifest(spark, at, 1, "p", "sha256")) == [("s", "new", None)]
    assert corpus.read_manifest(spark, at, 2, "p", "sha256").count() == 0 and corpus.read_manifest(spark, at, 1, "q", "sha256").count() == 0


def _paths(spark, *r):
    return spark.createDataFrame([(t, t, role, p) for t, role, p in r], "task_id long, seq long, role string, path string")


def test_edges_conflicts_waves(spark):
    tp = _paths(spark, (1, "output", "/a"), (2, "input", "/A"), (2, "output", "/b/c"), (3, "input", "/b/c/d"), (4, "input", "/b/*"), (5, "output", "/gen/*.o"), (6, "input", "/gen/x.o"), (7, "input", "/gen/**"), (8, "output", "/b"))
    assert rows(lineage.edges(tp)) == [(1, 2, "explicit"), (2, 3, "ancestor"), (2, 4, "glob"), (5, 6, "glob"), (5, 7, "glob"), (8, 2, "implicit")]
    bad = _paths(spark, (1, "output", "/x"), (2, "output", "/X"), (3, "exclusive", "/d"), (4, "input", "/d"), (5, "input", "/d/e"), (6, "output", "/d/f"), (7, "mutating", "/d"))
    assert rows(lineage.conflicts(bad)) == sorted([("duplicate producer", "/x", 2), ("shared exclusive", "/d", 2), ("consumer under exclusive", "/d/e", 1), ("producer under exclusive", "/d/f", 1), ("mutate vs exclusive", "/d", 1)], key=str)
    t = spark.createDataFrame([(i,) for i in range(6)], "task_id long")
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (4, 5)], "src long, dst long")
    assert rows(lineage.waves(t, e)) == sorted([(0, 0), (1, 1), (2, 2), (3, None), (4, None), (5, None)], key=str)
    m = _paths(spark, (1, "input", "/f"), (2, "mutating", "/*"), (3, "input", "/f"), (4, "output", "/f"), (5, "mutating", "/f"))
    assert rows(lineage.mutator_edges(m)) == sorted([(2, 5, "mutators"), (1, 2, "reader"), (2, 3, "reader"), (4, 2, "maker"), (4, 5, "maker"), (1, 5, "reader"), (3, 5, "reader")], key=str)


def test_no_caps(spark):
    """Long chains of links, many options on a line, classes beyond Latin."""
    links = [(i, i + 1, True) for i in range(100)] + [(200 + i, 201 + i, False) for i in range(70)] + [(300 + i, 300 + (i + 1) % 80, True) for i in range(80)] + [(400, 300, True)]
    got = {r.path: (r.target, r.hops, r.state) for r in lineage.resolve_links(spark.createDataFrame(links, "path long, target long, exists boolean")).collect()}
    assert len(got) == len(links) and got[0] == (100, 100, "resolved") and got[40] == (100, 60, "resolved") and got[200] == (270, 70, "broken")
    assert {got[i][2] for i in (300, 379, 400)} == {"cycle"}
    line = "[echo " + " ".join(f"k{i}={i}" for i in range(90)) + "]|a"
    assert len(actions.parse(spark.createDataFrame([(line,), ("[echo]|a",)], "value string")).first()["options"]) == 90
    assert globs.overlap("[а-я].txt", "б.*") and globs.overlap("[一-龥]*", "[!a]") and globs.overlap("[α-ω]", "[!α-ψ]") and not globs.overlap("[а-я].txt", "α.*")


def test_links_cover_status(spark):
    links = spark.createDataFrame([(1, 2, True), (2, 9, True), (3, 4, True), (4, 3, True), (5, 3, True), (6, 8, False)], "path long, target long, exists boolean")
    assert {r.path: (r.target, r.state) if r.state != "cycle" else "cycle" for r in lineage.resolve_links(links).collect()} == {1: (9, "resolved"), 2: (9, "resolved"), 3: "cycle", 4: "cycle", 5: "cycle", 6: (8, "broken")}
    log = spark.createDataFrame([("/a/b/f", "file-write-data"), ("/a/b/c/g", "file-read-data"), ("/d/h", "file-read-data"), ("/d/e/i", "file-read-data"), ("/z", "mach-lookup")], "path string, operation string")
    assert rows(incremental.access_policy(log)) == [("/a/b", True), ("/d", False)]
    tasks = spark.createDataFrame([("s1", "i", "o", False), ("s2", None, "o", False), ("s3", "i", "o", False), ("s4", "x", "o", False), ("s5", "i", "x", True), ("s6", "i", None, False)], "signature string, world_in string, world_out string, missing_output boolean")
    manifest = spark.createDataFrame([(f"s{k}", "i", "o") for k in (1, 2, 4, 5, 6)], "signature string, world_in string, world_out string")
    assert {r.signature: r.reason for r in incremental.up_to_date(tasks, manifest).collect()} == {"s1": "up to date", "s2": "missing input", "s3": "new task", "s4": "inputs changed", "s5": "output missing", "s6": "products changed"}
    done = spark.createDataFrame([("s1", "hit", None, None), ("s2", "ok", "a", "b"), ("s4", "ok", None, "b"), ("s5", "failed", None, None), ("s6", "pruned", None, None)], "signature string, outcome string, world_in string, world_out string")
    assert rows(incremental.next_manifest(manifest, done)) == [("s1", "i", "o"), ("s2", "a", "b"), ("s5", "i", "o")]


def test_playlist(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"one": [{"action": "copy", "from": "a", "to": "b",},], "two": []}')
    got = corpus.playlist(spark, str(tmp_path / "p.json"), "struct<action:string,`from`:string,`to`:string>")
    assert [(r.key, r.seq, r.step.action) for r in got.collect()] == [("one", 0, "copy")]
    steps = got.select(F.lit(1).alias("task_id"), "seq", "step.*")
    assert rows(lineage.declare(steps)) == [(1, 0, "input", "a"), (1, 0, "output", "b")]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = ["[create n=1]|f|text", "junk", "  [Echo]\thello\tworld", "[fly]|x"]
    (source / "1.txt").write_text("\n".join(lines))
    q = actions.parse(spark.readStream.text(str(source))).writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.value: (r.action, r.error) for r in spark.table("parsed").collect()}
    assert got == {lines[0]: ("create", None), "junk": (None, "malformed line"), lines[2]: ("echo", None), "[fly]|x": ("fly", "unknown action")}
    data = tmp_path / "order"
    data.mkdir()
    for k, part in enumerate(([("b", 2, "2", "item"), ("b", 0, "0", "item")], [("b", 1, None, "none"), ("b", 4, "4", "item")], [("b", 1, "late", "item"), ("b", None, None, "end")])):
        (data / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("batch", "action_index", "text", "kind"), r))) for r in part))
        import os

        os.utime(data / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("batch string, action_index long, text string, kind string").option("maxFilesPerTrigger", 1).json(str(data))
    q = actions.in_order(stream).writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.action_index, r.text, r.late) for r in spark.table("ordered").collect()] == [(0, "0", False), (2, "2", False), (1, "late", True), (4, "4", False)]


def test_no_nested_loops(spark):
    from corpusloom.plans import queries

    d = "/root/testdata/sf0.001"
    for name in ("many_globs", "task_edges", "minimal_cover"):
        plan = queries.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_preview_resources_and_logs(spark):
    a = spark.createDataFrame([("f", "\n".join("abcdefghij")), ("g", "same")], "path string, text string")
    b = spark.createDataFrame([("f", "\n".join("abcdEFghij")), ("g", "same")], "path string, text string")
    assert rows(search.unified_diff(a, b)) == [("f", 2, 8, 8, " b\n c\n d\n-e\n-f\n+E\n+F\n g\n h\n i")]
    c = spark.createDataFrame([("f", "\n".join("abcdeefghij"))], "path string, text string")
    assert rows(search.unified_diff(a, c)) == [("f", 3, 6, 7, " c\n d\n e\n+e\n f\n g\n h")]
    got = search.resources(spark.createDataFrame([("/a b/x.PNG",), ("/n*o",)], "path string"))
    assert rows(got) == [("/a b/x.PNG", "x.PNG", "file:///a%20b/x.PNG", "image/png"), ("/n*o", "n*o", "file:///n%2Ao", None)]
    log = spark.createDataFrame([("kernel: sh(12) deny(1) file-read-data /a/b",), ("x(3) deny(1) mach-lookup /q",), ("noise",)], "value string")
    assert rows(incremental.violations(log)) == [(12, "file-read-data", "/a/b")]
    tp = _paths(spark, (1, "input", "/r/s/*.c"), (1, "output", "/w/o/x"), (2, "mutating", "/w/**"), (3, "input", "/w/q"))
    assert rows(incremental.required_access(tp)) == [("/r/s", False), ("/w", True)]
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 2), (2, 0)], "src long, dst long")
    assert rows(lineage.dirty(e, spark.createDataFrame([(1,)], "task_id long"))) == [(0, 2), (1, 0), (2, 1)]


def _table(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_access(spark):
    asked = _table(spark, "path string, need_writable boolean", ("/a/b/c", True), ("/a/b/c", False), ("/ab", None), ("/w", True), ("/w", True), (None, False))
    grants = _table(spark, "path string, writable boolean", ("/a", False), ("/a", False), ("/w", True))
    assert rows(access.allowed(asked, grants)) == [("/a/b/c", False, True), ("/a/b/c", True, False), ("/ab", None, False), ("/w", True, True), ("/w", True, True), (None, False, False)]
    assert rows(access.allowed(asked, _table(spark, "path string, writable boolean", ("/", True))).filter("not allowed")) == [(None, False, False)]
    excludes = _table(spark, "pattern string", ("*.o",), ("/a/x/*.o",), ("/ab/*",), ("/q",))
    assert rows(access.stale_excludes(excludes, _table(spark, "path string", ("/a/**/*.c",), ("/q",)))) == [("/ab/*",)]
    links = _table(spark, "target string, state string", ("/r/in", "resolved"), ("/out/x", "resolved"), ("/out", "resolved"), ("/no", "broken"))
    assert rows(access.outside_targets(links, _table(spark, "path string", ("/r",)))) == [("/out",)]
    declared = _table(spark, "task_id int, path string", (1, "/s/a.c"), (2, "/s"), (2, "/s"), (3, "/s/**/*.C"), (3, "*.h"), (4, "/none"), (5, "/s/a"))
    files = _table(spark, "path string, hash string", ("/s/a.c", "1"), ("/s/d/b.c", "2"), ("/x.h", "3"), ("/sx", None))
    want = [(1, "/s/a.c", "/s/a.c"), (2, "/s", "/s/a.c"), (2, "/s", "/s/d/b.c"), (3, "*.h", "/x.h"), (3, "/s/**/*.C", "/s/a.c"), (3, "/s/**/*.C", "/s/d/b.c"), (4, "/none", None), (5, "/s/a", None)]
    assert rows(access.declared_files(declared, files).select("task_id", "declared", "path")) == want


def test_gates_and_forecasts(spark):
    tasks = _table(spark, "signature int, inputs int, outputs int, n_outputs int", (1, 1, 1, 1), (2, 2, 2, 1), (3, 3, 9, 1), (4, 4, None, 0), (5, 5, 5, 1), (6, None, 6, 1), (7, 7, None, 1))
    stored = _table(spark, "signature int, inputs int, outputs int", (1, 1, 1), (2, 0, 2), (3, 3, 3), (4, 4, None), (6, None, 6), (7, 7, None))
    assert {r.signature: r.reason for r in incremental.gate(tasks, stored).collect()} == {1: "up to date", 2: "inputs changed", 3: "outputs changed", 4: "up to date", 5: "no entry", 6: "inputs changed", 7: "outputs changed"}
    manifest = _table(spark, "key string, signature string, world_in string", ("k", "a", "1"), ("k", "b", "2"), ("other", "b", "3"), ("k", "b", "4"))
    assert rows(incremental.prune(manifest, _table(spark, "signature string", ("a",)), "k")) == [("k", "a", "1"), ("other", "b", "3")]
    assert incremental.prune(manifest, _table(spark, "signature string"), "k", partial=True).count() == 4
    now = _table(spark, "task_id int, signature string, world_in string, world_out string, missing_output boolean", *((i, f"s{i}", "i", "o", False) for i in range(5)))
    known = _table(spark, "signature string, world_in string, world_out string", *((f"s{i}", "x" if i == 1 else "i", "o") for i in range(5)))
    edge = _table(spark, "src int, dst int", (0, 1), (1, 2), (2, 3))
    up = "up to date"
    assert rows(incremental.forecast(now, known, edge)) == [(0, 0, True, up, False), (1, 1, False, "inputs changed", False), (2, 2, True, up, True), (3, 3, True, up, True), (4, 0, True, up, False)]
    assert incremental.forecast(now.filter("false"), known, edge.filter("false")).count() == 0
    counts = incremental.outcome_counts(_table(spark, "outcome string", ("hit",), ("ok",), ("ok",), ("failed",), (None,)))
    assert rows(counts) == [(5, 1, 2, 1)]
    kinds = _table(spark, "path string, kind string", ("/a", "file"))
    one = lambda p: incremental.existence(_table(spark, "task_id int, path string", (1, p)), kinds).first()["world"]
    assert one("/a") != one("/b") and one("/a") == one("/a")
    kept, cacheable = incremental.expand_declared(_table(spark, "task_id int, path string", (1, "${X}/a"), (1, "${Y}/b"), (2, "c")), {"X": "/x"})
    assert rows(kept) == [(1, "/x/a"), (2, "c")] and rows(cacheable) == [(1, False), (2, True)]


def test_effective_producers_and_bases(spark):
    tp = _paths(spark, (1, "output", "/A"), (2, "mutating", "/a"), (3, "input", "/a"), (4, "mutating", "/a"), (5, "output", "/b"), (6, "exclusive", "/b"), (7, "mutating", "/b"), (8, "mutating", "/c"), (9, "mutating", "/d/*"))
    assert rows(lineage.effective_producers(tp)) == [("/a", 2), ("/b", 5), ("/c", 8)]
    files = _table(spark, "path string", ("/r/s/a",), ("/r/b",), ("/rx/c",))
    assert rows(identity.relative_to(files, _table(spark, "path string", ("/r",), ("/r/s/",)))) == [("/r/b", "b"), ("/r/s/a", "a"), ("/rx/c", "/rx/c")]
    old, new = (_table(spark, "name string, value string", *p.items()) for p in ({"mode": "content", "hash_algorithm": "sha256", "gone": "1"}, {"mode": "content", "hash_algorithm": "crc32"}))
    assert rows(identity.diff_params(old, new)) == [("gone", "1", None), ("hash_algorithm", "sha256", "crc32")]


def test_memo_and_lists(spark, tmp_path):
    path = str(tmp_path / "memo")
    record = "file_key long, stat_tag long, content_hash string, epoch long"
    assert corpus.read_memo(spark, path).count() == 0
    corpus.append_memo(_table(spark, record, (1, 1, "a", 1), (2, 1, "b", 1), (2, 1, "b", 1)), path)
    corpus.append_memo(_table(spark, record, (1, 2, "c", 2), (2, 1, "b", 2)), path)
    want = [(1, 2, "c", 2), (2, 1, "b", 1)]
    assert rows(corpus.read_memo(spark, path)) == want and spark.read.option("recursiveFileLookup", True).parquet(f"{path}/log").count() == 3
    assert corpus.compact_memo(spark, path) and not corpus.compact_memo(spark, path)
    assert rows(corpus.read_memo(spark, path)) == want
    corpus.append_memo(_table(spark, record, (1, 3, "d", 40)), path)
    assert rows(corpus.read_memo(spark, path)) == [(1, 3, "d", 40)]  # the other was not seen in 32 runs
    (tmp_path / "l1").write_text("B=${X}\n# no\n\nA\n")
    (tmp_path / "l2").write_text("A\n")
    assert corpus.env_text(spark, [str(tmp_path / "l1"), str(tmp_path / "l2")], {"X": "1"}).first()[0] == "A\nB=1"


def test_sinks_and_arrivals(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("[create n=1]|f|text\njunk\n")
    stream = lambda: actions.parse(spark.readStream.text(str(source)))
    actions.sink(stream(), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "good")).count() == 1 and rows(spark.read.json(str(tmp_path / "bad")).select("value", "error")) == [("junk", "malformed line")]
    with pytest.raises(Exception, match="malformed line"):
        actions.sink(stream(), str(tmp_path / "g2"), str(tmp_path / "b2"), str(tmp_path / "c2"), strict=True).awaitTermination(60)
    assert not (tmp_path / "g2").exists()
    q = actions.arriving(spark, str(source)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = corpus.scan(spark, [str(source)]).select("path", "size", "mtime_ns", identity.content_hash(F.col("content")).alias("hash"))
    assert rows(spark.table("arrived")) == rows(want)


STEP = "struct<action: string, `from`: string, `to`: string, items: array<string>, `destination directory`: string, inputs: array<string>, outputs: array<string>, tool: string, directory: string, file: string, cache: boolean>"


def test_steps(spark, tmp_path):
    steps = [
        {"action": "clone", "from": "${H}/a", "to": "/b"}, {"action": "move", "items": ["/x/1", "/x/*.o", "${NO}/y"], "destination directory": "/d"}, {"action": "symlink", "from": "/x/*", "to": "/d"},
        {"action": "create", "directory": "/n"}, {"action": "delete", "items": ["/b"]}, {"action": "copy", "from": "${NO}", "to": "/c"}, {"action": "start"},
        {"action": "execute", "tool": "/t", "inputs": ["/i", "${NO}"], "outputs": ["/o"]}, {"action": "Execute", "tool": "/t", "outputs": ["/o2"], "cache": False}, {"action": "list", "directory": "/n"},
    ]
    (tmp_path / "p.json").write_text(json.dumps({"main": steps, "other": [{"action": "read", "items": ["/r"]}]}))
    tasks = lineage.expand_steps(corpus.playlist(spark, str(tmp_path / "p.json"), STEP, "main"), {"H": "/home"})
    got = {(r.seq.seq, r.item): (r.action, r.cacheable, r.existence_only, [tuple(p) for p in r.paths]) for r in tasks.collect()}
    assert got == {
        (0, 0): ("clone", True, False, [("input", "/home/a"), ("output", "/b")]), (1, 0): ("move", True, False, [("exclusive", "/x/1"), ("output", "/d/1")]),
        (1, 1): ("move", True, False, [("exclusive", "/x/*.o"), ("output", "/d")]), (2, 0): ("symlink", False, False, [("input", "/x/*"), ("output", "/d")]),
        (3, 0): ("create", True, True, [("output", "/n")]), (4, 0): ("delete", True, False, [("exclusive", "/b")]), (5, 0): ("copy", False, False, []),
        (7, 0): ("execute", False, False, [("input", "/i"), ("output", "/o")]), (8, 0): ("execute", False, False, [("output", "/o2")]), (9, 0): ("list", False, False, [("input", "/n")]),
    }
    assert rows(lineage.edges(lineage.paths_of(tasks))) == [
        ("main/0/0", "main/4/0", "explicit"), ("main/1/1", "main/1/0", "implicit"), ("main/2/0", "main/1/0", "implicit"), ("main/3/0", "main/9/0", "explicit"),
    ]


def test_playlist_strings_stay(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"text": "a, ] b,}", "x": [1, 2,],}, ]')
    assert corpus.playlist(spark, str(tmp_path / "p.json"), "struct<text: string, x: array<int>>").first().step.asDict() == {"text": "a, ] b,}", "x": [1, 2]}


def test_repeated_options(spark):
    out = actions.parse(_table(spark, "value string", ("[echo a=1 b=2 a=3]|x",), ("[echo]|y",))).collect()
    assert out[0].options == {"a": "3", "b": "2"} and out[1].options == {} and not out[0].error


def test_memo_renews_epochs(spark, tmp_path):
    path, record = str(tmp_path / "memo"), "file_key long, stat_tag long, content_hash string, epoch long"
    for epoch in (1, 20, 40):
        corpus.append_memo(_table(spark, record, (1, 1, "a", epoch)), path)
    assert rows(corpus.read_memo(spark, path)) == [(1, 1, "a", 40)]
    corpus.append_memo(_table(spark, record, (1, 1, "a", 41)), path)
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{path}/log").count() == 3  # a run soon after writes nothing
    q = actions.append_memo(spark.readStream.schema(record).json(str(_json(tmp_path, {"file_key": 2, "stat_tag": 1, "content_hash": "b", "epoch": 41}))), path, str(tmp_path / "c"))
    q.awaitTermination(60)
    assert rows(corpus.read_memo(spark, path)) == [(1, 1, "a", 40), (2, 1, "b", 41)]


def test_memo_buckets_and_batches(spark, tmp_path):
    path, record = str(tmp_path / "memo"), "file_key long, stat_tag long, content_hash string, epoch long"
    run = lambda keys, tag, epoch: _table(spark, record, *((k, tag, f"h{k}-{tag}", epoch) for k in keys))
    corpus.append_memo(run(range(200), 1, 1), path, ("s", 0), buckets=8)
    corpus.append_memo(run(range(0, 200, 50), 2, 2), path, ("s", 1))
    want = rows(corpus.read_memo(spark, path))
    assert {r for r in want if r[1] == 2} == {(k, 2, f"h{k}-2", 2) for k in (0, 50, 100, 150)} and len(want) == 200
    for n in (0, 1):  # an older batch must not come back over a newer one, whatever it holds
        corpus.append_memo(run(range(200), 1, 1), path, ("s", n))
        assert rows(corpus.read_memo(spark, path)) == want
    assert corpus.compact_memo(spark, path)
    corpus.append_memo(run(range(200), 1, 1), path, ("s", 0))
    assert rows(corpus.read_memo(spark, path)) == want and not corpus.compact_memo(spark, path)
    corpus.append_memo(run([7], 3, 3), path, ("t", 0))  # another stream has numbers of its own
    one = corpus.read_memo(spark, path, keys=_table(spark, "file_key long", (7,), (7,), (10**9,)))
    assert rows(one) == [(7, 3, "h7-3", 3)]
    folders = {f.split("/bucket=")[1].split("/")[0] for f in one.inputFiles()}
    assert len(folders) <= 2 and len({f.split("/bucket=")[1].split("/")[0] for f in corpus.read_memo(spark, path).inputFiles()}) == 8
    # a run that was lost before its line, and whatever else no line names, is not read; its batch is written anew
    half = hashlib.md5(b"1 t").hexdigest()
    run([9], 9, 9).withColumns({"seq": F.lit(1 << 62), "bucket": F.lit(0)}).write.partitionBy("bucket").parquet(f"{path}/log/{half}")
    assert (9, 1, "h9-1", 1) in rows(corpus.read_memo(spark, path))
    corpus.append_memo(run([9], 4, 4), path, ("t", 1))
    assert (9, 4, "h9-4", 4) in rows(corpus.read_memo(spark, path)) and len(list((tmp_path / "memo/log" / half).glob("bucket=*"))) == 1
    corpus.append_memo(_table(spark, record), path)
    corpus.append_memo(_table(spark, record, (None, 1, None, None), (None, 2, "x", 4)), path)
    assert len(rows(corpus.read_memo(spark, path).filter("file_key is null"))) <= 1 and corpus.read_memo(spark, path).count() >= 200


def test_memo_streams_again(spark, tmp_path):
    path, record = str(tmp_path / "memo"), "file_key long, stat_tag long, content_hash string, epoch long"
    source = str(_json(tmp_path, {"file_key": 2, "stat_tag": 1, "content_hash": "b", "epoch": 1}))
    for checkpoint, tag in (("a", 1), ("a", 5), ("b", 1)):
        q = actions.append_memo(spark.readStream.schema(record).json(source), path, str(tmp_path / checkpoint))
        q.awaitTermination(60)
        assert rows(corpus.read_memo(spark, path)) == [(2, max(tag, 1), "b" if tag == 1 else "z", 1)]
        corpus.append_memo(_table(spark, record, (2, 5, "z", 1)), path)
        commits = sorted((tmp_path / "a/commits").glob("0*"))
        for f in [*commits, *(tmp_path / "a/commits").glob(".0*")]:  # as if it had been lost before it was noted
            f.unlink()


def _json(tmp_path, row):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(row))
    return tmp_path / "in"


def test_search_at_the_ends_of_texts(spark):
    files = _table(spark, "path string, text string", ("f", "one\ntwo here\n"), ("g", "a\x00two"))
    hit = lambda p, **k: [(r.path, r.line) for r in search.grep(files, p, **k).collect()]
    assert hit(r"\Atwo") == [("f", 2)] == hit("^two") and hit(r"one\z") == [("f", 1)] and hit(r"(?<!x)two") == [("f", 2)]
    assert sorted(hit("two", binary=True)) == [("f", 2), ("g", 1)]


def test_conflicts_with_own_declarations(spark):
    tp = _paths(spark, (1, "exclusive", "/d"), (1, "input", "/d/e"), (1, "output", "/d/f"), (2, "output", "/p"), (3, "exclusive", "/p"), (2, "output", "/p/q"), (4, "output", "/p/r"))
    assert rows(lineage.conflicts(tp)) == sorted([("consumer under exclusive", "/d/e", 1), ("producer under exclusive", "/d/f", 1), ("producer under exclusive", "/p/r", 1)], key=str)


def _brute_waves(n, edges):
    before = {i: {a for a, b in edges if b == i and a != i} for i in range(n)}
    wave, k = {}, 0
    while ready := [i for i in before if i not in wave and all(a in wave for a in before[i])]:
        wave |= dict.fromkeys(ready, k)
        k += 1
    return wave, {i: sum(a not in wave for a in before[i]) for i in before if i not in wave}


@pytest.mark.parametrize("seed", range(3))
def test_waves_and_dirtiness_of_random_graphs(spark, seed):
    """Chains, diamonds, cycles and what hangs on them, against the definition."""
    import random

    r = random.Random(seed)
    n = 70
    e = [(i, i + 1) for i in range(20)] + [(r.randrange(n), r.randrange(n)) for _ in range(25)] + [(30, 31), (30, 32), (31, 33), (32, 33), (33, 34), (40, 41), (41, 40), (41, 42), (42, 43)]
    tasks, edge = _table(spark, "task_id long", *((i,) for i in range(n))), _table(spark, "src long, dst long", *e)
    wave, stuck = _brute_waves(n, e)
    got = lineage.waves(tasks, edge)
    assert {x.task_id: x.wave for x in got.collect()} == {i: wave.get(i) for i in range(n)} and got.count() == n
    assert {x.task_id: x.waiting for x in lineage.cycle_report(edge, got).collect()} == stuck
    changed, same = [3, 30, 40], {5, 31}
    for cut in (set(), same):
        want, front = dict.fromkeys(changed, 0), changed
        while front:
            front = [b for a, b in e if a in front and a not in cut and a != b and b not in want and not want.update({b: want[a] + 1})]
        out = lineage.dirty(edge, _table(spark, "task_id long", *((i,) for i in changed)), _table(spark, "task_id long", *((i,) for i in cut or {n})))
        assert {x.task_id: x.distance for x in out.collect()} == want


def test_path_matches(spark):
    paths, globs_ = ["/a/b/c.txt", "/a/x.c", "/b/y.c", "/b/c/d.h", "/a/b/c/e"], ["/a/**", "/a/*/c.txt", "**/*.c", "/b/*.c", "*/*/*", "/**/[cd].*", "/a/b/c.txt/*"]
    got = lineage.path_matches(_table(spark, "path string", *((p,) for p in paths)), _table(spark, "glob string", *((g,) for g in globs_)))
    import re

    assert set(rows(got)) == {(p, g) for p in paths for g in globs_ if re.fullmatch(globs.to_regex(g), p)}


def test_snapshot_of_one_object(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"fingerprint_params": {"hash_algorithm": "crc32c", "glob_patterns": ["*.c"]}, "files": [{"path": "a", "hash": "1", "size": 2}, {"path": "b", "hash": "2", "size": 3}]}, indent=1))
    assert [(r.path, r.size) for r in corpus.read_snapshot(spark, str(tmp_path / "s.json"), single=True).collect()] == [("a", 2), ("b", 3)]
    assert rows(corpus.read_snapshot_params(spark, str(tmp_path / "s.json"), single=True)) == [("glob_patterns", '["*.c"]'), ("hash_algorithm", "crc32c")]


def test_selections(spark):
    assert search.selections("/r", []) == [{"root": "/r", "globs": ["**/*"], "excludes": []}]
    with pytest.raises(ValueError):
        search.selections(None, ["*.c"])
    files = _table(spark, "path string, text string", ("/r/a.c", "hit\nhit"), ("/r/b.h", "hit"), ("/s/c.c", "hit"))
    hits, summary = search.search_files(files, search.selections("/r", ["*.c", "/s/*"]), "hit", 2)
    assert [(r.path, r.line) for r in hits.orderBy("path", "line").collect()] == [("/r/a.c", 1), ("/r/a.c", 2)] and tuple(summary.first()) == (1, 2, 0, True)


def test_changes_of_arrivals(spark):
    arrived, old = _table(spark, "path string, hash string", ("a", "1"), ("b", "2"), ("c", "3"), ("d", None)), _table(spark, "path string, hash string", ("a", "1"), ("b", "x"), ("d", None))
    assert rows(actions.changes(arrived, old).select("path", "change")) == [("a", "same"), ("b", "modified"), ("c", "added"), ("d", "modified")]


def test_times_and_commands(spark):
    df = _table(spark, "ns long, args array<string>", (1_700_000_000_123_456_789, ["a", "-b"]))
    assert tuple(df.select(P.local_ns(F.col("ns")), P.command(F.col("args")), P.run_stamp(F.timestamp_micros(F.lit(1_700_000_000_123_456)))).first()) == ("2023-11-14 22:13:20.123456789", "a -b", "2023-11-14T22:13:20.123456")
