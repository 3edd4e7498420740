"""Snapshots, playlists, searches and edits on inputs that went wrong, or grow."""

import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lineage, search
from corpusloom.plans import globs as G
from corpusloom.sources import corpus

FILES = "path string, hash string, size long, inode long, mtime_ns long, mode int"


def test_snapshot_rows_come_back_as_they_were(spark, tmp_path):
    rows = [("/a/b ", "h", 1, 2, 3, 4), (" /lead", "", None, 2, 3, 4), ('/q"x', "n", 1, None, 3, 4), ('"start', "n", 1, None, 3, 4), ("/t\tb", None, 1, 2, 3, 4), ("/s\\n", "x", 1, 2, 3, 4), ("/c", "\\", 1, 2, 3, 4)]
    corpus.write_snapshot(spark.createDataFrame(rows, FILES), str(tmp_path / "s.tsv"))
    assert sorted((tuple(r) for r in corpus.read_snapshot(spark, str(tmp_path / "s.tsv")).collect()), key=str) == sorted(rows, key=str)
    for end in "\n\r":
        with pytest.raises(Exception, match="a line end in a path"):
            corpus.write_snapshot(spark.createDataFrame([(f"/a{end}b", "h", 1, 2, 3, 4)], FILES), str(tmp_path / f"{ord(end)}.tsv"))


def test_comments_of_playlists(spark, tmp_path):
    text = '[ // a 5" disk\n {"text": "a, ]b,}", "action": "x\\\\"}, /* ,] " */ {"text": "//no", "action": "/*,]*/"} , // last, ]\n /* and */ ]'
    (tmp_path / "p.json").write_text(text)
    rows = corpus.playlist(spark, str(tmp_path / "p.json"), "struct<action: string, text: string>").select("seq", "step.*").orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [(0, "x\\", "a, ]b,}"), (1, "/*,]*/", "//no")]


@pytest.mark.parametrize("pattern", ["a[^c]*+$", "b++$", "(?>b+)$", "a.{1,9}+$"])
def test_possessive_patterns(spark, pattern):
    files = spark.createDataFrame([("/x", "abb\nddc")], "path string, text string")
    assert [r.line for r in search.grep(files, pattern).collect()] == ([1] if pattern != "a.{1,9}+$" else [1])


def test_block_edits_are_linear(spark):
    took = {}
    for n in (500, 500, 8000):
        text = "\n".join(f"   if y{i}:" for i in range(n)) + "\n\tif x:\n\n\t  y\nend"
        began = time.time()
        row = search.apply_edits(spark.createDataFrame([("/y", text)], "path string, text string"), [{"old": "if x:\n\n  y", "new": "if z:\n    w", "limit": 1}]).first()
        took[n] = time.time() - began
        assert row.error is None and row.text.endswith(f"y{n - 1}:\n\tif z:\n\t    wend") and row.text.count("\n") == n + 1
    assert took[8000] < 5 + 4 * took[500]


def test_block_places(spark):
    def places(text, old):
        return spark.createDataFrame([(text.split("\n"),)], "e array<string>").select(search.block_places(F.col("e"), old)).first()[0]

    assert places("a\n  b\n c\n   d\n  e", "x") == []
    assert places("  b\n c\n   b\n  c", " b\nc") == [0, 2]
    assert places("b\n\nb\n \nb", "b\n\nb") == [0] and places("\t\n", "\n") == [0]
    # against all windows
    text = " if\n  a\n\n  a\n if\n   a\n  if\n   a\n\n   a\n"
    each = text.split("\n")
    for old in ("if\n a", "if\n a\n\n a", "a\n\na", " a\nif", "if"):
        wanted = search._block(old)
        brute = [i for i in range(len(each) - 1 - len(wanted) + 1) if search._block("\n".join(each[i : i + len(wanted)])) == wanted]
        assert places(text, old) == brute, old


def test_searches_stop_at_their_cap(spark, monkeypatch):
    rows = [(f"/f/{i:03}", "\n".join("hit" if (i * j) % 3 == 1 else "no" for j in range(4))) for i in range(60)]
    files = spark.createDataFrame(rows, "path string, text string")
    want = [(p, k + 1) for p, t in rows for k, line in enumerate(t.split("\n")) if line == "hit"]
    chosen = files.filter("path <> '/f/001'").select("path")
    some = [w for w in want if w[0] != "/f/001"]
    looked = []
    grep = search.grep
    monkeypatch.setattr(search, "grep", lambda part, *a, **o: looked.append(part.count()) or grep(part, *a, **o))
    for most, first in ((1, 1), (7, 2), (1000, 3), (0, 5)):
        looked.clear()
        got = search.first_matches(files, chosen, "hit", most, first)
        assert [tuple(r) for r in got.orderBy("path", "line").collect()] == some[:most]
        assert sum(looked) <= (59 if most == 1000 else 20)
    hits, summary = search.search_files(files, [{"root": "/f"}], "hit", 5, context=1)
    kept = [(r.path, r.line) for r in hits.filter("is_match").orderBy("path", "line").collect()]
    assert kept == want[:5] and tuple(summary.first()) == (len({p for p, _ in kept}), 5, 0, True)
    assert search.first_matches(files, chosen.limit(0), "hit", 5).count() == 0


def test_overlaps_of_literal_ends(spark):
    globs_ = ["/a/*/x.c", "/a/*/y.c", "/a/b/*.c", "/a/**", "/**/x.c", "/a/{b,c}/x.c", "/a/*/[x]", "/a/b/x.@(c|d)"]
    table = spark.createDataFrame([(g,) for g in globs_], "x string")
    got = {tuple(r) for r in lineage.glob_overlaps(table, table.withColumnRenamed("x", "y")).collect()}
    assert got == {(a, b) for a in globs_ for b in globs_ if G.overlap(a, b)}


def test_matches_by_trie_and_by_joins(spark):
    paths = spark.createDataFrame([(p,) for p in ("/a/b/c.txt", "/a/x.c", "/b/y.c", "/b/c/d.h", "/a/b/c/e", "n.c", "b", None)], "path string")
    table = spark.createDataFrame([(g,) for g in ("/a/**", "/a/*/c.txt", "**/*.c", "/b/*.c", "*/*/*", "/**/[cd].*", "/a/b/c.txt/*", "*.C", "**", "?", None)], "glob string")
    by_trie, by_joins = ({tuple(r) for r in lineage.path_matches(paths, table, most=most).collect()} for most in (100, 0))
    assert by_trie == by_joins and len(by_trie) > 15
