"""Declarations told by numbers, worked through by components, and pairs whose tasks stay small."""

import random

import pytest

from corpusloom.functions import paths as P
from corpusloom.operators import factored, graph, lineage
from pyspark.sql import functions as F

from test_graph import declarations, table


def test_components_that_lie_near(spark, monkeypatch):
    r = random.Random(7)
    e = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    want = {x.id: x.component for x in graph.components(table(spark, "a long, b long", e).filter("a <> b")).collect()}
    rows = table(spark, "a long, b long, at long", [(a, b, a) for a, b in e if a != b])
    for chunk in (graph.CHUNK, 40):
        monkeypatch.setattr(graph, "CHUNK", chunk)
        got = graph.near_components(rows).collect()
        assert {x.id: x.component for x in got} == want and len(got) == len(want)


def test_waves_and_distances_by_components(spark):
    """Groups of tasks that have nothing to do with one another, one of them too large for a part, and one in a circle."""
    rows = [(100 * g + t, 100 * g + t, role, f"/{g}/{t + i}") for g in range(6) for t in range(60 if g == 2 else 5) for role, i in (("input", 0), ("output", 1))]
    rows += [(504, 504, "output", "/5/0"), (700, 700, "output", "/c/a"), (700, 700, "input", "/c/a"), (800, 800, "input", "/nobody")]
    paths = table(spark, "task_id long, seq long, role string, path string", rows)
    tasks = paths.select("task_id").distinct()
    edges = lineage.edges(paths)
    want = {r.task_id: r.wave for r in lineage.waves(tasks, edges).collect()}
    assert want[504] is None and want[404] == 4 and want[259] == 59 and want[700] == want[800] == 0
    rel = factored.relations(paths)
    assert {r.task_id: r.wave for r in factored.waves(tasks, rel, part=40).collect()} == want
    some = tasks.filter("task_id in (1, 210, 500, 700, 800)")
    assert {(int(r.task_id), r.distance) for r in factored.dirty(rel, some, part=40).collect()} == {tuple(r) for r in lineage.dirty(edges, some).collect()}
    # numbers that tasks have already
    named = factored.numbered(tasks)
    rel = factored.relations(paths.join(named, "task_id"))
    assert {r.task_id: r.wave for r in factored.waves(named, rel, part=40).collect()} == want


@pytest.mark.parametrize("seed, mixed", [(2, True), (3, None), (4, False)])
def test_reasons_of_pairs(spark, seed, mixed):
    paths = table(spark, "task_id long, seq long, role string, path string", declarations(seed, mixed))
    want = {tuple(r) for r in lineage.edges(paths).collect()}
    rel = factored.relations(paths)
    for meeting in (factored.MEETING, 40):  # by one part, and by more than the session's usual number
        found = factored.reasons(rel, meeting)
        got = found.collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert found.rdd.getNumPartitions() > 4


def test_ancestors_by_text(spark):
    texts = ["/a/b/c", "/a", "/", "", "a/b", "/a//b", "/a/b/", "//a", "/a\nb/c", "/a/b\n", None]
    t = table(spark, "path string", [(x,) for x in texts])
    got = t.select("path", P.above(F.col("path")).alias("x"), F.try_element_at(P.ancestors(F.col("path")), F.lit(-1)).alias("y")).collect()
    assert all(r.x == r.y for r in got if r.path is not None)
    tops = table(spark, "top string", [("/a",), ("/a/b",), ("/a\nb",)])
    found = {tuple(r) for r in lineage.at_or_below(t.filter("path is not null"), tops).collect()}
    assert found == {("/a/b/c", "/a"), ("/a/b/c", "/a/b"), ("/a", "/a"), ("a/b", "/a"), ("a/b", "/a/b"), ("/a//b", "/a"), ("/a//b", "/a/b"), ("/a/b/", "/a"), ("/a/b/", "/a/b"), ("//a", "/a"), ("/a\nb/c", "/a\nb"), ("/a/b\n", "/a")}


def test_how_globs_end(spark):
    texts = ["/x/a.h", "/x/b.h\n", "/x/a.hh", "/x/c.d", "/x/y/a.h", "/x/e]", "/x/f!g"]
    globs = ["/x/*.h", "/x/*h", "/x/[ab].{h,d}", "/x/*]", "/x/?!g", "/x/**", "/x/@(a|c).*", "*.h", "/**/a.h"]
    by_trie, by_joins = ({tuple(r) for r in lineage.path_matches(table(spark, "path string", [(x,) for x in texts]), table(spark, "glob string", [(g,) for g in globs]), most=m).collect()} for m in (10_000, 0))
    assert by_joins >= by_trie and ("/x/a.h", "/x/*.h") in by_joins and ("/x/c.d", "/x/[ab].{h,d}") not in by_joins
    import re

    from corpusloom.plans import globs as G

    assert by_joins == {(x, g) for x in texts for g in globs if re.search(G.to_regex(g), x)}


def test_variables_only_where_there_are_some(spark):
    texts = ["plain", "${HOME}/y", "${NO}/z", "a$b", "${", "$(HOME)", None]
    t = table(spark, "t string", [(x,) for x in texts])
    got = t.select(P.expand(F.col("t"), {"HOME": "/h"}).alias("x"), P.expand(F.col("t"), {"HOME": "/h"}, strict=False).alias("y")).collect()
    assert [r.x for r in got] == ["plain", "/h/y", None, "a$b", None, "$(HOME)", None] and [r.y for r in got] == ["plain", "/h/y", "/z", "a$b", "${", "/h", None]
