"""What went wrong on larger tables than those of the tests beside it."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import factored, incremental, lineage
from corpusloom.plans import graph_queries, queries
from corpusloom.streaming import actions


def test_times_far_from_1970_keep_their_seconds(spark):
    ns = [6_703_000 * 1_000_007_000_000, 4_639_000 * 1_000_007_000_000, 1_999_999_999, -1, -1_000_000_000, 0, None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n long").select(P.iso_utc(F.col("n"))).collect()]
    assert got == ["2182-05-30T13:28:41Z", "2117-01-02T12:07:53Z", "1970-01-01T00:00:01Z", "1969-12-31T23:59:59Z", "1969-12-31T23:59:59Z", "1970-01-01T00:00:00Z", None]
    late = spark.createDataFrame([(Decimal(54_000_000 * 1_000_007_000_000),)], "n decimal(38,0)").select(P.iso_utc(F.col("n"))).first()[0]
    assert late == "3681-03-15T09:00:00Z"


def test_jumps_end_with_the_last_distance(spark, monkeypatch):
    """Links of which many lead into cycles: no rounds are made for these."""
    n, made = 3000, []
    target = [i // 7 if i % 40 not in (8, 9) else i + 1 if i % 40 == 8 else i - 1 for i in range(n)]
    links = spark.createDataFrame([(i, target[i], True) for i in range(1, n)], "path long, target long, exists boolean")
    written = lineage.written
    monkeypatch.setattr(lineage, "written", lambda df: made.append(1) or written(df))
    got = {r.path: (r.target, r.hops) for r in lineage.resolve_links(links).collect()}
    assert len(made) <= 7  # 2 and a round for each power of 2 up to the deepest, 8 links, and one that finds no more
    for i in range(1, n):
        at, hops, seen = i, 0, set()
        while 1 <= at < n and at not in seen:
            seen.add(at)
            at, hops = target[at], hops + 1
        assert got[i] == ((target[i], None) if 1 <= at < n else (at, hops))


def some_edges(n):
    r = random.Random(7)
    e = [(b % m, b) for b in range(3, n) for m in (r.randrange(2, 40), 61)]  # much hangs at few
    e += [(i, i + 1) for i in range(n, n + 200)] + [(n + 100, n + 300), (n + 300, n + 301), (n + 301, n + 300), (n + 301, n + 302), (n + 302, n + 303)]
    return [(a, b) for a, b in e if a != b] + [(n + 400, n + 401), (5, n + 401), (n + 401, n + 402)]


@pytest.mark.parametrize("text", [False, True])
def test_waves_and_distances_with_ends_set_aside(spark, text, monkeypatch):
    monkeypatch.setattr(lineage, "TRIM", 0.01)
    n = 400
    e, tasks = some_edges(n), [*range(n + 304), n + 401, n + 402]  # n + 400 is no task
    name = (lambda i: f"t{i:04}") if text else int
    kind = "string" if text else "long"
    edge = spark.createDataFrame([(name(a), name(b)) for a, b in e], f"src {kind}, dst {kind}")
    table = lambda ids: spark.createDataFrame([(name(i),) for i in ids], f"task_id {kind}")
    known, wave = set(tasks), {}
    while more := {t for t in known - set(wave) if all(a in wave for a, b in e if b == t)}:
        wave |= dict.fromkeys(more, len(set(wave.values())))
    for part in (10, 150):
        got = {r.task_id: r.wave for r in lineage.waves(table(tasks), edge, part=part, large=100).collect()}
        assert got == {name(t): wave.get(t) for t in tasks}
    changed = [7, n + 50, n + 402, n + 900]
    want, front = dict.fromkeys(changed, 0), changed
    while front:
        front = [b for a in front for x, b in e if x == a and b not in want and not want.update({b: want[a] + 1})]
    rows = lineage.dirty(edge, table(changed), part=10, large=100).collect()
    assert {r.task_id: r.distance for r in rows} == {name(t): k for t, k in want.items()} and len(rows) == len(want)


def test_chains_are_shortened_inside_tasks(spark):
    n = 5000
    single = spark.createDataFrame([(i, i - 3, 1) for i in range(3, n)] + [(n + 1, n + 2, 1), (n + 2, n + 1, 1), (n + 3, n + 2, 1)], "p long, t long, h long")
    assert lineage._shortened(single).filter(f"p < {n} and t > 2").count() <= n
    got = {r.p: (r.t, r.h, r.done) for r in lineage._followed(single).collect()}
    assert {p: x for p, x in got.items() if p < n} == {i: (i % 3, i // 3, True) for i in range(3, n)}
    assert {p for p, x in got.items() if not x[2]} == {n + 1, n + 2, n + 3}


def test_many_globs_of_a_directory_meet_few_paths(spark, monkeypatch):
    """Globs that name one file each are not held against all files of their directory."""
    n = 300
    paths = [f"/a/b/doc_{i}.txt" for i in range(n)] + ["/a/b", "/a/bc", "/a/b+/x.c", "/a/b/(c)"]
    globs = [f"/A/b/doc_{i}.t[x]t" for i in range(n)] + ["/a/b/**", "/a/b*", "/a/b/doc_1*", "/a/b+/*.c", "/a/b/\\(c*", "/a/\\b/doc_29*", "/a/b/do@(c|d)_7*", "/a/{b,c}/doc_2?.txt"]
    table = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    by_trie, by_joins = ({tuple(r) for r in lineage.path_matches(table(paths, "path"), table(globs, "glob"), most=most).collect()} for most in (10_000, 0))
    assert by_trie == by_joins and {(f"/a/b/doc_{i}.txt", f"/A/b/doc_{i}.t[x]t") for i in range(n)} <= by_joins and ("/a/b", "/a/b/**") in by_joins
    compiled = lineage.compiled
    monkeypatch.setattr(lineage, "compiled", lambda g, c: compiled(g, c).withColumn("regex", F.lit("(?s).*")))
    assert lineage.path_matches(table(paths, "path"), table(globs[:n], "glob"), most=0).count() == n


def test_forecast_numbers_and_trims_its_edges_once(spark, monkeypatch):
    tasks = spark.createDataFrame([(i, f"s{i}", "in", "out", False) for i in range(9)], "task_id long, signature string, world_in string, world_out string, missing_output boolean")
    edge, made, numbered = spark.createDataFrame([(i, i + 1) for i in range(7)], "src long, dst long"), [], lineage._numbered
    monkeypatch.setattr(lineage, "_numbered", lambda *a: made.append(1) or numbered(*a))
    got = {r.task_id: (r.wave, r.hit, r.may_change) for r in incremental.forecast(tasks, tasks.filter("task_id <> 4").select("signature", "world_in", "world_out"), edge).collect()}
    assert len(made) == 1 and got == {i: (i if i < 8 else 0, i != 4, 4 < i < 8) for i in range(9)}


def test_edges_are_put_together_without_sorting_reasons(spark):
    rows = [(1, 1, "output", "/A"), (2, 2, "input", "/a"), (3, 3, "input", "/a/b"), (4, 4, "output", "/a/c"), (5, 5, "input", "/?"), (6, 6, "mutating", "/a")]
    found = lineage.edges(spark.createDataFrame(rows, "task_id long, seq long, role string, path string"))
    assert sorted(map(tuple, found.collect())) == [(1, 2, "explicit"), (1, 3, "ancestor"), (1, 4, "implicit"), (1, 5, "glob"), (1, 6, "maker"), (2, 6, "reader"), (5, 6, "reader")]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_what_is_a_glob(spark):
    names = ["/a", "/a*", "/?", "/[ab]", "/[ab", "/\\[a", "/x{1,2}", "/@(a)", "/+(a", "/a@b", "/a!(b)", "/[!]]", "/[]", "/*[", "", "/(a)", None]
    bare = F.regexp_replace(F.regexp_replace("n", r"\\.", ""), r"\[[!^]?\]?[^\]]*\]", "")
    whole = F.col("n").rlike(r"[*?\[{]|[@+!]\(") & ~bare.contains("[")
    table = spark.createDataFrame([(n,) for n in names], "n string")
    got = table.select(P.is_glob(F.col("n")).alias("g"), whole.alias("whole")).collect()
    assert [r.g for r in got] == [r.whole for r in got] and {r.g for r in got} == {True, False, None}
    assert "RLIKE" not in table.select(P.is_glob(F.col("n")))._jdf.queryExecution().toString().upper()


def test_tasks_without_customers_are_those_of_the_filter(spark):
    d = "/root/testdata/sf0.001"
    want = queries.task_paths(spark, d).filter("path not like '/customer/%'")
    assert sorted(map(tuple, queries.task_paths(spark, d, customers=False).collect())) == sorted(map(tuple, want.collect()))


def test_static_tasks_need_no_pairs(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    tasks = graph_queries._tasks(spark, d)
    want = {r.task_id for r in lineage.static_tasks(tasks, lineage.edges(lineage.paths_of(tasks))).collect()}
    rows = [(1, 1, "output", "/a"), (1, 1, "input", "/a"), (2, 2, "output", "/a"), (2, 2, "input", "/b"), (3, 3, "output", "/*"), (3, 3, "input", "/c"), (4, 4, "mutating", "/d"), (4, 4, "output", "/e"), (5, 5, "input", "/d"), (6, 6, "mutating", "/z")]
    odd = spark.createDataFrame(rows, "task_id long, seq long, role string, path string")
    plain = {r.task_id for r in lineage.static_tasks(odd, lineage.edges(odd)).collect()}
    assert {r.task_id for r in factored.static_tasks(odd, factored.factored(factored.relations(odd))).collect()} == plain
    monkeypatch.setattr(lineage, "edges", None)
    assert {r.task_id for r in graph_queries.static_tasks(spark, d).collect()} == want


def test_closing_a_batch_is_no_square():
    class Counted(dict):
        looks = 0

        def __iter__(self):
            self.looks += 1
            return super().__iter__()

    waiting = Counted((i, None if i % 3 else f"t{i}") for i in range(2000, 0, -2))
    assert actions._drained(waiting, 0, True) == (2001, [(i, f"t{i}") for i in range(2, 2001, 2) if i % 3 == 0]) and waiting.looks == 1 and not waiting
    waiting = {0: "a", 1: None, 3: "b"}
    assert actions._drained(waiting, 0, False) == (2, [(0, "a")]) and waiting == {3: "b"}
