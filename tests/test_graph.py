"""Levels and distances by parts against the definition, however nodes are dealt out."""

import random
import time

import pytest

from corpusloom.operators import graph, lineage


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def brute(n, edges):
    before = {i: [] for i in range(n)}
    for a, b in edges:
        if a != b:
            before[b].append(a)
    after = {i: [b for a, b in set(edges) if a == i != b] for i in range(n)} if n < 200 else None
    wave, k = {}, 0
    left = {i: len(set(before[i])) for i in range(n)}
    ready = [i for i in left if not left[i]]
    out = {}
    for a, b in set(edges):
        if a != b:
            out.setdefault(a, []).append(b)
    while ready:
        wave |= dict.fromkeys(ready, k)
        k += 1
        following = []
        for i in ready:
            for b in out.get(i, []):
                left[b] -= 1
                if not left[b]:
                    following.append(b)
        ready = following
    return wave, after


def some_graph(seed, n):
    r = random.Random(seed)
    e = [(i, i + 1) for i in range(n // 3)]  # a chain
    e += [(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(n)) if a < b]
    e += [(a + r.randrange(1, 4), a) for a in r.sample(range(n // 2, n - 4), 3)]  # cycles, and what is behind them
    return e


@pytest.mark.parametrize("seed, part, large", [(0, 10**6, 10**6), (2, 20, 0)])
def test_waves_and_dirty_by_parts(spark, seed, part, large):
    n = 90
    e = some_graph(seed, n)
    wave, after = brute(n, e)
    tasks, edge = table(spark, "task_id string", [(str(i),) for i in range(n)]), table(spark, "src string, dst string", [(str(a), str(b)) for a, b in e])
    got = {r.task_id: r.wave for r in lineage.waves(tasks, edge, part=part, large=large).collect()}
    assert got == {str(i): wave.get(i) for i in range(n)}
    changed, cut = [2, n // 2, n - 1], {7, n // 3}
    want, front = dict.fromkeys(changed, 0), changed
    while front:
        front = [b for a in front if a not in cut for b in after[a] if b not in want and not want.update({b: want[a] + 1})]
    same = table(spark, "task_id string", [(str(i),) for i in cut])
    got = {int(r.task_id): r.distance for r in lineage.dirty(edge, table(spark, "task_id string", [(str(i),) for i in changed]), same, part=part, large=large).collect()}
    assert got == want


def test_weights_and_tasks_that_are_none(spark):
    edge = table(spark, "src string, dst string, w int", [("a", "p", 0), ("b", "p", 0), ("p", "c", 1), ("c", "q", 0), ("q", "d", 1), ("x", "e", 1)])
    tasks = table(spark, "task_id string", [(t,) for t in "abcdepq"])
    assert {r.task_id: r.wave for r in lineage.waves(tasks, edge).collect()} == {"a": 0, "b": 0, "p": 0, "c": 1, "q": 1, "d": 2, "e": None}
    assert {r.task_id: r.distance for r in lineage.dirty(edge, table(spark, "task_id string", [("a",), ("z",)])).collect()} == {"a": 0, "p": 0, "c": 1, "q": 1, "d": 2, "z": 0}
    none = table(spark, "src string, dst string", [])
    assert {r.wave for r in lineage.waves(tasks, none).collect()} == {0} and lineage.waves(tasks.limit(0), none).count() == 0


def test_components(spark, monkeypatch):
    r = random.Random(4)
    e = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {i: find(i) for a, b in e if a != b for i in (a, b)}
    for chunk in (graph.CHUNK, 0):
        monkeypatch.setattr(graph, "CHUNK", chunk)
        got = graph.components(table(spark, "a long, b long", e)).collect()
        assert {r.id: r.component for r in got} == want and len(got) == len(want)


def test_ladder(spark):
    """2000 levels of 12 tasks, each waiting for three of the level before."""
    levels, width = 2000, 12
    e = [(k * width + i, (k + 1) * width + (i + j) % width) for k in range(levels - 1) for i in range(width) for j in range(3)]
    tasks, edge = spark.range(levels * width).withColumnRenamed("id", "task_id"), table(spark, "src long, dst long", e)
    for part in (graph.PART, 10_000):
        began = time.time()
        got = {r.task_id: r.wave for r in lineage.waves(tasks, edge, part=part).collect()}
        assert all(w == t // width for t, w in got.items()) and len(got) == levels * width
        assert time.time() - began < 60


def declarations(seed, mixed):
    """Tasks that make, use and edit paths, directories and globs of a few names, each at its own place."""
    r = random.Random(seed)
    names = ["/a", "/a/b", "/a/b/c.x", "/a/b/d.x", "/a/e.y", "/f/g.x", "/F/g.X", "/h", "/h/i/j.y"]
    globs = ["/a/*.y", "/a/**/*.x", "/*/g.x", "/h/**", "/a/b/[cd].x"]
    rows = []
    for t in range(36):
        editor = r.random() < 0.25
        for _ in range(r.choice([1, 1, 2, 3])):
            role = "mutating" if editor and (not mixed or r.random() < 0.6) else r.choice(["output", "input", "input", "exclusive"])
            rows.append((t, t // 2 * 2 if mixed is None else t, role, r.choice(names if role == "output" and r.random() < 0.8 else names + globs)))
    return rows


@pytest.mark.parametrize("seed, mixed", [(2, True), (3, None)])
def test_factored_edges(spark, seed, mixed):
    from corpusloom.operators import factored

    paths = table(spark, "task_id long, seq long, role string, path string", declarations(seed, mixed))
    tasks = paths.select("task_id").distinct()
    plain = {(r.src, r.dst) for r in lineage.edges(paths).collect()}
    rel = factored.relations(paths)
    assert {(int(r.src[2:]), int(r.dst[2:])) for r in factored.pairs(rel).collect()} == plain
    edge = [(r.src, r.dst, r.w) for r in factored.factored(rel).collect()]
    out = {}
    for a, b, w in edge:
        out.setdefault(a, []).append((b, w))

    def reached(start):
        """Tasks one step of weight 1 away, over any nodes of paths."""
        todo, seen, found = [start], set(), set()
        while todo:
            for b, w in out.get(todo.pop(), []):
                if w:
                    found.add(int(b[2:]))
                elif b not in seen:
                    seen.add(b)
                    todo.append(b)
        return found

    assert {(t, b) for t in range(36) for b in reached(f"t:{t}")} == plain
    edges = table(spark, "src long, dst long", sorted(plain))
    want = {r.task_id: r.wave for r in lineage.waves(tasks, edges).collect()}
    wave = factored.waves(tasks, rel)
    assert {r.task_id: r.wave for r in wave.collect()} == want
    assert {tuple(r) for r in factored.cycle_report(rel, wave).collect()} == {tuple(r) for r in lineage.cycle_report(edges, wave).collect()}
    some, same = tasks.filter("task_id % 9 = 4"), tasks.filter("task_id % 5 = 1")
    assert {(int(r.task_id), r.distance) for r in factored.dirty(rel, some, same).collect()} == {tuple(r) for r in lineage.dirty(edges, some, same).collect()}


def test_factored_edges_are_linear(spark):
    from corpusloom.operators import factored

    n = 300
    rows = [(t, t, "output", f"/o/{t}.bin" if t % 2 else "/o/*.bin") for t in range(n)] + [(n + t, n + t, "input", "/o/*.bin") for t in range(n)]
    rows += [(2 * n + t, 2 * n + t, "mutating", "/o/*.bin") for t in range(n)]
    rel = factored.relations(table(spark, "task_id long, seq long, role string, path string", rows))
    assert factored.factored(rel).count() < 12 * n
    assert factored.pairs(rel).count() > n * n


def test_only_links_that_are_met_are_followed(spark, monkeypatch):
    seen, jumps = [], lineage._jumps
    monkeypatch.setattr(lineage, "_jumps", lambda t: seen.append(t.count()) or jumps(t))
    to = {k: k // 7 for k in range(1, 400)} | {500: 501, 501: 500, 502: 500, 503: 502, 600: 600, 700: 701, 702: 700}
    got = lineage.resolve_links(spark.createDataFrame([(p, t, t != 701) for p, t in to.items()], "path long, target long, exists boolean"))

    def led(p):
        t, hops = to[p], 1
        while t in to and hops < 50:
            t, hops = to[t], hops + 1
        return (p, to[p], None, "cycle") if hops == 50 else (p, t, hops, "broken" if t == 701 else "resolved")

    assert sorted(map(tuple, got.collect())) == [led(p) for p in sorted(to)]
    assert seen == [len(set(to) & set(to.values()))]
