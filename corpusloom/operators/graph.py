"""Levels and distances in large directed graphs, by work inside tasks and few exchanges.

Nodes are dealt into parts of a bounded number of edges. Graphs that fall apart into small components are dealt by component, and
need no exchange at all. A component that is too large is cut into bands of levels: a node's level is estimated by its distance from
the start along one edge into each node (jumps that double), raised a few times by the levels of all edges; bands are ranges of levels with about as many nodes each; a level
with more than that is dealt out by hash. A task works through all levels of its part that it can; only what crosses to another
part is exchanged, and only parts that something came to are looked at again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.corpus import written

#: Edges of a part, about; and edges that one task contracts at once.
PART, CHUNK = 1 << 20, 1 << 20
#: How often an estimated level is raised to one more than the levels before it.
REFINED = 3
#: Parts that one level, or one component, is cut into at most.
MOST_CUTS = 4096
STATE = "kind int, part int, id long, n long, value long"


def number(names: DataFrame) -> DataFrame:
    """(id long, name): the distinct names, numbered; written, so that the numbers stay."""
    return written(names.select("name").filter("name is not null").distinct().withColumn("id", F.monotonically_increasing_id()))


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges and the least node of the component that these edges give each."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
        if np.array_equal(before, root):
            return nodes, nodes[root]


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b), a > b: what each task makes of its edges alone: every node tied to the least one that it is linked to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit() -> pa.RecordBatch:
            a, b = _contract(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += batch.num_rows
            if n >= CHUNK:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each node of edges (a, b: long), direction aside: the least node that can be reached.

    Tasks contract their own edges first. What is left is shuffled by its larger ends, and tied to least neighbours in alternate
    directions until nothing changes; few enough edges are contracted by one task instead.
    """
    now = written(_stars(edges.filter("a <> b")))
    seen = None
    while True:
        n = now.count()
        if n <= CHUNK:
            now = written(_stars(now.coalesce(1)))
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        tied = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = tied.groupBy("a").agg(F.min("b").alias("m"))
        again = tied.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b")
        now = written(_stars(again.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()).distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def near_components(edges: DataFrame) -> DataFrame:
    """components() of edges (a, b, at), where what is tied mostly lies near each other by at: tasks contract ranges of it, and only
    nodes that several ranges have tie what these found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit() -> pa.RecordBatch:
            nodes, root = _contract(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["id", "root"])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += batch.num_rows
            if n >= CHUNK:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()

    near = written(edges.repartitionByRange("at").select("a", "b").mapInArrow(run, "id long, root long"))
    each = written(near.groupBy("id").agg(F.min("root").alias("least"), F.max("root").alias("most")))
    shared = each.filter("least <> most").select("id", "least")
    tied = near.join(shared, "id").filter("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct()
    joined = components(tied)
    return each.join(joined.select(F.col("id").alias("least"), "component"), "least", "left").select("id", F.coalesce("component", "least").alias("component"))


def _levels(edges: DataFrame) -> DataFrame:
    """(id, level): the distance of each node from a start along one edge into each node; none for those whose edges run in circles."""
    one = edges.groupBy(F.col("dst").alias("id")).agg(F.max("src").alias("to"))
    starts = edges.select(F.col("src").alias("id")).distinct().join(one.select("id"), "id", "left_anti")
    marked = one.join(starts.select(F.col("id").alias("to"), F.lit(True).alias("done")), "to", "left")
    now = written(marked.select("id", "to", F.lit(1).cast("long").alias("level"), F.coalesce("done", F.lit(False)).alias("done")))
    for _ in range(now.count().bit_length() + 1):  # a jump's length doubles
        if now.filter("not done").isEmpty():
            break
        on = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"), F.col("done").alias("ends"))
        moved = now.filter("not done").join(on, "to").select("id", F.col("next").alias("to"), (F.col("level") + F.col("more")).alias("level"), F.col("ends").alias("done"))
        now = written(now.filter("done").unionByName(moved))
    level = now.filter("done").select("id", "level").unionByName(starts.withColumn("level", F.lit(0).cast("long")))
    for _ in range(REFINED):
        above = edges.join(written(level).select(F.col("id").alias("src"), F.col("level").alias("up")), "src").groupBy(F.col("dst").alias("id")).agg((F.max("up") + 1).alias("next"))
        level = level.join(above, "id", "left").select("id", F.greatest("level", "next").alias("level"))
    return level


def dealt(edges: DataFrame, part: int = PART) -> tuple[DataFrame | None, DataFrame]:
    """(id, part) of the nodes of edges (src, dst, w), None if all are in part 0; and the edges with part and to, those of their ends."""
    if edges.count() <= part:
        return None, edges.withColumns({"part": F.lit(0), "to": F.lit(0)})
    where = written(deal(edges, part))
    both = edges.join(where.select(F.col("id").alias("src"), F.col("part").alias("part")), "src").join(where.select(F.col("id").alias("dst"), F.col("part").alias("to")), "dst")
    # by part, so that a later round reads the files of the parts that it looks at
    return where, written(both.repartitionByRange("part").sortWithinPartitions("part"))


def deal(edges: DataFrame, part: int = PART) -> DataFrame:
    """(id, part int) of each node of edges (src, dst): by component, or by bands of levels inside a component that is too large."""
    total = edges.count()
    home = written(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    placed = edges.join(home, edges["dst"] == home["id"]).select("src", "dst", "component")
    sizes = written(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    large = sizes.filter(F.col("n") > part)
    several = max(1, -(-total // part))
    small = home.join(large, "component", "left_anti").select("id", F.pmod(F.xxhash64("component"), F.lit(several)).cast("int").alias("part"))
    most = large.agg(F.max("n")).first()[0]
    if most is None:
        return small
    cuts = min(MOST_CUTS, -(-most // part))
    inside = written(placed.join(large.select("component"), "component", "left_semi"))
    level = written(_levels(inside.select("src", "dst")))
    nodes = home.join(large.select("component"), "component", "left_semi").join(level, "id", "left")
    ranges = nodes.filter("level is not null").groupBy("component").agg(F.percentile_approx("level", [k / cuts for k in range(1, cuts)], F.lit(100 * cuts)).alias("cuts"))
    at = nodes.join(ranges, "component", "left")  # large components are at most total / part, each with its cuts
    band, same = F.size(F.filter("cuts", lambda c: c < F.col("level"))), F.size(F.filter("cuts", lambda c: c == F.col("level")))
    where = F.when(F.col("level").isNull(), F.xxhash64("component", F.pmod(F.xxhash64("id"), F.lit(cuts)))).otherwise(F.xxhash64("component", band, F.pmod(F.xxhash64("id"), F.greatest(same, F.lit(1)))))
    return small.unionByName(at.select("id", F.pmod(where, F.lit(2**31 - 1 - several)).cast("int").alias("part")).withColumn("part", F.col("part") + several))


class Part:
    """The edges of one part, by their sources; at: the number of each node that it has."""

    def __init__(self, ids: np.ndarray, edges: pa.Table, part: int):
        src, dst, w, to = (edges.column(c).to_numpy() for c in ("src", "dst", "w", "to"))
        own = to == part
        self.ids = np.unique(np.concatenate((ids, src, dst[own])))
        order = np.argsort(src, kind="stable")
        self.dst, self.w, self.to, self.own = dst[order], w[order].astype(np.int64), to[order], own[order]
        self.start = np.searchsorted(src[order], self.ids, "left")
        self.stop = np.searchsorted(src[order], self.ids, "right")
        self.dst_at = np.searchsorted(self.ids, np.where(self.own, self.dst, self.ids[0] if len(self.ids) else 0))

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges that leave nodes, and which of them each leaves."""
        n = self.stop[nodes] - self.start[nodes]
        from_ = np.repeat(np.arange(len(nodes)), n)
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[nodes], n), from_


def _rows(kind: int, part: np.ndarray, ids: np.ndarray, n: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array(np.full(len(ids), kind, np.int32)), "part": pa.array(part.astype(np.int32)), "id": pa.array(ids.astype(np.int64)), "n": pa.array(n.astype(np.int64)), "value": pa.array(value.astype(np.int64))})


def _sent(to: list[np.ndarray], ids: list[np.ndarray], value: list[np.ndarray], best) -> pa.Table:
    """Messages (kind 2), one for each node that something is sent to: how many edges, and the best value."""
    if not ids:
        return _rows(2, *[np.zeros(0, np.int64)] * 4)
    to, ids, value = (np.concatenate(x) for x in (to, ids, value))
    nodes, at, n = np.unique(ids, return_inverse=True, return_counts=True)
    out = np.full(len(nodes), -1 if best is np.maximum else np.iinfo(np.int64).max)
    best.at(out, at, value)
    where = np.zeros(len(nodes), np.int64)
    where[at] = to
    return _rows(2, where, nodes, n, out)


def peel(state: pa.Table, edges: pa.Table) -> pa.Table:
    """One part's work on levels. state: nodes that wait (kind 1: for n edges, value so far) and messages (kind 2: n edges are done,
    the best of them gives value). Gives done nodes (kind 0), those that wait still, and messages to other parts."""
    kind, ids, n, value = (state.column(c).to_numpy() for c in ("kind", "id", "n", "value"))
    part = int(state.column("part")[0].as_py())
    of = Part(ids, edges, part)
    at = np.searchsorted(of.ids, ids)
    waits, level, here = np.zeros(len(of.ids), np.int64), np.zeros(len(of.ids), np.int64), np.zeros(len(of.ids), bool)
    np.add.at(waits, at, np.where(kind == 1, n, -n))
    np.maximum.at(level, at, value)
    here[at[kind == 1]] = True
    ready, done, sent = np.flatnonzero(here & (waits == 0)), np.zeros(len(of.ids), bool), ([], [], [])
    while len(ready):
        done[ready] = True
        e, from_ = of.out(ready)
        if not len(e):
            break
        reached, own = level[ready][from_] + of.w[e], of.own[e]
        if not own.all():
            for kept, x in zip(sent, (of.to[e][~own], of.dst[e][~own], reached[~own])):
                kept.append(x)
        to = of.dst_at[e][own]
        np.maximum.at(level, to, reached[own])
        np.subtract.at(waits, to, 1)
        ready = np.unique(to[(waits[to] == 0) & here[to] & ~done[to]])
    left = here & ~done
    fill = lambda m: np.full(int(m.sum()), part)
    return pa.concat_tables([_rows(0, fill(done), of.ids[done], waits[done], level[done]), _rows(1, fill(left), of.ids[left], waits[left], level[left]), _sent(*sent, np.maximum)])


def spread(state: pa.Table, edges: pa.Table) -> pa.Table:
    """One part's work on distances. state: the distance known so far of nodes (kind 1) and offers from other parts (kind 2). Gives
    the distances known now (kind 1), and offers to other parts of what fell."""
    kind, ids, value = (state.column(c).to_numpy() for c in ("kind", "id", "value"))
    part = int(state.column("part")[0].as_py())
    of = Part(ids, edges, part)
    far = np.iinfo(np.int64).max
    known = np.full(len(of.ids), far)
    at = np.searchsorted(of.ids, ids)
    np.minimum.at(known, at[kind == 1], value[kind == 1])
    offered = known.copy()
    np.minimum.at(offered, at[kind == 2], value[kind == 2])
    open_ = np.flatnonzero(offered < known)
    known, sent = offered, ([], [], [])
    while len(open_):
        least = known[open_].min()
        now, open_ = open_[known[open_] == least], open_[known[open_] > least]
        e, from_ = of.out(now)
        reached, own = least + of.w[e], of.own[e]
        for kept, x in zip(sent, (of.to[e][~own], of.dst[e][~own], reached[~own])):
            kept.append(x)
        to, reached = of.dst_at[e][own], reached[own]
        before = known[to]
        np.minimum.at(known, to, reached)
        open_ = np.unique(np.concatenate((open_, to[known[to] < before])))
    has = known < far
    return pa.concat_tables([_rows(1, np.full(int(has.sum()), part), of.ids[has], np.zeros(int(has.sum())), known[has]), _sent(*sent, np.minimum)])


def rounds(state: DataFrame, edges: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], most: int) -> tuple[DataFrame, DataFrame]:
    """All rows of kind 0 that work gives, and of kind 1 those that it gives last for each part.

    state (STATE, kinds 1 and 2) and edges (part, src, dst, w, to: the part of dst) are worked on part by part, then again where
    messages come to, until none does.
    """
    outs: list[DataFrame] = []
    latest: dict[int, int] = {}  # the round in which a part was last worked on; parts are few
    pick = lambda df, parts: df.filter(F.col("part").isin(sorted(parts)))
    edges = edges.select(*(F.col(c).alias(c) for c in edges.columns))  # state may come from them
    here = edges
    for turn in range(most + 1):
        out = written(state.groupBy("part").cogroup(here.groupBy("part")).applyInArrow(_skipping(work), STATE))
        outs.append(out)
        seen = out.groupBy("kind", "part").count().collect()
        latest |= {r.part: turn for r in seen if r.kind != 2}
        active = {r.part for r in seen if r.kind == 2}
        if not active:
            break
        if turn == most:
            raise RuntimeError(f"more than {most} rounds")
        now = [pick(outs[t], {p for p in active if latest.get(p) == t}).filter("kind = 1") for t in sorted({latest[p] for p in active if p in latest})]
        state = reduce(DataFrame.unionByName, [*now, out.filter("kind = 2")])
        here = pick(edges, active)
    last = [pick(outs[t], {p for p, k in latest.items() if k == t}).filter("kind = 1") for t in sorted(set(latest.values()))]
    every = reduce(DataFrame.unionByName, outs)
    return every.filter("kind = 0"), reduce(DataFrame.unionByName, last) if last else every.filter("kind = 1")


def alone(edges: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What work gives of each part of edges (part, src, dst, w), where no edge leaves its part; written."""
    return written(edges.select("part", "src", "dst", "w").groupBy("part").applyInArrow(work, schema))


def _whole(edges: pa.Table) -> Part:
    """A part that has all of its edges' ends; src -1 is no node."""
    e = edges.filter(pc.greater_equal(edges.column("src"), 0))
    return Part(edges.column("dst").to_numpy(), e.append_column("to", pa.array(np.zeros(e.num_rows, np.int32))), 0)


def levels_of(edges: pa.Table) -> pa.Table:
    """(id, value): the level of each node of edges, -1 of those on or behind a cycle."""
    of = _whole(edges)
    waits, level = np.bincount(of.dst_at, minlength=len(of.ids)), np.zeros(len(of.ids), np.int64)
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        e, from_ = of.out(ready)
        to = of.dst_at[e]
        np.maximum.at(level, to, level[ready][from_] + of.w[e])
        np.subtract.at(waits, to, 1)
        ready = np.unique(to[waits[to] == 0])
    return pa.table({"id": of.ids, "value": np.where(waits > 0, -1, level)})


def distances_of(edges: pa.Table) -> pa.Table:
    """(id, value): how far the nodes that can be reached lie from those that an edge from -1 leads to."""
    of = _whole(edges)
    far = np.iinfo(np.int64).max
    known = np.full(len(of.ids), far)
    open_ = np.searchsorted(of.ids, np.unique(edges.filter(pc.less(edges.column("src"), 0)).column("dst").to_numpy()))
    known[open_] = 0
    while len(open_):
        least = known[open_].min()
        now, open_ = open_[known[open_] == least], open_[known[open_] > least]
        e, from_ = of.out(now)
        to, reached = of.dst_at[e], least + of.w[e]
        before = known[to]
        np.minimum.at(known, to, reached)
        open_ = np.unique(np.concatenate((open_, to[known[to] < before])))
    has = known < far
    return pa.table({"id": of.ids[has], "value": known[has]})


def _skipping(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """work, for parts that have a state; edges without one have nothing to say."""

    def run(state: pa.Table, edges: pa.Table) -> pa.Table:
        return work(state, edges) if state.num_rows else _rows(0, *[np.zeros(0, np.int64)] * 4)

    return run
