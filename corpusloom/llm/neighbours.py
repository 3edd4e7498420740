"""Approximate nearest neighbours in a forest of random-projection trees.

Trees are fitted on a bounded sample; every vector is indexed, once for each tree, under the leaf that it falls into. A query
walks all trees at once with one priority queue, whose order is the smallest margin by which the path so far missed the other
side, until the leaves that it has reached hold enough vectors. Leaves and queries then meet in Spark by leaf; a task ranks a
leaf's vectors exactly and passes on the nearest few for each query.

Equal vectors are one entry of the index, named by two hashes of the vector, with the few smallest ids that could ever be among
the nearest; a vector with very many copies does not swell a leaf, is asked for once, and nothing is lost. Leaves above a size
are split by salt. The forest deepens with the index up to DEPTH levels and NORMAL_BYTES, which bound what is broadcast; beyond that
its leaves grow with the index.

How much of the index a query has to look at is measured: the exact neighbours of some probes are found in one pass, and the queue
of each probe tells how far it has to go for each of them. Vectors in clusters take little, vectors without structure most of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import join_hot, materialize, table

#: Nearest to return; trees; vectors that the trees are fitted on, at most about; of the index in a leaf, and levels of a tree at
#: most; vectors that a query looks at, at least; rows of a leaf in one task. Queries whose findings a task holds. Bytes of a forest's
#: directions. Probes that measure how far to look, and the share of their neighbours that must be found.
TASK_QUERIES = 50_000
NEAREST, TREES, SAMPLE, LEAF, DEPTH, LOOK_LEAST, SALT_ROWS = 10, 12, 20_000, 128, 12, 6_000, 20_000
NORMAL_BYTES = 64 << 20
PROBES, RECALL = 64, 0.96


class Forest:
    """Complete binary trees over random directions, each split at the sample's median; size is that of the index."""

    def __init__(self, sample: np.ndarray, size: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        self.depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, size / leaf))))), max(0, int(np.log2(max(1, NORMAL_BYTES / (4 * trees * dim))))))
        inner = (1 << self.depth) - 1
        self.normals = np.zeros((trees, inner, dim), np.float32)
        self.cuts = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            members = {0: np.arange(n)}
            for node in range(inner):
                own = members.pop(node)
                w = np.zeros(dim)
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    w = sample[a].astype(float) - sample[b]
                if not np.any(w):
                    w = rng.normal(size=dim)
                w = (w / np.linalg.norm(w)).astype(np.float32)
                p = sample[own] @ w
                cut = np.float32(np.median(p)) if len(own) else np.float32(0)
                self.normals[t, node], self.cuts[t, node] = w, cut
                members[2 * node + 1], members[2 * node + 2] = own[p < cut], own[p >= cut]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.normals)), np.int32)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normals[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, enough: int | None) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until their sizes sum to enough; all leaves of one tree if that is None."""
        if enough is None:
            return [(0, int(leaf)) for leaf in np.flatnonzero(sizes[0])]
        inner = (1 << self.depth) - 1
        margins = self.normals @ q - self.cuts
        queue = [(0.0, t, 0) for t in range(len(self.normals))]
        got, seen = [], 0
        while queue and seen < enough:
            miss, t, node = heapq.heappop(queue)
            while node < inner:
                m = float(margins[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(miss, abs(m)), t, far))
                node = near
            leaf = node - inner
            if sizes[t, leaf]:
                got.append((t, leaf))
                seen += int(sizes[t, leaf])
        return got


def usable(vectors: DataFrame, *keep: Column) -> DataFrame:
    """(vec_id, v) of the rows that take part: not null, of the commonest length, all finite, not all zero; and columns keep."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), *keep)
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def measured(entries: DataFrame, probes: np.ndarray, forest: Forest, sizes: np.ndarray, k: int = NEAREST, recall: float = RECALL) -> int:
    """How many vectors a query has to look at, repeats over trees counted, so that this share of the probes' k nearest is found; the
    size of the index at most."""
    shared = entries.sparkSession.sparkContext.broadcast(probes)  # PROBES vectors
    kind = entries.schema["v"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(0)).astype(np.float64)
            for p, q in enumerate(shared.value):
                d = np.sqrt(((m - q) ** 2).sum(axis=1))
                at = np.argsort(d, kind="stable")[: k + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(d[at]), batch.column(0).take(pa.array(at))], ["probe", "score", "v"])

    found = entries.select("v").mapInArrow(near, f"probe int, score double, v {kind}")
    by = Window.partitionBy("probe").orderBy("score")
    best = found.withColumn("n", F.row_number().over(by)).filter(F.col("n").between(2, k + 1)).select("probe", "v").toPandas()  # PROBES * k; the first is the probe
    total = int(sizes[0].sum())
    need = []
    for p, rows in best.groupby("probe"):
        order = forest.search(probes[p].astype(np.float32), sizes, total)
        before = np.concatenate(([0], np.cumsum([sizes[x] for x in order])))
        place = {x: int(b) for x, b in zip(order, before)}
        leaves = forest.leaves(np.array(rows["v"].tolist(), np.float32))
        need += [min((place.get((t, int(leaf)), total) for t, leaf in enumerate(each)), default=total) + 1 for each in leaves]
    return min(total, int(np.quantile(need, recall, method="higher"))) if need else total


def nearest(vectors: DataFrame, queries: Column, k: int = NEAREST, look: float | str | None = "measured", least: int = LOOK_LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where queries holds, the k nearest other rows found, by Euclidean distance.

    look: the share of the index that a query looks at, repeats over trees counted, and at least `least` vectors; "measured" lets
    measured() choose it; None looks at every vector once, which is exact. Rows that usable() leaves out are neither queries nor
    candidates. Rows equal in id and vector ask once, and each is a candidate of the other. Rows that share an id but not the
    vector are queries and candidates of their own. So an id may come twice. Ties go to the smaller id. A table with a single usable row, or none, gives no rows. Columns other than vec_id and
    embedding are not read but by queries.
    """
    rows = usable(vectors, F.coalesce(queries, F.lit(False)).alias("asked"))
    kind = rows.schema["v"].dataType.simpleString()
    named = lambda df: df.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    # the k + 1 smallest ids of a vector; Spark drops later rows before the shuffle
    few = named(rows.select("vec_id", "v")).withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    entry = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.collect_list("vec_id").alias("ids"))
    entries = materialize(entry, "ann-entries")
    n = entries.count()
    asked = materialize(named(rows.filter("asked")).select("vec_id", "h1", "h2").distinct(), "ann-asked")
    if not n:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rate = min(1.0, SAMPLE / n)
    fits = F.pmod(F.xxhash64("h1", "h2", F.lit("sample")), F.lit(1 << 30)) < rate * (1 << 30)
    picked = entries.filter(fits).select("h1", "v").toPandas().sort_values("h1")  # about SAMPLE rows
    sample = picked["v"].tolist() or [entries.select("v").first()["v"]]
    forest = Forest(np.array(sample, np.float32), n)
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(forest)  # bounded by DEPTH

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = shared.value.leaves(_matrix(batch.column(0)).astype(np.float32))
            for t in range(leaves.shape[1]):
                leaf, count = np.unique(leaves[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf), pa.array(count.astype(np.int64))], ["tree", "leaf", "n"])

    sizes = np.zeros((TREES, 1 << forest.depth), np.int64)
    counted = entries.select("v").mapInArrow(place, "tree int, leaf int, n long")
    for r in counted.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # a row for each leaf: bounded by DEPTH
        sizes[r["tree"], r["leaf"]] = r["n"]
    salts = -(-sizes // SALT_ROWS)
    known = context.broadcast((sizes, salts))
    if look == "measured":
        enough = least if n <= least else max(least, measured(entries, np.array(sample[:PROBES], np.float64), forest, sizes, k))
    else:
        enough = None if look is None else max(least, int(look * n))
    used = 1 if look is None else TREES
    names = ["tree", "leaf", "salt", "asked", "h1", "h2", "least", "v"]
    schema = f"tree int, leaf int, salt int, asked boolean, h1 long, h2 long, least long, v {kind}"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = shared.value.leaves(_matrix(batch.column(3)).astype(np.float32))
            h1 = batch.column(0).to_numpy()
            for t in range(used):
                salt = (h1 % np.maximum(1, known.value[1][t, leaves[:, t]])).astype(np.int32)
                m = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, t, np.int32)), pa.array(leaves[:, t]), pa.array(salt), pa.array(np.zeros(m, bool)), *batch.columns], names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, salts = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(3)).astype(np.float32)
            for i in range(batch.num_rows):
                rows = [(t, leaf, s) for t, leaf in shared.value.search(x[i], sizes, enough) for s in range(int(salts[t, leaf]))]
                at = pa.array(np.full(len(rows), i))
                cols = np.array(rows, np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(pa.array(cols[:, c]) for c in range(3)), pa.array(np.ones(len(rows), bool)), *(c.take(at) for c in batch.columns)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by leaf, vectors before queries, to the k + 1 nearest entries that a task's leaves hold for each query.

        What a query has found so far is kept over the leaves of the task, and passed on early when many queries have something.
        """
        key, ids, parts = None, [], []
        have: tuple[np.ndarray, np.ndarray] | None = None
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            q = np.repeat(np.array(list(best), np.int64).reshape(-1, 2), [len(d) for d, _ in best.values()], axis=0)
            d, e = np.concatenate([d for d, _ in best.values()]), np.concatenate([e for _, e in best.values()])
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (q[:, 0], q[:, 1], e[:, 0], e[:, 1], e[:, 2], d)], ["q1", "q2", "h1", "h2", "least", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            asked_ = batch.column(3).to_numpy(zero_copy_only=False)
            id_ = np.stack([batch.column(c).to_numpy() for c in (4, 5, 6)], axis=1)
            x = _matrix(batch.column(7)).astype(np.float64)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (asked_[1:] != asked_[:-1])) + 1
            for a, b in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(keys)]))):
                if tuple(keys[a]) != key:
                    key, ids, parts, have = tuple(keys[a]), [], [], None
                if not asked_[a]:
                    ids.append(id_[a:b])
                    parts.append(x[a:b])
                    continue
                if have is None:
                    have = (np.concatenate(ids), np.concatenate(parts)) if ids else (np.zeros((0, 3), np.int64), np.zeros((0, x.shape[1])))
                own, m = have
                if not len(own):
                    continue
                for i in range(a, b):
                    d = np.sqrt(((m - x[i]) ** 2).sum(axis=1))
                    q = (int(id_[i, 0]), int(id_[i, 1]))
                    old = best.get(q)
                    if len(d) > k + 1:
                        limit = np.partition(d, k)[k]
                        if old is not None and len(old[0]) == k + 1:
                            limit = min(limit, old[0][-1])
                        near = np.flatnonzero(d <= limit)
                    else:
                        near = np.arange(len(d))
                    if old is None:
                        d, e = d[near], own[near]
                    else:
                        d, e = np.concatenate((old[0], d[near])), np.concatenate((old[1], own[near]))
                    order = np.lexsort((e[:, 1], e[:, 0], e[:, 2], d))
                    d, e = d[order], e[order]
                    new = np.concatenate(([True], (e[1:] != e[:-1]).any(axis=1)))  # an entry that several trees found
                    best[q] = (d[new][: k + 1], e[new][: k + 1])
            if len(best) > TASK_QUERIES:
                yield flush()
        if best:
            yield flush()

    searched = entries.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    both = entries.select("h1", "h2", "least", "v").mapInArrow(index, schema).unionByName(searched.select("h1", "h2", "least", "v").mapInArrow(probe, schema))
    dealt = both.repartition("tree", "leaf", "salt").sortWithinPartitions("tree", "leaf", "salt", "asked")
    met = dealt.mapInArrow(meet, "q1 long, q2 long, h1 long, h2 long, least long, score double")
    found = met.groupBy("q1", "q2", "h1", "h2").agg(F.min("score").alias("score"), F.min("least").alias("least"))
    by = Window.partitionBy("q1", "q2").orderBy("score", "least", "h1", "h2")
    found = found.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
    each = found.join(entries.select("h1", "h2", F.explode("ids").alias("vec_id")), ["h1", "h2"])
    own = (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "vec_id", "h1", "h2"))).filter(F.col("n") <= k + 1)
    answers = each.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", own.alias("own")))).alias("near"))
    answers = materialize(answers.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "near"), "ann-answers")
    self_ = F.array_position(F.transform("near", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True).cast("int")  # the query's own row; 0: not among them
    others = F.slice(F.when(self_ > 0, F.concat(F.slice("near", F.lit(1), self_ - 1), F.slice("near", self_ + 1, F.lit(k + 1)))).otherwise(F.col("near")), 1, k)
    out = join_hot(asked.withColumnRenamed("vec_id", "query_id"), answers, ["h1", "h2"], "inner").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE: dict[str, str] = {}
QUERIES = {"op2_nearest_neighbours": op2_nearest_neighbours}
