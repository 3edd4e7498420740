"""MinHash near-dedup by tensored banding.

A text's set is that of its distinct shingles, as 64-bit hashes. Equal sets are one class, and only classes are compared. A class
has COLLECTIONS small collections of WIDTH minhashes; a table's key combines a pair of them, so 28 minhashes make the keys of 91
tables. Two sets meet if any two of their collections agree: at a similarity of 0.85 all but 6 in ten million do, since each
collection agrees with probability 0.85 ** 2. A collection's value that no other class has makes no keys.

Candidates are confirmed on full sets. In each bucket, all members are first compared with one of them, the most copied and then the
earliest. Buckets whose other members are in one component are done. What is left is compared in tasks, in groups of classes that
share buckets: bit rows over the shingles that two members have at least, and the sizes of their intersections by counting bits.
Tasks emit a spanning forest of their links, never pairs of a group; a large group is cut into chunks, and every pair of chunks met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, join_hot, materialize, table
from corpusloom.llm.components import components

SHINGLE, SEED = 5, 42
#: Sets are linked if AT_LEAST hundredths of their union are shared.
AT_LEAST = 85
COLLECTIONS, WIDTH = 14, 2
BANDS = [f"b{i}" for i in range(COLLECTIONS)]
#: Members, and shingles, of a chunk of a group; members of a group of classes that share buckets, beyond which buckets stay apart.
CHUNK, CHUNK_SHINGLES, TOGETHER = 1024, 1 << 20, 4096
#: Shingles that one vectorised step of minhashing takes, about; words of 64 shingles that a block of a chunk's bit rows has, 32 MB.
STEP, BLOCK_WORDS = 1 << 19, 1 << 22

_r = np.random.default_rng(11)
_XOR = _r.integers(0, 1 << 64, COLLECTIONS * WIDTH, np.uint64)
_ODD = _r.integers(0, 1 << 64, COLLECTIONS * WIDTH, np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set; none without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space 09-0D and 20 only
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[: len(w) - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def collections(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COLLECTIONS values for each (non-empty) set; equal values of different collections don't meet."""
    out = np.empty((len(sets), COLLECTIONS), np.int64)
    at = 0
    while at < len(sets):
        stop, held = at, 0
        while stop < len(sets) and (stop == at or held + len(sets[stop]) <= STEP):
            held += len(sets[stop])
            stop += 1
        h = np.concatenate(sets[at:stop])
        starts = np.cumsum([0] + [len(s) for s in sets[at : stop - 1]])
        for c in range(COLLECTIONS):
            value = np.full(stop - at, c + 1, np.uint64)
            for k in range(c * WIDTH, (c + 1) * WIDTH):
                x = (h ^ _XOR[k]) * _ODD[k]
                x ^= x >> np.uint64(32)
                value = (value ^ np.minimum.reduceat(x, starts)) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            out[at:stop, c] = value.view(np.int64)
        at = stop
    return out


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, t1 and t2 (hashes of the text), n_shingles, s1 and s2 (a hash of the set) and the collections' values of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64), np.zeros((batch.num_rows, COLLECTIONS), np.int64)
            texts, sets, rows, held = batch.column(3), [], [], 0
            for i in range(batch.num_rows):
                s = shingles(texts[i].as_py(), shingle)
                n[i] = len(s)
                if len(s):
                    keys[i] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    sets.append(s)
                    rows.append(i)
                    held += len(s)
                if held > STEP or i == batch.num_rows - 1:
                    if sets:
                        bands[rows] = collections(sets)
                    sets, rows, held = [], [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *(pa.array(bands[:, c]) for c in range(COLLECTIONS))], ["doc_id", "t1", "t2", "n_shingles", "s1", "s2", *BANDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "text")
    return named.mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, n_shingles long, s1 long, s2 long, " + ", ".join(f"{b} long" for b in BANDS))


def buckets(classes: DataFrame) -> DataFrame:
    """(key, node): the tables' entries of classes (node, b0, b1 ...), for pairs of collections that other classes share."""
    each = classes.select("node", F.explode(F.array(*BANDS)).alias("value"))
    shared = each.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("value")
    kept = each.join(shared, "value", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("value")).alias("v"))  # COLLECTIONS at most
    pairs = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, COLLECTIONS), lambda y: F.xxhash64(x, y))))
    return kept.filter(F.size("v") > 1).select(F.explode(pairs).alias("key"), "node")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, set array<long>) of classes wanted (node, t1, s1, s2). Copies of a text are merged before they are shuffled."""
    named = docs.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "text")
    once = named.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(wanted.select("t1").distinct(), "t1", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(at, 256)
                sets = [shingles(part[i].as_py(), shingle) for i in range(len(part))]
                keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["s1", "s2", "set"])

    found = once.select("text").mapInArrow(run, "s1 long, s2 long, set array<long>")
    # two texts that share t1 may have come along; the set's own hash tells which is meant
    return found.join(wanted.select("node", "s1", "s2"), ["s1", "s2"]).dropDuplicates(["node"]).select("node", "set")


def confirm(pairs: DataFrame, sets: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """(a, b): those of pairs (a, b: nodes) whose sets are linked."""
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(b, "b").join(a, "a")
    n, m = F.size("set_a").cast("long"), F.size("set_b").cast("long")
    near = both.filter(F.least(n, m) * 100 >= F.greatest(n, m) * at_least)
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return near.withColumn("shared", shared).filter(F.col("shared") * 100 >= (n + m - F.col("shared")) * at_least).select("a", "b")


def forest(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, at_least: int = AT_LEAST) -> list[tuple[int, int]]:
    """Indices of a spanning forest of the links between sets of different components.

    side: where sets are of two chunks, 1 and 2 tell them apart, and only sets of different chunks are compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    common = count[at] > 1
    number = np.cumsum(count > 1) - 1
    owner, bit = owner[common], number[at[common]]
    words = int((count > 1).sum() + 63) // 64
    step = max(1, BLOCK_WORDS // n)  # words of a row's block
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    shared = np.zeros((n, n), np.int32) if words > step else None
    made: list[tuple[int, int]] = []
    for low in range(0, max(words, 1), step):
        inside = (bit >= low * 64) & (bit < (low + step) * 64)
        rows = np.zeros((n, min(step, max(words, 1) - low)), np.uint64)
        b = bit[inside] - low * 64
        np.bitwise_or.at(rows, (owner[inside], b // 64), np.uint64(1) << (b % 64).astype(np.uint64))
        last = low + step >= words
        for i in range(n - 1):
            j = np.arange(i + 1, n)
            j = j[(np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * at_least) & ((side[i] == 0) | (side[i] != side[j])) & (component[i] != component[j])]
            if not len(j):
                continue
            if shared is None:
                mine = find(int(component[i]))
                j = j[[find(int(c)) != mine for c in component[j]]]
            k = np.bitwise_count(rows[i] & rows[j]).sum(axis=1, dtype=np.int64)
            if shared is not None:
                shared[i, j] += k.astype(np.int32)
                k = shared[i, j].astype(np.int64)
            if not last:
                continue
            for x in j[k * 100 >= (size[i] + size[j] - k) * at_least].tolist():
                p, q = find(int(component[i])), find(int(component[x]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    made.append((i, x))
    return made


def rest(open_: DataFrame, sets: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """(a, b): links among the members of each group of open_ (group, node, component)."""
    filled = open_.join(sets, "node")
    sizes = open_.join(sets.select("node", F.size("set").alias("size")), "node").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("all") / CHUNK_SHINGLES)).cast("int")
    counted = sizes.select("group", F.least(chunks, F.col("n").cast("int")).alias("chunks"))
    dealt = filled.join(counted, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pairs = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, F.col("own")) * F.col("chunks") + F.greatest(c, F.col("own"))))
    met = dealt.withColumn("pair", F.explode(pairs))
    low = F.floor(F.col("pair") / F.col("chunks")).cast("int")
    side = F.when((F.col("chunks") == 1) | (low == F.col("pair") % F.col("chunks")), 0).when(low == F.col("own"), 1).otherwise(2)
    met = met.select("group", "pair", "node", "component", side.cast("int").alias("side"), "set").repartition("group", "pair").sortWithinPartitions("group", "pair", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, parts, sides, sets_ = None, [], [], [], []

        def emit() -> pa.RecordBatch:
            made = forest(sets_, np.array(parts, np.int64), np.array(sides), at_least) if len(sets_) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in made], pa.int64()), pa.array([nodes[j] for _, j in made], pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for r, (group, pair, node, part, s) in enumerate(zip(*cols)):
                if (group, pair) != now:
                    if now is not None:
                        yield emit()
                    now, nodes, parts, sides, sets_ = (group, pair), [], [], [], []
                nodes.append(node)
                parts.append(part)
                sides.append(s)
                sets_.append(batch.column(5)[r].values.to_numpy().copy())
        if now is not None:
            yield emit()

    return met.mapInArrow(compare, "a long, b long")


def near_components(docs: DataFrame, at_least: int = AT_LEAST, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs: component_id is the smallest doc_id that links of sets reach.

    Texts without words, and null ones, have no shingles and are linked with nothing: their component_id is their own doc_id.
    Rows without a doc_id take part; a component of only such rows has a null component_id. Repeated rows stay, with equal
    results; ids are of any type. Extra columns don't matter. An empty table gives no rows.
    """
    all_ = materialize(prints(docs, shingle), "prints")
    kinds = all_.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min("t1").alias("t1"), *(F.min(b).alias(b) for b in BANDS))
    # numbered so that the smallest of some nodes is the most copied, then the earliest
    classes = materialize(kinds.orderBy(F.desc("n"), F.col("least").asc_nulls_last(), "s1", "s2").drop("n").withColumn("node", F.monotonically_increasing_id()), "classes")
    met = materialize(buckets(classes), "buckets")
    first = met.groupBy("key").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "rep")
    members = materialize(met.join(first, "key").filter("node <> rep"), "members")
    discard(met)
    pairs = materialize(members.select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = classes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
    sets = materialize(full_sets(docs, wanted, shingle), "sets")
    links = materialize(confirm(pairs, sets, at_least), "links")
    found = components(links).withColumnRenamed("component", "__c")
    known = members.join(found, "node", "left").select("key", "node", F.coalesce("__c", "node").alias("component"))
    open_keys = (
        known.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("f"), F.sum(F.xxhash64(F.lit(2), "node").cast("decimal(38,0)")).alias("g"))
        .filter("p <> q").groupBy("n", "f", "g").agg(F.min("key").alias("key"), F.min("p").alias("p"))  # buckets with the same members count once
    )
    open_ = materialize(known.join(open_keys.select("key"), "key"), "open")
    lead = open_.groupBy("key").agg(F.min("node").alias("lead"))
    near = components(open_.join(lead, "key").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    groups = near.join(near.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", F.col("component").alias("super"), "size")
    together = F.when(F.col("size") <= TOGETHER, F.xxhash64(F.lit("together"), "super")).otherwise(F.col("key"))
    more = materialize(rest(materialize(open_.join(groups, "node").select(together.alias("group"), "node", "component").distinct(), "groups"), sets, at_least), "links")
    for done in (members, pairs, sets, open_):
        discard(done)
    joined = components(links.union(more))
    linked = classes.select("s1", "s2", "node", "least").join(joined, "node")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    alone = classes.join(joined, "node", "left_anti").select("s1", "s2", F.col("least").alias("component_id"))
    facts = materialize(linked.join(ids, "component").select("s1", "s2", "component_id").unionByName(alone), "components")
    some = join_hot(all_.filter("n_shingles > 0").select("doc_id", "n_shingles", "s1", "s2"), facts, ["s1", "s2"])
    none = all_.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none.select("doc_id", "n_shingles", "component_id"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: All pairs with a common shingle, counted; no hashes.
OP11_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) end) g from w
), n as (
  select doc_id, count(*) n from s group by 1
), p as (
  select a.doc_id a, b.doc_id b, count(*) k from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)
), ends as (
  select a, b from e union all select b, a from e
), r(doc_id, c) as (
  select doc_id, doc_id from w union select ends.b, r.c from r join ends on ends.a = r.doc_id
), m as (
  select doc_id, min(c) component_id from r group by 1
)
select w.doc_id, coalesce(n.n, 0) n_shingles, component_id, w.doc_id = component_id kept from w left join n using (doc_id) join m using (doc_id)
"""

ORACLE: dict[str, str] = {"op11_minhash": OP11_SQL}
QUERIES = {"op11_minhash": op11_minhash}
