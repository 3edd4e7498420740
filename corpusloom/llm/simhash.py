"""SimHash near-dedup with bit-sliced comparison.

Fingerprints come from Arrow batches of texts. Equal fingerprints are one class. Two classes within the radius agree on at
least `BLOCKS - radius` of their BLOCKS bit blocks, so each class is dealt out once for each choice of that many blocks; only
classes with the same blocks meet. There, bit planes are stored vertically (bit j of all fingerprints of a batch in one row of
words); the distances of all rows to the row s places further are counted at once by carry-save adders, and a block of 64 rows
is abandoned once all its counters exceed the radius. Tasks emit a spanning forest of their links, never pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import join_hot, materialize, table
from corpusloom.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bit blocks of a fingerprint as (offset, bits).
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Rows of one key that a task compares at once; larger groups are cut into such chunks, and all pairs of chunks compared.
CHUNK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit j is set if it is set in over half of the shingles' hashes. No words: 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space 09-0D and 20 only
    if not w:
        return 0
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[: len(w) - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(j) for j in np.flatnonzero(2 * counts > len(h))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of each row of docs (doc_id, text); ids are of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [_signed(fingerprint(texts[i].as_py())) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _near(planes: np.ndarray, n: int, s: int, same: np.ndarray, radius: int) -> np.ndarray:
    """Packed bits: row i is within the radius of row i + s. same: packed rows for which the question stands."""
    words = planes.shape[1]
    keep = np.flatnonzero(same)  # blocks of 64 rows that are still open
    c1, c2, c4, over = (np.zeros(len(keep), np.uint64) for _ in range(4))
    high, low = divmod(s, 64)
    for j in range(planes.shape[0]):
        p = planes[j]
        lo = np.where(keep + high < words, p[np.minimum(keep + high, words - 1)], np.uint64(0))
        if low:
            nxt = np.where(keep + high + 1 < words, p[np.minimum(keep + high + 1, words - 1)], np.uint64(0))
            lo = (lo >> np.uint64(low)) | (nxt << np.uint64(64 - low))
        d = p[keep] ^ lo
        carry = c1 & d
        c1 ^= d
        d = c2 & carry
        c2 ^= carry
        over |= c4 & d
        c4 ^= d
        if j % 8 == 7:
            far = over | c4 if radius == 3 else over
            open_ = (same[keep] & ~far) != 0
            if not open_.all():
                keep, c1, c2, c4, over = keep[open_], c1[open_], c2[open_], c4[open_], over[open_]
                if not len(keep):
                    break
    out = np.zeros(words, np.uint64)
    if len(keep):
        count_over = over.copy()
        for bits in range(8):  # counter values above the radius
            if bits > radius:
                count_over |= (c4 if bits & 4 else ~c4) & (c2 if bits & 2 else ~c2) & (c1 if bits & 1 else ~c1)
        out[keep] = same[keep] & ~count_over
    return out


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 along the last axis, packed into little-endian words."""
    pad = (-bits.shape[-1]) % 64
    if pad:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), np.uint8)], axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8").astype(np.uint64)


def links(group: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of a spanning forest of all links within groups. Rows are sorted by group.

    side: where a group is one of a pair of chunks, 1 and 2 tell the chunks apart, and only rows of different chunks count.
    """
    n = len(fp)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    made: list[tuple[int, int]] = []
    rows = np.arange(n)
    s = 0
    while True:
        s += 1
        # rows whose group goes on for s rows at least stay; the others have met all of their group
        last = np.concatenate((group[1:] != group[:-1], [True])) if len(group) else np.zeros(0, bool)
        stop = np.flatnonzero(last)
        start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
        length = np.repeat(stop - start + 1, stop - start + 1) if len(stop) else np.zeros(0, int)
        if s == 1 or (len(length) and (length <= s).sum() * 4 > len(length)):
            big = length > s
            group, fp, side, rows = group[big], fp[big], side[big], rows[big]
            if not len(group):
                break
            planes = _pack(np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.copy())
        elif not len(length) or length.max() <= s:
            break
        m = len(group)
        if s >= m:
            break
        ok = np.zeros(m, np.uint8)
        ok[: m - s] = (group[: m - s] == group[s:]) & ((side[: m - s] == 0) | (side[: m - s] != side[s:]))
        if not ok.any():
            continue
        found = _near(planes, m, s, _pack(ok[None, :])[0], radius)
        for i in np.flatnonzero(np.unpackbits(found.astype("<u8").view(np.uint8), bitorder="little")[:m]):
            a, b = find(int(rows[i])), find(int(rows[i + s]))
            if a != b:
                root[max(a, b)] = min(a, b)
                made.append((int(rows[i]), int(rows[i + s])))
    out = np.array(made, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, each once) that span the same components as all links."""
    choices = list(combinations(range(len(BLOCKS)), len(BLOCKS) - radius))

    def bits(block: int):
        at, n = BLOCKS[block]
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))

    def key(k: int, choice: tuple[int, ...]):
        value = F.lit(0).cast("long")
        for block in choice:
            value = value * F.lit(1 << BLOCKS[block][1]).cast("long") + bits(block)
        return value + F.lit(k << 40).cast("long")

    dealt = distinct.select("fp", F.explode(F.array(*(key(k, c) for k, c in enumerate(choices)))).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = dealt.join(sizes, "key")
    # a large group is cut into chunks, and every pair of chunks is a group of its own; others are one group
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.when(chunks == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.least(c, F.col("own")) * chunks + F.greatest(c, F.col("own"))))
    met = met.withColumn("own", own).select("key", "fp", "own", chunks.alias("chunks"), F.explode(pairs).alias("pair"))
    side = F.when((F.col("chunks") == 1) | (F.floor(F.col("pair") / F.col("chunks")) == F.col("pair") % F.col("chunks")), 0).when(F.floor(F.col("pair") / F.col("chunks")) == F.col("own"), 1).otherwise(2)
    met = met.select("key", "pair", "fp", side.cast("int").alias("side")).repartition("key", "pair").sortWithinPartitions("key", "pair")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
            new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
            fp = cols[2].view(np.uint64)
            i, j = links(np.cumsum(new), fp, cols[3], radius)
            return pa.RecordBatch.from_arrays([pa.array(cols[2][i]), pa.array(cols[2][j])], ["a", "b"])

        rest: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            held += batch.num_rows
            if held < 1 << 17:
                continue
            cols = [np.concatenate([r[i] for r in rest]) for i in range(4)]
            whole = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))  # the last group may go on
            if len(whole):
                cut = int(whole[-1]) + 1
                yield emit([c[:cut] for c in cols])
                cols = [c[cut:] for c in cols]
            rest, held = [cols], len(cols[0])
        if held:
            yield emit([np.concatenate([r[i] for r in rest]) for i in range(4)])

    return met.mapInArrow(compare, "a long, b long")


def classes_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component, component_id) of each different fingerprint of prints (doc_id, fp): component is the least fingerprint
    that can be reached, component_id the smallest doc_id that has one of them, null if none has an id."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    found = components(edges(classes.select("fp"), radius))
    linked = materialize(classes.join(found, classes["fp"] == found["node"]).select("fp", "component", "least_id"), "linked")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    moved = linked.select("fp", "component").join(least, "component")
    # only classes that are linked to others need more than their own minimum
    alone = classes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("least_id").alias("component_id"))
    return materialize(moved.select("fp", "component", "component_id").unionByName(alone), "components")


def near_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs: component_id is the smallest doc_id whose fingerprint can be reached.

    Null and wordless texts have fingerprint 0 and are linked like any other. Rows without a doc_id take part; a component
    of only such rows has a null component_id. Repeated rows stay, with equal results. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    return join_hot(prints, classes_of(prints, radius), ["fp"]).select("doc_id", "fp", "component_id")


def _row_key(docs: DataFrame) -> DataFrame:
    """docs with r1, r2: hashes of a row's id and text, by which it is told from others."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.col("text").isNull(), F.col("text")]
    return docs.withColumns({"__r1": F.xxhash64(*parts), "__r2": F.xxhash64(F.lit("second"), *parts)})


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, rows without one last, ties to the smaller hash of
    the text. Of rows equal in doc_id and text one stays, the least by a hash of its other columns.

    Rows are told apart by id and text, never by id alone, so texts that share an id are separate documents. Only what must
    go, or is repeated, is looked up for the rows; clashing column names don't matter. An empty table gives no rows.
    """
    keyed = _row_key(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            fps = [_signed(fingerprint(texts[i].as_py())) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.int64())], ["doc_id", "__r1", "__r2", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = materialize(keyed.select("doc_id", "__r1", "__r2", "text").mapInArrow(run, f"doc_id {kind}, __r1 long, __r2 long, fp long"), "fingerprints")
    found = components(edges(materialize(prints.select("fp").distinct(), "classes"), radius)).select(F.col("node").alias("fp"), "component")
    # a fingerprint's own best row first, so that a component never gathers more than its different fingerprints
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__r1", "__r2")
    best = materialize(prints.groupBy("fp").agg(F.min(order).alias("best")).join(found, "fp", "left").select("fp", "best", F.coalesce("component", "fp").alias("component")), "classes")
    keep = best.groupBy("component").agg(F.min("best").alias("keep")).select("keep.__r1", "keep.__r2", F.lit(True).alias("__keep"))
    rows = prints.groupBy("__r1", "__r2").agg(F.count(F.lit(1)).alias("n")).join(keep, ["__r1", "__r2"], "left")
    fate = materialize(rows.filter("__keep is null or n > 1").select("__r1", "__r2", (F.col("__keep").isNotNull()).alias("__one")), "fates")
    named = _row_key(docs)
    single = named.join(fate, ["__r1", "__r2"], "left_anti").drop("__r1", "__r2")
    repeated = named.join(fate.filter("__one"), ["__r1", "__r2"], "left_semi")
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = repeated.groupBy("__r1", "__r2").agg(F.min_by(every, F.xxhash64(F.to_json(every))).alias("row"))
    return single.unionByName(one.select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op9_simhash": op9_simhash}
