"""Suffix-array dedup of byte strings: remove what a long string that starts anywhere else covers.

The suffixes of the corpus are grouped only through WINDOW bytes, by most-significant-digit passes, and a group that is down to
one member is never looked at again; the groups that are left after the last pass are exactly the repeated windows.

A suffix for each byte would not fit, so the first digit is read at anchors: the smallest hash among the GRAM-byte strings
inside a window, the leftmost if equal. Equal windows have equal anchors at equal places, so nothing is lost, and some 1.4 % of
the positions are anchors. An anchor stands for the windows whose smallest hash it is (a range of starts).

Pass 1: the GRAM bytes at the anchor. Groups of one are settled.
Pass 2: all bytes under the anchor's windows, with the anchor's place in them. Members that agree are one class; in a class of
two or more, all windows are repeated.
Pass 3: one member of each class whose group has several classes. Its windows that begin HALF bytes or more before the anchor
hold the same HALF + GRAM bytes, and so do the others; a half whose bytes no other class has is settled.
Pass 4: the windows of the halves that are left, all WINDOW bytes. Windows that two classes share are repeated.

Hashes are two independent 64-bit polynomials. No list of a group is ever built: groups are counted by partial aggregation, and
a class sends one member to the last pass, so a passage with thousands of copies costs as much as one with two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, keyed, materialize, table

WINDOW, GRAM = 200, 32
HALF = (WINDOW - GRAM) // 2
#: Bytes of a text that are hashed at once; positions inside such a part must fit into 24 bits.
PART = 1 << 22
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(k: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of k and of its inverse modulo 2 ** 64, n or more of each."""
    got = _powers.get(int(k))
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        got = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (k, np.uint64(pow(int(k), -1, 1 << 64))))
        _powers[int(k)] = got
    return got


class Hashes:
    """Hashes of all substrings of a byte string, from running sums."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        x = data.astype(np.uint64) + np.uint64(1)
        self.sums, self.back = [], []
        for k in (K1, K2):
            up, down = _power(k, self.n + 1)
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(x * up[: self.n], out=total[1:])
            self.sums.append(total)
            self.back.append(down)

    def of(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        total = self.sums[which]
        return _mix((total[stop] - total[start]) * self.back[which][start])

    def all(self, which: int, width: int) -> np.ndarray:
        total = self.sums[which]
        return _mix((total[width:] - total[:-width]) * self.back[which][: self.n - width + 1])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _parts(n: int, window: int) -> Iterator[tuple[int, int]]:
    """Parts of a text that overlap such that each window lies in one; most texts are one part."""
    at = 0
    while True:
        yield at, min(n, at + PART)
        at += PART - window + 1
        if at + window > n:
            return


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> list[tuple[np.ndarray, ...]]:
    """For each part: anchor positions, first and last start of the windows they stand for, the two digits' hashes, and 32 bits of
    each half's hash."""
    out = []
    if len(data) < window:
        return out
    for at, stop in _parts(len(data), window):
        h = Hashes(data[at:stop])
        g = h.all(0, gram)
        low = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
        width, have = window - gram + 1, 1
        while have < width:  # the smallest of `have` neighbours, doubled
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((first[1:], [len(anchor)])) - 1
        a = anchor[first]
        place = ((a - first) * 1024 + (last - first)).astype(np.uint64)
        half = (window - gram) // 2
        left, right = np.zeros((2, len(a)), np.uint64)
        some = first <= a - half
        left[some] = h.of(0, a[some] - half, a[some] + gram) >> np.uint64(32)
        some = last > a - half
        right[some] = h.of(0, a[some], a[some] + gram + half) >> np.uint64(32)
        halves = (left << np.uint64(32) | right).view(np.int64)
        out.append((a + at, first + at, last + at, g[a].view(np.int64), _mix(h.of(1, first, last + window) + place).view(np.int64), halves))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "first", "last", "a", "g", "r", "halves"]
    for batch in batches:
        k1, k2, texts = batch.columns
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        size = 0

        def flush() -> pa.RecordBatch:
            row, *rest = (np.concatenate(c) for c in cols)
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([k1.take(at), k2.take(at), *map(pa.array, rest)], names)

        for i in range(len(texts)):
            t = texts[i].as_py()
            for a, first, last, *hashes in anchors(np.frombuffer((t or "").encode("utf-8"), np.uint8)):
                for c, v in zip(cols, (np.full(len(a), i), *(x.astype(np.int32) for x in (first, last, a)), *hashes)):
                    c.append(v)
                size += len(a)
            if size > 1 << 17:
                yield flush()
                cols, size = [[] for _ in range(7)], 0
        if size:
            yield flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, list of [first, last]) to the hashes of the windows that start there."""
    for batch in batches:
        k1, k2, texts, ranges = batch.columns
        for i in range(len(texts)):
            data = np.frombuffer(texts[i].as_py().encode("utf-8"), np.uint8)
            want = np.array([(x["first"], x["last"]) for x in ranges[i].as_py()], np.int64)
            for at, stop in _parts(len(data), WINDOW):
                here = want[(want[:, 0] >= at) & (want[:, 1] + WINDOW <= stop)]
                if not len(here):
                    continue
                starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in here]))
                h = Hashes(data[at:stop])
                w = [h.of(k, starts - at, starts - at + WINDOW).view(np.int64) for k in (0, 1)]
                n = len(starts)
                for j in range(0, n, 1 << 16):
                    m = min(n, j + (1 << 16)) - j
                    yield pa.RecordBatch.from_arrays([pa.array([k1[i].as_py()] * m), pa.array([k2[i].as_py()] * m), pa.array(starts[j : j + m].astype(np.int32)), pa.array(w[0][j : j + m]), pa.array(w[1][j : j + m])], ["k1", "k2", "first", "w1", "w2"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, list of [first, stop]) to the counts and the digest of what is kept."""
    for batch in batches:
        ids, texts, ranges = batch.columns
        out = []
        for i in range(len(texts)):
            data = (texts[i].as_py() or "").encode("utf-8")
            kept, at, runs, removed = hashlib.sha256(), 0, 0, 0
            end = -1
            for x in sorted((x["first"], x["stop"]) for x in ranges[i].as_py() or ()):
                if x[0] > end:
                    kept.update(data[at : x[0]])
                    runs, removed = runs + 1, removed + x[1] - x[0]
                elif x[1] > end:
                    removed += x[1] - end
                end = max(end, x[1])
                at = end
            kept.update(data[at:])
            out.append((len(data), removed, runs, kept.hexdigest()))
        cols = list(zip(*out)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(k1, k2, first, stop): byte ranges of each text that repeated windows cover; they may overlap.

    rows: (doc_id, text, k1, k2). Equal texts share a key, and one of them is read for all.
    """
    texts = rows.filter(F.octet_length("text") >= WINDOW)
    at = materialize(texts.select("k1", "k2", "text").mapInArrow(_rows, "k1 long, k2 long, first int, last int, a int, g long, r long, halves long"), "anchors")
    classes = at.groupBy("g", "r").agg(F.count(F.lit(1)).alias("members"))
    groups = classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes"), F.sum("members").alias("total")).filter("total > 1").drop("total")
    open_ = classes.join(groups, "g").filter("members > 1 or classes > 1")
    members = materialize(at.join(open_, ["g", "r"]), "open")
    discard(at)
    # pass 2: every member of a class of two or more
    spans = members.filter("members > 1").select("k1", "k2", "first", (F.col("last") + WINDOW).alias("stop"))
    # pass 3: one member of each class, in halves
    names = ["k1", "k2", "first", "last", "a", "halves"]
    ones = members.filter("classes > 1").groupBy("g", "r").agg(F.min(F.struct(*names)).alias("m")).select("g", "m.*")
    low = F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("halves", 32).alias("h"), F.col("first").alias("s0"), F.least(F.col("last"), F.col("a") - HALF).alias("s1"))
    high = F.struct(F.lit(1).alias("side"), F.col("halves").bitwiseAND(F.lit((1 << 32) - 1).cast("long")).alias("h"), F.greatest(F.col("first"), F.col("a") - HALF + 1).alias("s0"), F.col("last").alias("s1"))
    halves = materialize(ones.select("g", "k1", "k2", F.explode(F.array(low, high)).alias("x")).select("g", "k1", "k2", "x.*").filter("s0 <= s1"), "halves")
    shared = halves.groupBy("g", "side", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    wanted = halves.join(shared, ["g", "side", "h"]).groupBy("k1", "k2").agg(F.collect_list(F.struct(F.col("s0").alias("first"), F.col("s1").alias("last"))).alias("ranges"))
    one_text = texts.groupBy("k1", "k2").agg(F.min(F.xxhash64("doc_id")).alias("k3"))
    # pass 4. Only the texts with windows that are still open move on; each of the steps below lets go of its shuffle files
    by_id = texts.withColumn("k3", F.xxhash64("doc_id"))
    with_text = materialize(by_id.join(one_text.join(wanted, ["k1", "k2"]), ["k1", "k2", "k3"]).select("k1", "k2", "text", "ranges"), "unsettled")
    windows = with_text.mapInArrow(_windows, "k1 long, k2 long, first int, w1 long, w2 long")
    # a text that repeats as a row may be read twice here; all its windows are repeated anyway
    again = materialize(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2"), "again")
    more = materialize(windows.join(again, ["w1", "w2"]).select("k1", "k2", "first", (F.col("first") + WINDOW).alias("stop")), "more")
    for done in (halves, with_text, again):
        discard(done)
    return spans.unionByName(more)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    Null texts are empty. Repeated rows are occurrences like any other: each loses what the other repeats. Texts below WINDOW
    bytes lose nothing. Empty tables give no rows.
    """
    rows = keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(rows).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "stop")).alias("ranges"))
    out = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    return out.mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
