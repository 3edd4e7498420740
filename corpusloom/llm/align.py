"""Alignment of two tokenizers' tokens over the bytes of a text, by pointer jumping.

The tokens of many texts are laid out one after another, so that a step is one vectorised operation over all of them. Every token
points to its farthest-right overlapping token; doubling the successors takes each token to the last token of its component, which
labels its group. A place where tokens of both sides end is the end of a group, and of nothing that overlaps it.

Each document's linked id pairs are written once, with how often they occur in it. Their counts over all documents are summed
by Spark and joined to these rows: broadcast if there are at most BROADCAST_ROWS pairs, and else shuffled, with hot pairs in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import packing
from corpusloom.llm.common import discard, join_hot, materialize, table

#: Characters of the texts that one vectorised step takes, about; id pairs that are broadcast at most (some 40 bytes each).
STEP, BROADCAST_ROWS = 1 << 18, 1 << 21


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Two tokenizers, the bytes of their ids, and the ids as text with what follows them in a list of groups."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        byte_level = packing.encoder(path_a)
        self.encode_a = byte_level.encode
        letters = packing._bytes()
        vocabulary = {i: bytes(letters[c] for c in t) for t, i in byte_level.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        self.a = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        ids = range(self.pieces.get_piece_size())
        self.b = [bytes([int(p[3:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in [self.pieces.id_to_piece(i)]]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.a, self.b))
        self.said = [np.array([f"{i}{end}" for i in range(n)], object) for n, end in ((len(self.a), ","), (len(self.a), "|"), (len(self.b), ","), (len(self.b), ";"))]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides for each text; none where either side's bytes differ from a space and the text."""
        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1)):
            want, a = b" " + text.encode(), self.encode_a(" " + text)
            same = text and b"".join([self.a[i] for i in a]) == want == b"".join([self.b[i] for i in b])
            out.append((a, b) if same else ([], []))
        return out


@lru_cache(2)
def pair(path_a: str, path_b: str) -> Pair:
    """One for each Python worker."""
    return Pair(path_a, path_b)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, numbered from the left; ends_*: where tokens end, the last at the same byte."""
    n, m = len(ends_a), len(ends_b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    right_b = np.searchsorted(starts_b, ends_a, "left") - 1  # of each token of a, the last token of b that begins before its end
    right_a = np.searchsorted(starts_a, ends_b, "left") - 1
    # where both end together, b's token is the terminal of both
    to = np.concatenate((n + right_b, np.where(ends_a[right_a] > ends_b, right_a, n + np.arange(m))))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    last = np.flatnonzero(to[n:] == n + np.arange(m)) + n
    return np.searchsorted(last, to[:n]), np.searchsorted(last, to[n:])


def align(tokens: list[tuple[list[int], list[int]]], of: Pair) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of texts with tokens: their n_a, n_b, n_groups and n_links as rows; groups_sha256; rows (text, a, b, times) of their
    different linked pairs; and how many of these each text has."""
    n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for t in tokens for i in t[k]), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
    ends_a, ends_b = np.cumsum(of.size_a[a]), np.cumsum(of.size_b[b])
    group_a, group_b = groups(ends_a, ends_b)
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    text_end = ends_a[stop_a - 1]  # texts follow one another, and both sides of each have the same bytes
    n_groups = np.diff(np.concatenate(([0], group_a[stop_a - 1] + 1)))
    ends = np.union1d(ends_a, ends_b)  # each stretch between two ends lies in one token of either side: one link
    text = np.searchsorted(text_end, ends, "left")
    n_links = np.bincount(text, minlength=len(tokens))
    wide_a, wide_b = len(of.a), len(of.b)
    code, times = np.unique((text * wide_a + a[np.searchsorted(ends_a, ends, "left")]) * wide_b + b[np.searchsorted(ends_b, ends, "left")], return_counts=True)
    links = np.stack((code // wide_b // wide_a, code // wide_b % wide_a, code % wide_b, times), axis=1)
    # the lists of groups: a's tokens of a group come after all tokens of those before it, b's after a's
    total = int(group_a[-1]) + 1
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=total))))
    upto_a = np.cumsum(np.bincount(group_a, minlength=total))
    said = np.empty(len(a) + len(b), object)
    for ids, group, at, more, end in ((a, group_a, np.arange(len(a)) + before_b[group_a], of.said[0], of.said[1]), (b, group_b, np.arange(len(b)) + upto_a[group_b], of.said[2], of.said[3])):
        last = np.append(group[1:] != group[:-1], True)
        said[at] = np.where(last, end[ids], more[ids])
    stop, shas = stop_a + stop_b, []
    for low, high in zip([0, *stop[:-1].tolist()], stop.tolist()):
        shas.append(hashlib.sha256("".join(said[low:high].tolist())[:-1].encode()).hexdigest())
    return np.stack((n_a, n_b, n_groups, n_links), axis=1), shas, links, np.bincount(links[:, 0], minlength=len(tokens))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs array<struct<a, b, n>> of each row of docs."""
    path_a, path_b = path_a or packing.tokenizer_path(), path_b or piece_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pair(path_a, path_b)
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                texts, held = [], 0
                while low + len(texts) < batch.num_rows and held < STEP:
                    texts.append(batch.column(1)[low + len(texts)].as_py() or "")
                    held += len(texts[-1])
                yield rows(batch.column(0).slice(low, len(texts)), of.encode(texts), of)
                low += len(texts)

    def rows(ids: pa.Array, tokens: list[tuple[list[int], list[int]]], of: Pair) -> pa.RecordBatch:
        full = [i for i, t in enumerate(tokens) if t[0]]
        counts, shas, sizes, links = np.zeros((len(tokens), 4), np.int64), [""] * len(tokens), np.zeros(len(tokens), np.int64), np.zeros((0, 4), np.int64)
        if full:
            counts[full], found, links, sizes[full] = align([tokens[i] for i in full], of)
            for i, sha in zip(full, found):
                shas[i] = sha
        each = pa.StructArray.from_arrays([pa.array(links[:, c].astype(np.int32)) for c in (1, 2, 3)], ["a", "b", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), each)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(counts[:, c]) for c in range(4)), pa.array(shas), lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a int, b int, n int>>")


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs.

    Null and empty texts, and those whose tokens' bytes are not a space and the text, have no tokens: zeros, and an empty
    groups_sha256. Repeated rows are documents of their own, in the counts too; ids are of any type, and may be null. Extra
    columns don't matter. An empty table gives no rows.
    """
    all_ = materialize(aligned(docs, path_a, path_b).withColumn("uid", F.monotonically_increasing_id()), "aligned")
    each = all_.select("uid", F.explode("pairs").alias("p"))
    code = F.shiftleft(F.col("p.a").cast("long"), 32).bitwiseOR(F.col("p.b").cast("long"))
    links = each.select("uid", code.alias("code"), F.col("p.n").alias("n"))
    counts = materialize(links.groupBy("code").agg(F.count(F.lit(1)).alias("count")), "counts")
    highest = counts.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("count").alias("highest"))  # a row for each id at most
    facts = counts.withColumn("a", F.shiftright("code", 32)).join(highest, "a").select("code", "count", (F.col("count") == F.col("highest")).alias("best"))
    met = links.join(F.broadcast(facts), "code") if counts.count() <= broadcast_rows else join_hot(links, facts, ["code"], "inner")
    sums = met.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("n")).alias("count_sum"))
    sums = materialize(sums, "sums")
    discard(counts)
    out = all_.drop("pairs").join(sums, "uid", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op12_alignment": op12_alignment}
