"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Pieces are dealt at random into partitions of bounded size; each partition packs its pieces best-fit decreasing and computes
lower bounds from dual feasible functions. A partition whose bin count equals its bound is certified and done. Partitions with
a gap keep their full bins and give the pieces of all other bins away: these are pooled, dealt anew into fewer partitions and
packed again, until every partition is certified or one partition is left or the rounds are used up.

Tokenizing needs no shuffle; only (id, length) of the pieces below the capacity is dealt out.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from sys import byteorder

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, table

CAPACITY = 1024
END_ID = 2
#: Pieces that one partition packs, about; rounds of exchange at most.
PART_PIECES, ROUNDS = 50_000, 6


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _bytes() -> dict[str, int]:
    """A byte-level vocabulary writes bytes as characters: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Texts to ids, packed as little-endian unsigned 32-bit numbers.

    The tokenizer's vocabulary is run by tiktoken: ids are the ranks of its merges, and the pre-tokenizer's pattern is the
    byte-level one, so the ids are the tokenizer's own (tests compare them) in a quarter of the time. A vocabulary whose merges
    are not in the order of their ids is refused, since tiktoken would merge it otherwise. Texts that spell an added token go
    through the tokenizer itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in json.loads(self.tokenizer.to_str())["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        ranks = {bytes(_bytes()[c] for c in t): i for t, i in vocabulary.items() if i not in added}
        self.encode = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = [t.content for t in added.values()]

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.encode(text)
        return array("I", ids).tobytes() if byteorder == "little" else np.array(ids, "<u4").tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs; the first piece of a long one takes the rest.

    A null text is empty: one piece that holds the end id.
    """
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            texts = batch.column(1)
            for i in range(len(texts)):
                ids = encode(texts[i].as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                stop = n % capacity or min(n, capacity)
                while at < n:
                    rows.append(i)
                    out.append((k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at, stop, k = stop, stop + capacity, k + 1
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by dual feasible functions: the identity, and for each threshold e up to half the
    capacity the one that takes pieces above capacity - e for whole bins and leaves out those below e; and for k up to 10
    the rounding to multiples of 1 / k."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    total = count * x
    best = -(-int(total.sum()) // capacity)
    run = np.concatenate(([0], np.cumsum(total)))
    many = np.concatenate(([0], np.cumsum(count)))
    e = np.arange(1, capacity // 2 + 1)
    whole = many[capacity + 1] - many[capacity - e + 1]
    middle = run[capacity - e + 1] - run[e]
    best = max(best, int((whole * capacity + middle + capacity - 1).max()) // capacity)
    for k in range(1, 11):
        u = np.where((k + 1) * x % capacity == 0, x * k, ((k + 1) * x // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and the space left in each bin."""
    n = len(lengths)
    bins, offsets, left = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit g: a bin with g left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_ >> size
        if fits:
            g = size + (fits & -fits).bit_length() - 1
            b = by_left[g].pop()
            if not by_left[g]:
                open_ &= ~(1 << g)
        else:
            g, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - g
        left[b] = g - size
        if g > size:
            by_left[g - size].append(b)
            open_ |= 1 << (g - size)
    return bins, offsets, np.array(left, np.int64)


def _packer(turn: int, last: bool, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, left = best_fit(lengths, capacity)
        sure = len(left) == lower_bound(lengths, capacity)
        first = pdf["uid"].groupby(bins).min().to_numpy()  # names a bin: even, and different from those closed elsewhere
        closed = np.full(len(pdf), True) if sure or last else left[bins] == 0
        return pd.DataFrame({"uid": pdf["uid"], "length": lengths, "sequence_id": first[bins] * 2, "offset": offsets, "round": np.int32(turn), "certified": sure, "closed": closed})

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces() with sequence_id, offset, round and certified.

    certified: the partition that closed this sequence proved that it used as few as possible; what is open after `rounds` rounds
    of exchange is closed without that proof. Full pieces are sequences of
    their own. Empty tables give no rows; rows without doc_id and repeated rows are packed like any other.
    """
    all_ = materialize(pieces(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = all_.filter(F.col("length") == capacity).select("uid", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("round"), F.lit(True).alias("certified"))
    rest = all_.filter(F.col("length") < capacity).select("uid", "length")
    done = [full]
    n = rest.count()
    for turn in range(1, rounds + 1):
        parts = max(1, -(-n // (PART_PIECES * 2 ** (turn > 1))))
        last = turn == rounds or parts == 1

        dealt = rest.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
        packed = materialize(dealt.groupBy("part").applyInPandas(_packer(turn, last, capacity), "uid long, length long, sequence_id long, offset long, round int, certified boolean, closed boolean"), "packed")
        done.append(packed.filter("closed").select("uid", "sequence_id", "offset", "round", "certified"))
        rest = packed.filter("not closed").select("uid", "length")
        n = rest.count() if not last else 0
        if not n:
            break
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    return all_.join(placed, "uid").drop("uid")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "certified")


ORACLE: dict[str, str] = {}
QUERIES = {"op5_packing": op5_packing}
