"""Language identification by interpolated Kneser-Ney character models, one for each language.

Training counts character n-grams of all orders in Spark, on a bounded sample of labelled rows. Counts below the highest order
are continuation counts. Every n-gram that any language has seen becomes one entry of a table sorted by its 64-bit hash, with
the interpolated log-probability of every language; contexts have a second table with the back-off weights. A text's score for
a language is its cross-entropy for a character; the lowest wins. Entries of the tables are found by a directory on the
hash's upper bits and a short walk, for all characters of a batch at once.

Rejection is calibrated on labelled rows that were not counted: cross-entropies of the right language give a mean and a spread
that shrinks with the text's length, and what is above is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, table

ORDER = 4
#: Labelled rows for each language that training counts, about (the sample's bound), and how many of 8 of them it counts.
SAMPLE, COUNTED_OF_8 = 3000, 7
#: A text is rejected this many standard deviations above the calibrated mean.
LIMIT = 6.0
#: Deviation of a single character's information, in nats; a text of n characters adds SPREAD / sqrt(n).
SPREAD = 2.0
#: Least deviation between texts, in nats: a small calibration sample shows too little of it.
FLOOR = 0.1
CHUNK = 1 << 18
MULT = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalize(text: str) -> np.ndarray:
    """Letters in lower case, each run of anything else one space, with a space at both ends. No letters: empty."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _letters()[raw]
    gap = x == SPACE
    if gap.all():
        return np.zeros(0, np.uint32)
    keep = np.ones(len(x), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    x = x[keep]
    space = np.array([SPACE], np.uint32)
    return np.concatenate((space[: int(x[0] != SPACE)], x, space[: int(x[-1] != SPACE)]))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(x: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of the n characters that end at each position, or at those in at; x is padded with n - 1 zeros at its start."""
    h = np.zeros(len(x) if at is None else len(at), np.uint64)
    padded = np.concatenate((np.zeros(n - 1, np.uint64), x.astype(np.uint64)))
    for k in range(n):
        h = h * MULT + (padded[k : k + len(x)] if at is None else padded[k + at]) + np.uint64(1)
    return _mix(h + np.uint64(n))


class HashTable:
    """Rows under sorted 64-bit hashes. find() gives the row of each hash, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys)).bit_length())
        edges = np.arange((1 << self.bits) + 1, dtype=np.float64)
        top = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(top, edges).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.start[slot], self.start[slot + 1]
        todo = np.flatnonzero(at < stop)
        at, stop, h = at[todo], stop[todo], h[todo]
        while len(todo):
            hit = self.keys[at] == h
            out[todo[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at < stop)
            todo, at, stop, h = todo[on], at[on], stop[on], h[on]
        return out


@dataclass
class Model:
    """langs; for each order the n-grams with log-probabilities, and the contexts with log back-off weights, by language."""

    langs: list[str]
    grams: list[tuple[HashTable, np.ndarray]]
    contexts: list[tuple[HashTable, np.ndarray]]
    unseen: np.ndarray
    mean: np.ndarray | None = None
    floor: np.ndarray | None = None

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """For each position (first axis) and language: log of the character's probability after the ones before it."""
        out = np.zeros((len(x), len(self.langs)), np.float32)
        todo = np.arange(len(x))
        before = np.concatenate((np.zeros(1, np.uint32), x))[:-1]
        for n in range(ORDER, 0, -1):
            grams, logs = self.grams[n - 1]
            row = grams.find(gram_hashes(x, n, None if n == ORDER else todo))
            hit = row >= 0
            out[todo[hit]] += logs[row[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if n > 1:
                contexts, weights = self.contexts[n - 2]
                row = contexts.find(gram_hashes(before, n - 1, todo))
                known = row >= 0
                out[todo[known]] += weights[row[known]]
        out[todo] += self.unseen
        return out

    def cross_entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Nats for a character, by text and language; the texts are normalized and not empty."""
        sums = np.zeros((len(texts), len(self.langs)))
        gap = np.zeros(ORDER, np.uint32)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j]) + ORDER
                j += 1
            if j == i + 1 and len(texts[i]) > CHUNK:  # a very long text in parts, each with the characters before it
                for a in range(0, len(texts[i]), CHUNK):
                    part = texts[i][max(0, a - ORDER) : a + CHUNK]
                    sums[i] += self.log_probs(part)[min(a, ORDER) :].sum(axis=0, dtype=np.float64)
            else:
                logs = self.log_probs(np.concatenate([p for t in texts[i:j] for p in (gap, t)]))
                starts = np.cumsum([0] + [len(t) + ORDER for t in texts[i : j - 1]]) + ORDER
                stops = starts + [len(t) for t in texts[i:j]]
                total = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(logs, axis=0, dtype=np.float64)))
                sums[i:j] = total[stops] - total[starts]
            i = j
        return -sums / np.array([len(t) for t in texts])[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, accepted) of each text; ("und", 0, False) for null texts and those without a letter."""
        norm = [normalize(t) if t else np.zeros(0, np.uint32) for t in texts]
        real = [i for i, x in enumerate(norm) if len(x)]
        out: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(texts)
        if not real or not self.langs:
            return out
        ce = self.cross_entropies([norm[i] for i in real])
        n = np.array([len(norm[i]) for i in real])
        best = ce.argmin(axis=1)
        # the share of the best language if each character were worth its mean information; long texts count as 50 characters
        weight = np.exp(-(ce - ce.min(axis=1, keepdims=True)) * np.minimum(n, 50)[:, None])
        share = (1 / weight.sum(axis=1)).tolist()
        low = ce[np.arange(len(real)), best]
        if self.mean is None:
            accepted = np.ones(len(real), bool)
        else:
            accepted = low <= self.mean[best] + LIMIT * np.sqrt(self.floor[best] ** 2 + SPREAD**2 / n)
        for i, b, s, a in zip(real, best.tolist(), share, accepted.tolist()):
            out[i] = (self.langs[b], min(1.0, max(0.0, s)), a)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, n, hash, context, shorter, last, count): the n-grams of each batch, with their parts' hashes."""
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if len(x := normalize(text.as_py() or "")):
                by_lang.setdefault(lang, []).append(x)
        for lang, xs in by_lang.items():
            i = 0
            while i < len(xs):
                j, size = i, 0
                while j < len(xs) and (j == i or size < 4 * CHUNK):
                    size += len(xs[j])
                    j += 1
                gap = np.zeros(ORDER, np.uint32)
                x = np.concatenate([p for t in xs[i:j] for p in (gap, t)])
                real = x != 0
                before = np.concatenate((gap[:1], x))[:-1]
                h = gram_hashes(x, ORDER)[real]
                _, first, count = np.unique(h, return_index=True, return_counts=True)
                cols = [h[first].view(np.int64), gram_hashes(before, ORDER - 1)[real][first].view(np.int64)]
                cols += [gram_hashes(x, n)[real][first].view(np.int64) for n in range(ORDER - 1, 0, -1)]
                cols += [gram_hashes(before, n)[real][first].view(np.int64) for n in range(ORDER - 2, 0, -1)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), *map(pa.array, cols), pa.array(count.astype(np.int64))], _COUNT_NAMES)
                i = j


#: g4, the 4-gram; c4, its first three characters; g3, g2, g1, the shorter n-grams that end it; c3, c2, what precedes their last.
_COUNT_NAMES = [f"g{ORDER}", f"c{ORDER}"] + [f"g{n}" for n in range(ORDER - 1, 0, -1)] + [f"c{n + 1}" for n in range(ORDER - 2, 0, -1)]
_COUNT_NAMES = ["lang", *_COUNT_NAMES, "n"]
_COUNT_SCHEMA = "lang string, " + ", ".join(f"{c} long" for c in _COUNT_NAMES[1:])


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (doc_id, lang, text); rows without lang or text don't count.

    The sample is what a hash of the row (id, text and place in its partition) selects at the rate sample / rows of the language,
    so about that many rows for each language, also where ids are null or repeated or rows are copies; texts are counted whole.
    Of 8 sampled rows 7 are counted and 1 calibrates the rejection. A language whose sample is too small to calibrate is never
    rejected. No labelled rows give a model without languages, which predicts "und".
    """
    row = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text", row.alias("row"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(1 << 30)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return Model([], [], [], np.zeros(0, np.float32))
    rate = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, sample / n))))
    chosen = rows.filter(F.col("h") < F.try_element_at(rate, F.col("lang")) * (1 << 30)).select("lang", "text", F.pmod(F.xxhash64("row", F.lit("fold")), F.lit(8)).alias("fold"))
    # dealt out row by row, so that copies of a text are no task of their own
    chosen = materialize(chosen.repartition(max(1, min(64, int(sum(min(n, sample) for n in sizes.values())) // 200))), "langid-sample")
    top = chosen.filter(F.col("fold") < COUNTED_OF_8).select("lang", "text").mapInArrow(_count, _COUNT_SCHEMA)
    keys = _COUNT_NAMES[1:-1]
    grams = materialize(top.groupBy("lang", *keys).agg(F.sum("n").alias("n")), "langid-grams")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        return Model([], [], [], np.zeros(0, np.float32))
    lang_at = {lang: k for k, lang in enumerate(langs)}
    # counts by order: of occurrences at the highest, of distinct characters before at the others
    levels, level = [], grams
    for n in range(ORDER, 0, -1):
        ctx = [f"c{n}"] if n > 1 else []
        rows_n = level.select("lang", F.col(f"g{n}").alias("g"), *(F.col(c).alias("c") for c in ctx), *([F.col(f"g{n - 1}").alias("s")] if n > 1 else []), "n")
        levels.append(rows_n.toPandas())  # bounded by the sample
        if n > 1:
            keep = [c for c in keys if int(c[1:]) < n and c != f"c{n}"]
            level = level.groupBy("lang", *keep).agg(F.count(F.lit(1)).alias("n"))
    levels = levels[::-1]
    tables: list[tuple[HashTable, np.ndarray]] = []
    contexts: list[tuple[HashTable, np.ndarray]] = []
    vocabulary = len(np.unique(levels[0]["g"])) + 1
    unseen = np.zeros(len(langs))
    for n, pdf in enumerate(levels, 1):
        k = pdf["lang"].map(lang_at).to_numpy()
        g = pdf["g"].to_numpy().view(np.uint64)
        c = pdf["n"].to_numpy().astype(float)
        union = np.unique(g)
        at = np.searchsorted(union, g)
        own = np.zeros((len(union), len(langs)))
        ones = np.bincount(k[c == 1], minlength=len(langs))
        twos = np.bincount(k[c == 2], minlength=len(langs))
        discount = np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.9)
        if n == 1:
            total = np.bincount(k, weights=c, minlength=len(langs))
            kinds = np.bincount(k, minlength=len(langs))
            back = discount * kinds / total
            unseen = np.log(back / vocabulary)
            own[at, k] = (c - discount[k]) / total[k]
            logs = np.log(own + back / vocabulary)
        else:
            ctx = pdf["c"].to_numpy().view(np.uint64)
            seen = np.unique(ctx)
            ctx_at = np.searchsorted(seen, ctx)
            total = np.zeros((len(seen), len(langs)))
            kinds = np.zeros((len(seen), len(langs)))
            np.add.at(total, (ctx_at, k), c)
            np.add.at(kinds, (ctx_at, k), 1)
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            contexts.append((HashTable(seen), np.log(back).astype(np.float32)))
            own[at, k] = (c - discount[k]) / total[ctx_at, k]
            of = np.zeros(len(union), np.int64)  # the context and the shorter n-gram of each union entry
            short = np.zeros(len(union), np.uint64)
            of[at], short[at] = ctx_at, pdf["s"].to_numpy().view(np.uint64)
            lower = tables[-1][1][tables[-1][0].find(short)]
            logs = np.log(own + back[of] * np.exp(lower))
        tables.append((HashTable(union), logs.astype(np.float32)))
    model = Model(langs, tables, contexts, unseen.astype(np.float32))
    _calibrate(model, chosen.filter(F.col("fold") >= COUNTED_OF_8).select("lang", "text"))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Mean cross-entropy of the right language, the spread of short texts and the floor that long texts keep."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = {lang: k for k, lang in enumerate(m.langs)}
        for batch in batches:
            pairs = [(at[lang], x) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)) if lang in at and len(x := normalize(t.as_py() or ""))]
            if pairs:
                ce = m.cross_entropies([x for _, x in pairs])
                k = [p[0] for p in pairs]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(ce[np.arange(len(k)), k])], ["k", "ce"])

    out = rows.mapInArrow(run, "k int, ce double")
    got = out.groupBy("k").agg(F.avg("ce").alias("mean"), F.stddev_pop("ce").alias("sd"), F.percentile_approx("ce", 0.99).alias("high")).collect()
    n = len(model.langs)
    model.mean, model.floor = np.full(n, np.inf), np.zeros(n)
    for r in got:
        model.mean[r["k"]], model.floor[r["k"]] = r["mean"], max(r["sd"], (r["high"] - r["mean"]) / 2.4, FLOOR)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (doc_id) with lang_pred, score and accepted. Empty tables give no rows; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            got = [p for i in range(0, len(texts), 256) for p in shared.value.predict(texts.slice(i, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], [*keep, "lang_pred", "score", "accepted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out("doc_id")).select("doc_id", "lang", "text"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


ORACLE: dict[str, str] = {}
QUERIES = {"op3_language_id": op3_language_id}
