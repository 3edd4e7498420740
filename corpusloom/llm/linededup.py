"""Line dedup over a suffix array of line sequences, by distributed prefix doubling.

A document is its sequence of lines that hold a word. Lines that occur once end every repeated run, so only the others are
kept from the start: they sort before all repeated lines, by position, which makes the order of suffixes definite without
looking at them again. Round k knows the rank of the first 2 ** k lines of every suffix that still has a twin; the pair of a
suffix's rank and that of the suffix 2 ** k lines further is its key for twice the length. Keys are counted (partial sums
first), those of one suffix settle it, and the others are range-sorted into the next ranks. A group of a round is an interval
of the suffix array whose longest common prefix is 2 ** k lines or more; its first suffix in corpus order is the original, and
each other one marks 2 ** k lines as a later copy. The union of these marks is the later copies of all maximal repeated runs.

Only DataFrame functions. Hot lines are one key of a hash aggregate and of joins that adaptive execution may split; the windows
are over the lines of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, discard, materialize, table

#: A repeated run counts from so many lines on, and a single line from so many words on.
MIN_LINES, MIN_WORDS = 2, 10
_BLANKS = " \t\n\x0b\f\r"
LAST_ID = (1 << 63) - 1


def _units(text: Column) -> Column:
    """A text cut before each line that holds a word (but the first), so that blank lines go with the line before them."""
    return F.split(text, r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])")


def _placed(docs: DataFrame) -> DataFrame:
    """docs, written once, with d, f, u: the place of a row in corpus order, which no other row has. Rows without id come last."""
    taken = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("d", "f", "u") if c in docs.columns})
    d = F.coalesce(F.col("doc_id").try_cast("long"), F.lit(LAST_ID))
    return materialize(taken.withColumns({"d": d, "f": F.xxhash64("text"), "u": F.monotonically_increasing_id()}), "line-rows")


def lines(placed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, f, u, i, h1, h2, long_line) for each line with a word; h1 and h2 hash the line without white space around it."""
    out = placed.select("d", "f", "u", F.posexplode(_units(F.col("text"))).alias("i", "unit"))
    out = out.withColumn("line", F.btrim("unit", F.lit(_BLANKS))).filter("line <> ''")
    long_line = F.regexp_count("line", F.lit(f"{WORD}+")) >= min_words
    return out.select("d", "f", "u", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), long_line.alias("long_line"))


def _ranked(groups: DataFrame, by: list[str], name: str) -> DataFrame:
    """The groups of two or more with a rank that follows the order of the key; the range sort is written once."""
    return materialize(groups.filter("n > 1").drop("n").orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def later_copies(sequence: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(u, i, reach, level): for each repeated line, how many lines from it on are a later copy (0: none), and the last
    round in which its suffix had a twin.

    If min_lines is no power of two, the round of the greatest one below it also counts the windows of min_lines lines: the
    ranks of a window's first and last 2 ** k lines, which overlap, are its key.
    """
    place = F.struct("d", "f", "u", "i")
    first = _ranked(sequence.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin")), ["h1", "h2"], "line-ranks")
    later = place != F.col("origin")
    reach = F.when(F.col("long_line") & later if min_lines > 1 else later, 1).otherwise(0)
    active = materialize(sequence.join(first, ["h1", "h2"]).select("d", "f", "u", "i", "rank", reach.alias("reach")), "line-suffixes")
    settled, level, read = [], 0, [first, active]
    while not active.isEmpty():
        step = 1 << level
        ahead = Window.partitionBy("u").orderBy("i").rangeBetween(step, step)
        pairs = active.withColumn("next", F.first("rank").over(ahead))
        least = step < min_lines < 2 * step
        if least:
            end = Window.partitionBy("u").orderBy("i").rangeBetween(min_lines - step, min_lines - step)
            pairs = active.withColumns({"next": F.first("rank").over(ahead), "end": F.first("rank").over(end)})
            windows = pairs.filter("end is not null").groupBy(F.col("rank").alias("from"), F.col("end").alias("to")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("source"))
            windows = materialize(windows.filter("n > 1").drop("n"), "line-windows")
            pairs = pairs.join(windows, (F.col("rank") == F.col("from")) & (F.col("end") == F.col("to")), "left").drop("end", "from", "to")
            pairs = materialize(pairs.withColumn("reach", F.when(place != F.col("source"), min_lines).otherwise(F.col("reach"))).drop("source"), "line-pairs")
            read += [windows, pairs]
        groups = pairs.filter("next is not null").groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin"))
        ranks = _ranked(groups.withColumnRenamed("rank", "head"), ["head", "next"], "line-ranks")
        joined = pairs.join(ranks.withColumnRenamed("next", "tail"), (F.col("head") == pairs["rank"]) & (F.col("tail") == F.col("next")), "left")
        copy = ranks["rank"].isNotNull() & later & F.lit(2 * step >= min_lines)
        reach = F.when(copy, 2 * step).otherwise(F.col("reach")).alias("reach")
        done = materialize(joined.select("d", "f", "u", "i", ranks["rank"].alias("rank"), reach), "line-suffixes")
        settled.append(done.filter("rank is null").select("u", "i", "reach", F.lit(level).alias("level")))
        for table_ in [*read, ranks]:
            discard(table_)
        active, level, read = done.filter("rank is not null"), level + 1, []
    if not settled:
        return active.select("u", "i", "reach", F.lit(0).alias("level"))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def removed_runs(placed: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(u, runs): the maximal runs of lines to delete from a row, in order, as structs of the first and last line's number."""
    sequence = materialize(lines(placed, min_words), "lines")
    marks = later_copies(sequence, min_lines)
    discard(sequence)  # its readers are written
    document = Window.partitionBy("u").orderBy("i")
    covered = marks.withColumn("stop", F.max(F.col("i") + F.col("reach")).over(document)).filter("stop > i").select("u", "i")
    islands = covered.withColumn("island", F.col("i") - F.row_number().over(document)).groupBy("u", "island").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    return islands.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _between(units: Column, runs: Column) -> Column:
    """The lines that no run holds: the slices between neighbouring runs, so that the work grows with the text alone."""
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["last"] + 1)
    stop = lambda k: F.coalesce(F.get(runs, k)["first"], F.size(units))
    gaps = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda k: F.slice(units, start(k) + 1, stop(k) - start(k)))
    return F.flatten(gaps)


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, report: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs of lines deleted from text.

    A run counts from min_lines lines on, or as a single line of min_words words or more (1: every line with a word). Corpus
    order is doc_id, then the text's hash, then the row, then the line; the first copy stays. Each row is a document of its own,
    whatever its id, so of rows equal in every column one keeps its text and the others lose what counts as a run. Ids that are
    null or no number come last. Lines are compared without white space around them; lines without a word never count, and go
    with the line before them. A text that loses all its lines becomes empty; null texts stay null. An empty table gives no
    rows; columns d, f and u of docs stay as they are.

    report: columns n_lines, n_removed and n_runs are added.
    """
    if min_lines < 1:
        raise ValueError(f"min_lines must be 1 or more, not {min_lines}")
    placed = _placed(docs)
    runs = removed_runs(placed, min_lines, min_words).withColumnRenamed("u", "__u").withColumnRenamed("runs", "__runs")
    rows = placed.join(runs, F.col("u") == F.col("__u"), "left").withColumn("__units", _units(F.col("text")))
    kept = F.concat_ws("\n", _between(F.col("__units"), F.col("__runs")))
    rows = rows.withColumn("text", F.when(F.col("__runs").isNull(), F.col("text")).otherwise(kept))
    back = [F.col(f"__own_{c}" if c in ("d", "f", "u") else f"`{c}`").alias(c) for c in docs.columns]
    if not report:
        return rows.select(*back)
    n = F.size(F.filter("__units", lambda u: u.rlike(WORD)))
    removed = F.aggregate("__runs", F.lit(0), lambda a, x: a + x["last"] - x["first"] + 1)
    return rows.select(
        *back,
        F.when(F.col("__units").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("__runs"), F.lit(0)).cast("long").alias("n_runs"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.char_length("text").cast("long").alias("n_kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op7_line_dedup": r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS id, regexp_matches(line, '[^\x20\x09-\x0D]') AS real FROM raw),
u AS (SELECT *, sum(real::INT) OVER (PARTITION BY doc_id ORDER BY k) AS j FROM l),
s AS (SELECT doc_id, j, id, lead(id) OVER (PARTITION BY doc_id ORDER BY j) AS nxt, len(list_filter(string_split_regex(id, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM u WHERE real),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id, j) AS one, row_number() OVER (PARTITION BY id, nxt ORDER BY doc_id, j) AS two FROM s),
g AS (SELECT doc_id, j, (one > 1 AND n >= 10) OR (nxt IS NOT NULL AND two > 1) OR coalesce(lag(nxt IS NOT NULL AND two > 1) OVER (PARTITION BY doc_id ORDER BY j), false) AS gone FROM r),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS starts FROM g),
c AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed, sum(starts::INT) AS n_runs FROM h GROUP BY doc_id),
t AS (SELECT u.doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT coalesce(gone, false)), '') AS kept FROM u LEFT JOIN h ON u.doc_id = h.doc_id AND u.j = h.j GROUP BY u.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
       CAST(length(kept) AS BIGINT) AS n_kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
QUERIES = {"op7_line_dedup": op7_line_dedup}
