"""Quality rules: a ledger that holds a bit for each failed rule and the measurements behind it.

Every rule is evaluated once a document. Policies are sets of rules under a version; a policy keeps a document when none of
its bits is set. Ablations (what a policy would keep without one rule) come from the counts of bit patterns, of which there
are at most 2 ** rules, and never touch the texts again. Everything is DataFrame functions; a document is one row throughout,
so there is no shuffle before the ablation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, WS, table, words

WINDOW = 8
#: Rules in the order of their bits; each is true where the document fails.
RULES: dict[str, str] = {
    "too_short": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "few_distinct_words": "100 * n_distinct_words < 20 * n_words",
    "upper_case": "2 * n_upper > word_chars",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
#: Fixed versions of policies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeated_words"),
    "v1": tuple(RULES),
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements that the rules read.

    Null texts count as empty; an empty text has zero in all measurements. Equal lines are counted after the first, lines
    without a word never. n_repeat_words compares windows by a 64-bit hash within one document. Columns of docs that bear the
    name of a measurement are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__words", words(F.col(text))).withColumn("n_words", F.size("__words").cast("long"))
    at = F.sequence(F.lit(0), F.size("__words") - WINDOW)
    w = F.col("__words")
    out = out.withColumn("__hashes", F.when(F.size("__words") >= WINDOW, F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>")))
    # most documents repeat no window: only the others are sorted
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    out = out.withColumn("__at", F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i + 1) | F.when(i > 0, same(x, i - 1)).otherwise(False)), lambda x: x["i"])))
    a = F.col("__at")
    covered = F.aggregate(F.transform(a, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(a, k + 1) - p), F.lit(WINDOW))), F.lit(0), lambda x, y: x + y)
    out = out.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    return out.withColumns({
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(WS))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_distinct_words": F.size(F.array_distinct("__words")).cast("long"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
    }).drop("__words", "__hashes", "__sorted", "__at", "__lines")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and fail_bits (long): bit k is set where the k-th rule of RULES fails."""
    bits = [F.when(F.coalesce(F.expr(rule), F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    return measure(docs, text).withColumn("fail_bits", sum(bits[1:], bits[0]))


def mask(policy: str) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in POLICIES[policy])


def passes(policy: str) -> Column:
    """Whether a row of a ledger passes all rules of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy would keep without it.

    Counts of bit patterns come first (partial sums before the shuffle); the rules are then laid over those few rows.
    """
    m = F.lit(mask(policy)).cast("long")
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(m).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in enumerate(RULES) if name in POLICIES[policy])))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return patterns.select("bits", "n", rules.alias("r")).groupBy("r.rule").agg(
        count(failed).alias("n_failed"), count(failed & (rest == 0)).alias("n_failed_alone"), count(rest == 0).alias("n_kept_without"), count(F.col("bits") == 0).alias("n_kept")
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), (passes("base") & passes("v1")).alias("kept"), "n_lines", "n_distinct_words", "n_upper", "fail_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v1")


_LEDGER_SQL = r"""
w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT r, i, array_to_string(ws[i + 1:i + 8], ' ') AS k FROM (SELECT r, ws, unnest(range(0, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM d, (SELECT unnest(range(0, 8)) AS j) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct_words,
         CAST(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN c USING (r)),
l AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
       + 16 * (100 * n_distinct_words < 20 * n_words)::INT + 32 * (2 * n_upper > word_chars)::INT + 64 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT AS BIGINT) AS fail_bits
  FROM m)
"""
ORACLE = {
    "op1_quality_rules": f"WITH {_LEDGER_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_distinct_words, n_upper, fail_bits FROM l",
    "quality_ablation": f"""WITH {_LEDGER_SQL},
r AS (SELECT * FROM (VALUES ('too_short', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('few_distinct_words', 16), ('upper_case', 32), ('word_length', 64)) AS v(rule, bit))
SELECT rule, CAST(count(*) FILTER (fail_bits & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (fail_bits = bit) AS BIGINT) AS n_failed_alone,
       CAST(count(*) FILTER (fail_bits & ~bit = 0) AS BIGINT) AS n_kept_without, CAST(count(*) FILTER (fail_bits = 0) AS BIGINT) AS n_kept
FROM l, r GROUP BY rule""",
}
QUERIES = {"op1_quality_rules": op1_quality_rules, "quality_ablation": quality_ablation}
