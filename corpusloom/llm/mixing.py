"""Mixing sources to target weights along a curriculum.

Targets are a water filling over sources. Each source has a weight schedule over training time 0..1; its integral is the
source's cumulative token demand F(t), scaled to reach the target at t = 1. Documents of a source stand in a fixed order (MD5
of the id); the copy that begins after c words of that source is wanted at the position t with F(t) = c, the inverse of the
demand. All copies are range-sorted by position and numbered.

Running totals are taken over range sorts in two levels (`running`): a source with a third of all rows, or a null id that many
rows share, is spread over many partitions. Texts are read once, for their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, join_hot, materialize, running, table

#: By the rank of the source: weight, and slope of its schedule (share at the end less share at the start, halved).
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, slope from (source, source_size).

    The targets sum to share times all sizes, in proportion to the weights, none above most times its source's size: a source
    is capped when its size for a unit of weight is below the water level. Sources rank by code point, null last. Sources of
    size 0 get the target 0.
    """
    by = F.col("source").asc_nulls_last()
    ranked = running(sizes.select("source", "source_size"), [by], {"rank": F.lit(1)}, "mix-rank")
    k = (F.col("rank") % len(weights)).cast("int")
    pick = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), k + 1)
    ranked = ranked.withColumns({"weight": pick(weights), "slope": pick(slopes)}).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    total = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    if not total["s"]:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"), "slope")
    filled = running(ranked, [F.col("cap") / F.col("weight"), by], {"capped": F.col("cap"), "spent": F.col("weight")}, "mix-level")
    level = (F.lit(share * total["s"]) - F.col("capped")) / (F.lit(float(total["w"])) - F.col("spent"))
    filled = filled.withColumn("level", level)
    first = filled.filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", "spent").alias("level")).first()["level"]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"), "slope")


def mix(docs: DataFrame, size: Column | None = None, keep: list[str] = (), **options) -> DataFrame:
    """key, row, doc_id, size, source_size, target, taken and positions (0 to 1, one for each copy begun) of each row of docs.

    Every document of a source is taken whole times (target // source size), and then the first documents in MD5 order once
    more until the target is met; the last of these may be taken in part, so that the taken words are the target, rounded.
    Null texts have size 0, are never taken and have no position. Repeated rows are documents of their own (row tells them
    apart); ties in id are broken by size, then by row. An empty table gives an empty result; of other columns of docs only those
    of keep are read, and returned too.
    """
    if options.get("most", 2.0) > 2:
        raise ValueError("two copies of a document have positions: most must be 2 or less")
    words = n_words(F.col("text")) if size is None else size
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_name"), words.alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"), *keep)
    rows = materialize(named, "mix-rows")
    name = F.when(~F.col("no_name"), F.col("name"))
    goal = targets(rows.groupBy(name.alias("source")).agg(F.sum("size").alias("source_size")), **options)
    goal = goal.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_name"), "source_size", "target", "slope")
    order = [F.col(c) for c in ("no_name", "name", "key", "doc_id", "size", "row")]
    total = materialize(running(rows, order, {"before": F.col("size")}, "mix-order"), "mix-totals")
    starts = total.groupBy("name", "no_name").agg(F.min("before").alias("start"))
    out = join_hot(total, goal.join(starts, ["name", "no_name"]), ["name", "no_name"], "inner")
    begun = F.col("before") - F.col("start")
    goal_words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), goal_words - whole * F.col("source_size") - begun))
    taken = (whole * F.col("size") + part).cast("long")
    # the schedule's share at t is target * (1 - slope + 2 * slope * t); its integral (1 - slope) * t + slope * t * t is inverted
    a, u = F.col("slope"), lambda c: c / F.col("target")
    position = lambda c: F.when(a == 0, u(c)).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * u(c)) - (1 - a)) / (2 * a))
    copies = F.when(F.col("size") > 0, F.ceil(taken / F.col("size"))).otherwise(0).cast("int")
    at = lambda k: F.when(copies > k, F.lit(0.0) + position(begun + F.lit(k) * F.col("source_size")))
    return out.select("row", "doc_id", "size", "source_size", "target", taken.alias("taken"), at(0).alias("first_position"), at(1).alias("second_position"), "key", *keep)


def schedule(plan: DataFrame) -> DataFrame:
    """row, copy (0, 1), position and place of every copy that mix() begins: places number all copies from 0 in the order of
    position, MD5 of the id, size and row, which is also how the result is range-partitioned."""
    points = F.array(F.struct(F.lit(0).alias("copy"), F.col("first_position").alias("position")), F.struct(F.lit(1).alias("copy"), F.col("second_position").alias("position")))
    each = plan.select("row", "key", "size", F.explode(points).alias("c")).select("row", "key", "size", "c.*").filter("position is not null")
    order = [F.col(c) for c in ("position", "key", "size", "row")]
    return running(each, order, {"place": F.lit(1)}, "mix-places").select("row", "copy", "position", F.col("place").cast("long").alias("place"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = materialize(mix(table(spark, sf_dir, "documents")), "mix-plan")
    place = lambda k: F.max(F.when(F.col("copy") == k, F.col("place")))
    places = schedule(plan).groupBy("row").agg(place(0).alias("first_place"), place(1).alias("second_place"))
    out = plan.join(places, "row", "left")
    at = lambda c: F.round(c, 6).alias(c)
    return out.select("doc_id", "size", "source_size", "target", "taken", at("first_position"), at("second_position"), "first_place", "second_place")


ORACLE = {
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, CASE k WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, slope, least(cap, weight * (SELECT level FROM o WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1)) AS target FROM o),
c AS (
  SELECT doc_id, key, size, source_size, target, slope, CAST(round(target) AS BIGINT) AS goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (goal // source_size) * size + greatest(0, least(size, goal - (goal // source_size) * source_size - begun)) AS taken FROM c),
p AS (SELECT *, CASE WHEN size > 0 THEN ceil(taken / size) ELSE 0 END AS copies, begun / target AS u, (begun + source_size) / target AS v FROM k),
x AS (SELECT *, CASE WHEN copies > 0 THEN 0.0::DOUBLE + CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END END AS p1,
             CASE WHEN copies > 1 THEN 0.0::DOUBLE + CASE WHEN slope = 0 THEN v ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * v) - (1 - slope)) / (2 * slope) END END AS p2 FROM p),
n AS (SELECT doc_id, k, row_number() OVER (ORDER BY pos, key, size) - 1 AS place FROM (SELECT doc_id, key, size, 1 AS k, p1 AS pos FROM x UNION ALL SELECT doc_id, key, size, 2, p2 FROM x) WHERE pos IS NOT NULL),
m AS (SELECT doc_id, max(place) FILTER (k = 1) AS first_place, max(place) FILTER (k = 2) AS second_place FROM n GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, round(p1, 6) AS first_position, round(p2, 6) AS second_position, CAST(first_place AS BIGINT) AS first_place, CAST(second_place AS BIGINT) AS second_place
FROM x LEFT JOIN m USING (doc_id)"""
}
QUERIES = {"op6_mixing": op6_mixing}
