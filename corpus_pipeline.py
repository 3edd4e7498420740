"""A training corpus from raw documents, in five stages; each calls one operator and works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, linededup, mixing, packing, simhash
from corpusloom.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept, with lang as predicted. Training leaves out the held-out quarter of ids.

    Null texts and those without a letter have no language and go. Repeated rows are judged alike and stay; null ids, sources
    and languages don't matter. An empty table, or one without labelled rows, gives no rows.
    """
    model = langid.train(docs.filter(~langid.held_out("doc_id")).select("doc_id", "lang", "text"))
    out = langid.predict(docs, model, docs.columns).filter("accepted")
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; documents stay, with what is left of their text (nothing, for later copies of
    whole texts; null texts stay null). Each row is a document of its own. An empty table gives no rows."""
    out = linededup.dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, of rows without an id the least by text.

    Null and wordless texts are one group, of which one stays. Texts that share an id are separate documents; of repeated rows
    one stays. An empty table gives no rows.

    What is near is op9's contract (shingles of 3 words, 3 of 64 bits), not a five-word similarity of 0.8: of 1000 planted pairs
    at that similarity 38 are found.
    """
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix begins to take it, whole, in the order of the curriculum; those not taken go.

    A last copy that the mix takes less than half of is left out, so that no text is cut. Texts without a word are never taken.
    Each row is a document of its own, whatever its id; an empty table gives no rows.
    """
    key = ["__r1", "__r2"]  # hashes of all columns: rows that share them are the same in every way, and one stands for all
    every = [F.struct(*(F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in docs.columns))]
    named = docs.withColumns({"__r1": F.xxhash64(*every), "__r2": F.xxhash64(F.lit("second"), *every)})
    plan = materialize(mixing.mix(named, keep=key), "mix-plan")
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    wanted = plan.select("row", *key, copies.alias("__copies")).filter("__copies > 0")
    places = mixing.schedule(plan).select("row", "copy", F.col("place").alias("__place"))
    taken = places.join(wanted, "row").filter("copy < __copies").groupBy("row", *key).agg(F.collect_list("__place").alias("__places"))  # two at most
    repeated = plan.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    texts = named.join(repeated, key, "left_anti").unionByName(named.join(repeated, key, "left_semi").dropDuplicates(key))
    # written before the copies are sorted, so that the join's shuffle files can go
    placed = materialize(texts.join(taken, key).drop("row", *key), "mix-placed")
    return placed.withColumn("__place", F.explode("__places")).orderBy("__place").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences. A null text is empty: one piece with the end id. Repeated rows are packed like
    any other; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Language models and tokenizers are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
