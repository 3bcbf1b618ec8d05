"""A cleaned and packed corpus: toxicity, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes all that its predecessor kept, as ``(spark, docs, sf_dir)``, and returns a DataFrame that is stored
in the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from driftwatch.llm.common import store
from driftwatch.llm.queries import table, vocabulary

#: A document's columns; all stages but the last return them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go. It learns from ``labels`` and the documents of this stage."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.5").select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents hold stay only in the last of them. A document that loses
    all its lines stays with an empty text; ``n_chars`` is counted anew."""
    kept = line_dedup.drop_repeated_lines(docs)
    counted = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", counted).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Rows without an id stay. Where rows repeat an id, one of them stays: the smallest text.
    """
    found = store(jaccard_join.near_duplicates(docs), "near-duplicates")
    gone = found.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    if found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = kept.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", *[f"r.{c}" for c in rest])
    return one.unionByName(kept.filter("doc_id IS NULL"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers, names and units, go."""
    return decontaminate.clean(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, in sequences of at most 2048."""
    pieces = packing.pack(docs, vocabulary())
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset", "loss_tokens"
    )


STAGES = [
    ("toxicity", toxic), ("line dedup", repeated_lines), ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks), ("packing", packed),
]

#: The stages learn, hash and tokenise in ways SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
