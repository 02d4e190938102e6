"""The corpus pipeline: each stage reads what the stage before it kept, and its decisions take effect.

Cases: null texts count as empty throughout; rows with a null id are kept and judged like others; rows with equal id and
text are one document to the line and near-duplicate stages, of which the latter keeps one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import best_fit_packing, decontaminate, line_dedup, simhash, toxicity
from tessera.llm.common import Stash, bounded, read_table, spare


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def narrow(spark: SparkSession) -> None:
    """Whole texts are wide rows: Arrow batches of 2,000 of them, unless the session names a number of its own."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    narrow(spark)
    found = toxicity.toxicity(docs, read_table(spark, sf_dir, "labels"))
    return found.filter(~F.col("_rejected")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of two lines or more, and later repeated lines of 50 words or more, go; n_chars follows the text. A
    document may become empty."""
    narrow(spark)
    left = line_dedup.line_dedup(docs, alone=50)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays; of rows with
    that id and the same text one stays. All texts without words are one group."""
    narrow(spark)
    found = Stash(spark).put(simhash.near_duplicates(docs), "near")
    digest, of, name = F.sha2(F.coalesce("text", F.lit("")), 256), spare(docs, "of"), spare(docs, "name")
    each = found.groupBy(F.col("doc_id").alias(of), F.col("digest").alias(name)).agg(F.min("component_id").alias("keep"), F.count("*").alias("n"))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (digest == F.col(name))
    gone = each.filter(~F.col(of).eqNullSafe(F.col("keep"))).select(of, name)
    again = each.filter(F.col(of).eqNullSafe(F.col("keep")) & (F.col("n") > 1)).select(of, name)  # rows that are there more than once
    once = docs.join(bounded(gone.union(again)), same, "left_anti")
    return once.union(docs.join(bounded(again), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    narrow(spark)
    found = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("_hits") == 0).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each sequence: its length, the documents' pieces in order and their bytes, each document ended by 0xFF."""
    return best_fit_packing.bins(best_fit_packing.best_fit_packing(best_fit_packing.byte_tokens(docs), tokens="tokens"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stash = read_table(spark, sf_dir, "documents"), Stash(spark)
    for name, stage in STAGES[:-1]:
        docs = stash.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
