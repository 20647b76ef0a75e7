"""A corpus pipeline over the table `documents`: identify languages, drop repeated lines, keep one of
each group of near duplicates, drop benchmark passages, pack into training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `documents`.  Null texts are treated as empty.  Rows without an id are documents like others; of
near duplicates they stay only where no duplicate has an id.  A document whose lines are all dropped
stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartaspark.llm import decontaminate, jaccard, langid, linededup, packing
from cartaspark.llm.queries import CAPACITY, language_model, table, vocabulary
from cartaspark.llm.shared import BATCH, Scratch, free_name

#: Least share of a text's n-grams that its language must know.
MIN_LANGUAGE_SCORE = 0.4
#: Rows of an Arrow batch in this application's session: whole texts are wide.
BATCH_ROWS = "2000"
#: Bytes of text that a task encodes at once: executors also hold what other stages left.
TEXT_BYTES = 2 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those that are hardly in any learned language."""
    spark.conf.set(BATCH, BATCH_ROWS)
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.identify(docs, language_model(docs), carry=True, names=names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that ten or more documents hold; n_chars follows the text."""
    spark.conf.set(BATCH, BATCH_ROWS)
    cleaned = linededup.dedup_lines(docs, min_docs=10, min_chars=1)
    n_chars = F.length("text").cast("long")
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, n_chars).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    spark.conf.set(BATCH, BATCH_ROWS)
    return jaccard.keep_one_each(docs, k=5, threshold=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    spark.conf.set(BATCH, BATCH_ROWS)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of training sequences; see cartaspark.llm.packing."""
    spark.conf.set(BATCH, BATCH_ROWS)
    return packing.pack(docs, vocabulary(), CAPACITY, 0, TEXT_BYTES)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the trained language filters and the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; what each stage returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
