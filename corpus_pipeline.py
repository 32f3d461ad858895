"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes the documents that the one before it kept, and its decisions take effect. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, langid, line_dedup, packing, simhash
from tallyweave.llm.shared import scratch_path, small_batches, table, text_mark, told_apart, without

#: No SQL: the first, third and last stage need trained models, shingle hashes and a tokenizer.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters at all) or with one that is a guess go."""
    small_batches(spark)
    tag = langid.tagger(spark, langid.fit(docs.select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model")))
    row = F.struct(*docs.columns).alias("row")
    tagged = docs.select(row, tag(F.col("text")).alias("tag"))
    return tagged.filter((F.col("tag.lang_pred") != langid.UNDETERMINED) & (F.col("tag.score") >= 0.3)).select("row.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three lines or more are cut out; a text of which nothing is left goes."""
    small_batches(spark)
    out = line_dedup.deduplicate(docs).filter("lines.n_removed = 0 OR lines.n_removed < lines.n_lines")
    changed = {"text": F.col("lines.text"), "n_chars": F.when(F.col("lines.n_removed") > 0, F.length("lines.text")).otherwise(F.col("row.n_chars"))}
    return out.select(*[changed.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: first of groups by the narrow radius, then of near copies."""
    small_batches(spark)
    columns, ids = docs.columns, F.col("row_id").alias("doc_id")
    docs = told_apart(docs)
    for settings in ({}, simhash.SIMILAR):
        gone = simhash.surplus(docs.select(ids, "text"), **settings)
        docs = without(docs, gone.select(F.col("doc_id").alias("row_id")), "row_id")
    return docs.select(columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    small_batches(spark)
    marked = docs.withColumn("mark", text_mark())  # a leak lies in the text, whatever its id
    found = decontaminate.leaks(marked.select(F.col("mark").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(marked, found.select(F.col("doc_id").alias("mark")), "mark").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
