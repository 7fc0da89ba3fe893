"""A training-data pipeline: stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import decontaminate, jaccard_join, language, pieces, substring_dedup
from lagweave.llm.shared import parted, saved, swept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def after_sweep(stage: Stage) -> Stage:
    """The stage, begun with heaps that hold nothing of the stage before."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        swept(spark)
        return stage(spark, docs, sf_dir)

    return run


@after_sweep
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: those with letters, half of whose words at
    least are of the language predicted."""
    rows = language.held_out(docs)
    model = language.fit(rows.where("not held_out"))
    told = language.predicted(docs, model, keep=True)
    return told.where(f"__lang_pred <> '{language.UNKNOWN}' and __score >= 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


@after_sweep
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles at 0.8 or more join, keeps the
    first by doc_id. Documents without words are alone; repeated rows of one doc_id and text stay once."""
    rows = saved(jaccard_join.joined(docs, words=5, percent=80).where("n_shingles > 0"), "groups")
    swept(spark)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = rows.groupBy("group_id").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(first, "group_id")  # groups of one need nothing
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    rows = rows.select("doc_id", "text_hash", same.alias("kept"), F.xxhash64("doc_id", "text_hash").alias("mark")).distinct()
    rows = saved(rows, "grouped")
    mark = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    grouped, alone = parted(docs, mark, rows, "mark")
    grouped = grouped.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64("text")}).alias("d")
    grouped = grouped.join(rows.alias("r"), F.expr("d.__hash = r.text_hash and d.__id <=> r.doc_id"), "left").where("r.kept is null or r.kept")
    copies = F.when(F.col("r.kept"), F.lit(0)).otherwise(F.monotonically_increasing_id())
    once = grouped.withColumn("__copy", copies).dropDuplicates(["__id", "__hash", "__copy"])
    return once.select(*[F.col(f"d.`{c}`") for c in docs.columns]).union(alone)


@after_sweep
def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents of which nothing is left go."""
    rows = substring_dedup.deduplicated(docs)
    rest = rows.where("n_removed = 0 or length(trim(text)) > 0")
    return rest.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@after_sweep
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold eight words in a row of a benchmark item, or two items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.cleaned(docs, benchmark)


@after_sweep
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests, and the decoded text of every document."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_deduplication", substring_deduplication),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
