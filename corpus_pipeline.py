"""The corpus pipeline: stages over `documents`, each on all that its predecessor kept.

Each stage is one operator of quillmark.llm with production parameters. The stages are chained through Parquet
folders below spark.checkpoint.dir, so a lost executor costs a re-read and never an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, mixing, near_dedup, quality_model, runtime, suffix_dedup


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id."""
    return near_dedup.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the 50-byte strings that a document with a smaller doc_id has."""
    return suffix_dedup.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with size (words), source_size, target (of the source) and taken (words, repeats counted).

    Where docs has a column of such a name, it stays, and the new one is called mix_<name>.
    """
    sized = mixing.with_hash(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source"))
    limits = mixing.thresholds(runtime.cut(sized.select("_key", "source", "_hash", "_size"), "mix-sizes"))
    new = {"_size": "size", "_source_size": "source_size", "_target": "target", "_taken": "taken"}
    kept = [F.col(f"_row.{c}").alias(c) for c in docs.columns]
    return mixing.mix(sized, limits).filter("_taken > 0").select(*kept, *(F.col(c).alias(f"mix_{n}" if n in docs.columns else n) for c, n in new.items()))


STAGES = [
    ("quality_classifier", good_text),
    ("near_dedup", one_of_each),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]
#: SQL can't express the classifier, the signatures or the suffix sorting.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = runtime.cut(stage(spark, docs, sf_dir), name)
    return docs
