"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html_text, lm_score, mixing, near_dedup, periodic_runs, quality_model, quality_rules, runtime, secret_scan, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    root = warc.write(pages, least=0)
    return warc.read(spark, root, pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_model.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_chars", "perplexity", "cutoff", "kept")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 6))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    of = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("long")
    counts = (of(i).alias(f"n_{kind}") for i, kind in enumerate(secret_scan.BASE))
    return found.select("doc_id", *counts, F.sha2(secret_scan.told("base").cast("binary"), 256).alias("base_sha256"), secret_scan.told("spans").alias("spans"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts of the contract: where h = crc32(doc_id) has h % 10 = 0, with g = h div 10 and n words, words from a = g % n on repeat with p = 1 + (n - a) div (3 + g % 8). A null doc_id has no h."""
    h, g = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.expr("_h div 10")
    word = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(runtime.WORD), F.lit(0))

    def looped(words):
        n = F.size(words)
        a = F.pmod(g, n.cast("long"))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8).cast("long"))))
        at = lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i).cast("int"))), " ")

    new = F.element_at(F.transform(F.array(word), lambda w: F.when(F.size(w) > 0, looped(w)).otherwise("")), 1)
    return docs.select("doc_id", "text", h.alias("_h")).select("doc_id", F.when(F.col("_h") % 10 == 0, new).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(with_planted_runs(_table(spark, sf_dir, "documents"))).withColumn("_top", periodic_runs.strongest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    top = [F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")]
    digests = (F.sha2(c.cast("binary"), 256).alias(n) for n, c in (("runs_sha256", lines), ("collapsed_sha256", F.col("collapsed"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, F.expr("1000 * _top.length div _top.period").alias("exponent_milli"), *digests)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_warc_index, op4_toxicity, op5_html_text, op6_suffix_dedup, op7_quality_model, op8_near_dedup, op9_stupid_backoff, op10_decontaminate, op11_secret_scan, op12_periodic_runs, op13_source_divergence)}
