"""The analysis of each document as one JSON text, in the shape of the service's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """(doc_id, name): the rows of a document as an array, in order; fields are those of rows, the ordering ones first."""
    rest = [c for c in rows.columns if c not in ("doc_id", *order)]
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def responses(analysis: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, json) of analyze(): paragraphs, clustering, reasoning, citations, sources, report, and the warnings as data_quality.

    A document without text has status error and nulls for what wasn't analysed.
    """
    told = analysis["report"]
    parts = [
        _listed(analysis["paragraphs"], "paragraphs", "paragraph_index"),
        _listed(analysis["boundaries"], "boundaries", "after_paragraph"),
        _listed(analysis["citations"].select("doc_id", "paragraph_index", "citations", "citation_count", "years", "median_year"), "per_paragraph", "paragraph_index"),
        _listed(analysis["temporal_anomalies"], "temporal_anomalies", "paragraph_index"),
        _listed(analysis["warnings"], "warnings", "stage_order", "code"),
    ]
    if "sources" in analysis:
        parts.append(_listed(analysis["sources"], "sources", "paragraph_index"))
    for p in parts:
        told = told.join(p, "doc_id", "left")
    there = F.col("status") == "success"
    if "sources" not in told.columns:
        told = told.withColumn("sources", F.array())
    some = lambda c: F.when(there, F.coalesce(F.col(c), F.array().cast(told.schema[c].dataType)))
    clustering = F.struct("estimated_authors", "anomaly_count", F.col("noise").alias("noise_percentage"), "confidence", "noise_override", "too_short", some("boundaries").alias("boundaries"), "boundary_count")
    reasoning = F.struct(F.col("reasoning_available").alias("available"), "boundary_explanations", "anomaly_profiles")
    citations = F.struct(some("per_paragraph").alias("per_paragraph"), F.col("total_citations").alias("total_citations_found"), some("temporal_anomalies").alias("temporal_anomalies"), F.size(some("temporal_anomalies")).alias("temporal_anomaly_count"), "core_median", "noise_median", "core_density", "noise_density", "density_ratio", "total_references", "bibliography_median", "hallucination_count")
    written = F.struct("integrity_score", "verdict", "executive_summary", "evidence_breakdown", "conclusion")
    severe = lambda *names: F.exists(F.coalesce(F.col("warnings"), F.array().cast(told.schema["warnings"].dataType)), lambda w: w["severity"].isin("error") | w["code"].isin(*names))
    quality = F.struct(F.coalesce(F.size("warnings"), F.lit(0)).alias("warning_count"), severe("gpt_timeout", "gpt_partial_results").alias("partial_results"), F.coalesce(F.col("warnings"), F.array().cast(told.schema["warnings"].dataType)).alias("warnings"))
    shape = F.struct(
        F.col("doc_id").cast("string").alias("filename"),
        "status",
        "error",
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        "extraction_method",
        F.coalesce(some("paragraphs"), F.array().cast(told.schema["paragraphs"].dataType)).alias("paragraphs"),
        *(F.when(there, x).alias(n) for n, x in (("clustering", clustering), ("reasoning", reasoning), ("citations", citations), ("report", written))),
        some("sources").alias("sources"),
        quality.alias("data_quality"),
    )
    return told.select("doc_id", F.to_json(shape, {"ignoreNullFields": "false"}).alias("json"))


def write(analysis: dict[str, DataFrame], path: str) -> None:
    """responses() as text files, one document a line."""
    responses(analysis).select("json").write.mode("overwrite").text(path)
