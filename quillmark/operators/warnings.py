"""Data-quality warnings: conditions over a row of state a document, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codes, severities and stages, in the order of the stages; then the columns of state that the condition reads, and the condition.
RULES = [
    ("pdf_empty_file", "error", "parse", ("size",), "size = 0"),
    ("pdf_corrupt", "error", "parse", ("size", "page_count"), "size > 0 AND page_count = 0"),
    ("pdf_degraded_mode", "warning", "parse", ("extraction_method",), "extraction_method IN ('pages', 'raw_chunk')"),
    ("pdf_no_text", "error", "parse", ("n_paragraphs",), "n_paragraphs = 0"),
    ("features_short_paper", "warning", "features", ("n_paragraphs",), "n_paragraphs BETWEEN 1 AND 4"),
    ("features_too_few_valid", "warning", "features", ("n_paragraphs", "n_valid"), "n_paragraphs > 0 AND n_valid < 3"),
    ("cluster_skipped_short", "warning", "cluster", ("n_paragraphs", "outcome"), "n_paragraphs > 0 AND outcome IN ('skipped', 'too_short')"),
    ("cluster_zero_variance", "info", "cluster", ("outcome",), "outcome = 'zero_variance'"),
    ("cluster_zero_variance", "warning", "cluster", ("outcome",), "outcome = 'one_column'"),
    ("cluster_noise_override", "warning", "cluster", ("noise_override",), "noise_override"),
    ("cluster_single_author", "info", "cluster", ("outcome", "estimated_authors", "anomaly_count"), "outcome = 'cluster' AND estimated_authors = 1 AND anomaly_count = 0"),
    ("gpt_unavailable", "warning", "reasoning", ("reasoning_available", "reasoning_skipped"), "NOT reasoning_available AND NOT reasoning_skipped"),
    ("gpt_unavailable", "info", "reasoning", ("reasoning_skipped",), "reasoning_skipped"),
    ("gpt_timeout", "error", "reasoning", ("reasoning_error",), "reasoning_error"),
    ("gpt_timeout", "warning", "reasoning", ("n_timeouts",), "n_timeouts > 0"),
    ("gpt_partial_results", "warning", "reasoning", ("n_failed",), "n_failed > 0"),
    ("citation_none_found", "info", "citations", ("n_paragraphs", "total_citations"), "n_paragraphs > 0 AND total_citations = 0"),
    ("citation_no_years", "info", "citations", ("total_citations", "n_years"), "total_citations > 0 AND n_years = 0"),
    ("source_arxiv_timeout", "warning", "sources", ("n_search_errors",), "n_search_errors > 0"),
    ("source_embedding_failed", "warning", "sources", ("n_unembedded",), "n_unembedded > 0"),
]


def emit(state: DataFrame) -> DataFrame:
    """(doc_id, stage_order, code, severity, stage) of every rule that a document's row of state fulfils.

    state may come from one stage alone: rules of which it lacks a column are that stage's no business and left out.
    """
    usable = [(i, *r) for i, r in enumerate(RULES) if set(r[3]) <= set(state.columns)]
    codes = F.array_compact(F.array(*(F.when(F.expr(when), F.struct(F.lit(i).alias("stage_order"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(stage).alias("stage"))) for i, code, severity, stage, _, when in usable)))
    return state.select("doc_id", F.explode(codes).alias("w")).select("doc_id", "w.*")


def rollup(warnings: DataFrame) -> DataFrame:
    """(doc_id, warning_count, partial_results, codes)."""
    return warnings.groupBy("doc_id").agg(F.count("*").alias("warning_count"), F.bool_or((F.col("severity") == "error") | F.col("code").isin("gpt_timeout", "gpt_partial_results")).alias("partial_results"), F.transform(F.array_sort(F.collect_list(F.struct("stage_order", "code"))), lambda x: x["code"]).alias("codes"))
