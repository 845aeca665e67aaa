"""The integrity score and its texts: one projection over a row of evidence a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PENALTY, SCORE_START
from ..functions import numeric as N

# Sentences of the report.
AI_ALERT = (" 🚨 CRITICAL AI ALERT: The document's 'Burstiness' curve (sentence-length variance) is artificially flat (", "). This is statistically a guaranteed signature of an AI/ChatGPT Generative Language Model!")
# Own wording: what adds a written synthesis here is a table of answers (analyze's Inputs.answers), not a key of a vendor.
ADVICE = "Add a reasoning table for a comprehensive AI-powered forensic synthesis."


def _mean(array: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(array), F.lit(1))


def penalties() -> Column:
    """What evidence(noise, estimated_authors, anomaly_count, boundary_count, burstiness, severities, similarities, reasoning_available, explanation_count) takes off."""
    high, medium = F.size(F.filter("severities", lambda s: s == "high")), F.size(F.filter("severities", lambda s: s == "medium"))
    p = PENALTY
    source = lambda s: F.when(s >= 0.9, p["source"][0]).when(s >= 0.8, p["source"][1]).when(s >= 0.75, p["source"][2]).otherwise(0.0)
    return (
        p["noise"] * F.col("noise")
        + p["author"] * F.greatest(F.col("estimated_authors") - 1, F.lit(0))
        + F.when((F.size("burstiness") >= 3) & (_mean("burstiness") < 0.30), p["generated"]).otherwise(0.0)
        + F.least(p["anomaly"][0] * F.col("anomaly_count"), F.lit(p["anomaly"][1]))
        + F.when(F.col("boundary_count") > 2, F.least(p["boundary"][0] * (F.col("boundary_count") - 2), F.lit(p["boundary"][1]))).otherwise(0.0)
        + p["high"] * high
        + p["medium"] * medium
        + p["late"] * F.size("severities")
        + F.aggregate("similarities", F.lit(0.0), lambda a, s: a + source(s))
        + F.when(F.col("reasoning_available"), F.least(p["explanation"][0] * F.col("explanation_count"), F.lit(p["explanation"][1]))).otherwise(0.0)
    )


def verdict(score: Column) -> Column:
    return F.when(score < 4.0, "Highly Plagiarized").when(score < 7.5, "Suspicious").otherwise("Clean")


def score(evidence: DataFrame) -> DataFrame:
    """evidence with integrity_score (0 to 10, one decimal) and verdict."""
    raw = evidence.withColumn("integrity_score", F.greatest(F.lit(0.0), F.least(F.lit(10.0), N.round_even(SCORE_START - penalties(), 1))))
    return raw.withColumn("verdict", verdict(F.col("integrity_score")))


def bands(scored: DataFrame) -> DataFrame:
    """scored with the colour band, the gauge offset and the evidence badges of a dashboard."""
    s = F.col("integrity_score")
    return scored.withColumns(
        {
            "band": F.when(s < 4.5, "danger").when(s < 8, "warning").otherwise("success"),
            "gauge_offset": 377 - s / 10 * 377,
            "stylometric_badge": F.when((F.col("estimated_authors") > 1) | (F.col("anomaly_count") > 5), "warning").otherwise("success"),
            "source_badge": F.when(F.size("similarities") > 0, "danger").otherwise("success"),
            "citation_badge": F.when(F.size("severities") > 0, "danger").otherwise("success"),
        }
    )


def texts(scored: DataFrame) -> DataFrame:
    """scored with executive_summary, evidence_breakdown (stylometric_analysis, citation_analysis, source_matches) and conclusion.

    Reads also noise_override, too_short, confidence and explanations (the texts of the reasoning service, as one).
    """
    percent = lambda x: F.format_string("%.1f", N.round_even(x * 100, 1))
    number = lambda c: F.col(c).cast("string")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    noise, n_sources, n_late = percent(F.col("noise")), F.size("similarities"), F.size("severities")
    mean = _mean("burstiness")
    flat = F.when((F.size("burstiness") >= 3) & (mean < 0.30), join(AI_ALERT[0], F.format_string("%.2f", N.round_even(mean, 2)), AI_ALERT[1])).otherwise("")
    opening = join("The HDBSCAN clustering identified ", number("estimated_authors"), " estimated authors with ", number("anomaly_count"), " anomalies and a noise percentage of ", noise, "%. ")
    plain = join("Boundary count: ", number("boundary_count"), ". Cluster confidence: ", number("confidence"), ".", flat)
    broken = join("The boundary count of ", number("boundary_count"), " and low confidence score of ", number("confidence"), " indicate substantial stylistic shifts, although specific reasoning for these shifts is unavailable due to API errors.", flat)
    style = F.concat(
        opening,
        F.when(F.contains(F.coalesce("explanations", F.lit("")), F.lit("API errors")), broken).otherwise(plain),
        F.when(F.col("noise_override"), " Note: HDBSCAN noise saturation occurred — clustering may be unreliable.").otherwise(""),
        F.when(F.col("too_short"), " Note: Document had too few paragraphs for optimal clustering.").otherwise(""),
    )
    cited = F.when(n_late > 0, join("Found ", n_late.cast("string"), " temporal citation anomalie(s). Paragraphs cite sources from significantly different time periods than the core document.")).otherwise("No temporal citation anomalies detected.")
    traced = F.when(n_sources > 0, join("Semantic source tracing found ", n_sources.cast("string"), " match(es) in global open-source databases (highest similarity: ", percent(F.array_max("similarities")), "%).")).otherwise("No confirmed external source matches from global databases.")
    summary = (
        F.when(F.col("verdict") == "Clean", join("The document shows consistent writing style with ", noise, "% stylistic noise. No significant plagiarism indicators were found."))
        .when(F.col("verdict") == "Suspicious", join("The document exhibits ", noise, "% stylistic noise with ", number("anomaly_count"), " anomalous section(s). Multiple evidence streams suggest potential integrity concerns."))
        .otherwise(join("The document shows strong plagiarism indicators: ", noise, "% stylistic noise, ", number("anomaly_count"), " anomalous section(s), and ", n_sources.cast("string"), " external source match(es)."))
    )
    end = join("Based on mathematical analysis, this document is assessed as '", F.col("verdict"), "' with an integrity score of ", number("integrity_score"), "/10. ", ADVICE)
    return scored.withColumns({"executive_summary": join("[Rule-Based Analysis] ", summary), "evidence_breakdown": F.struct(style.alias("stylometric_analysis"), cited.alias("citation_analysis"), traced.alias("source_matches")), "conclusion": end})


def pruned(scored: DataFrame) -> DataFrame:
    """(doc_id, evidence): what a report writer is given, and no more."""
    clusters = F.struct("estimated_authors", "anomaly_count", F.col("noise").alias("noise_percentage"), "boundary_count", "confidence", "noise_override", "too_short")
    return scored.select("doc_id", F.struct(clusters.alias("clustering"), F.col("explanations").alias("reasoning"), F.struct(F.col("total_citations").alias("total_found"), F.size("severities").alias("temporal_anomaly_count")).alias("citations"), F.col("similarities").alias("sources")).alias("evidence"))
